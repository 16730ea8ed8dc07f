"""Vector arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A unit vector's component times this is its 8-bit value.
SCALE = 127


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-9))
    return F.transform(v, lambda x: x.cast("double") / n)


def quantised(v: Column, scale: int = SCALE) -> Column:
    """Components times scale, rounded half to even and clipped, as bytes."""
    return F.transform(v, lambda x: F.greatest(F.lit(-scale), F.least(F.lit(scale), F.rint(x.cast("double") * scale))).cast("tinyint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
