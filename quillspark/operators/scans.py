"""Scans along an order that no single task has to hold: carried values, running totals, jumps.

A window over a group is one task, however long the group is. Here rows are dealt out by ranges of
(group, order) into slices, a group that is long lies in many of them, and each slice is scanned by
itself; of each slice and group one row tells what it hands on (its last label, its sum). These rows are
scanned once more, at most as many a group as there are slices, and what comes from the slices before
is added in a second pass. The slices are written, so that both passes see the same ones.

Groups can be null, and so can order columns, which come first then. Rows that the order leaves equal lie in one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import stored

_SLICE, _KEY = "__slice", "__key"


def sliced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of their slice and a struct of their keys, which is null-safe in joins."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(_KEY, F.struct(*keys)).repartitionByRange(n, _KEY, *order)
    return stored(dealt.withColumn(_SLICE, F.spark_partition_id()), "slices")


def _handed(df: DataFrame, totals: dict[str, Column], merge: Callable[[Column], Column], back: bool = False) -> DataFrame:
    """Slices' rows with, as __in_<name>, what the slices before (back: behind) hand on to their group; null where nothing does."""
    earlier = Window.partitionBy(_KEY).orderBy(F.col(_SLICE).desc() if back else F.col(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    # slices are ranges, so a group that lies in several is the first or the last of each: what is handed on is at most a row or two a slice
    ends = df.groupBy(_SLICE).agg(F.min(_KEY).alias("first"), F.max(_KEY).alias("last")).select(_SLICE, F.explode(F.array_distinct(F.array("first", "last"))).alias(_KEY))
    several = ends.groupBy(_KEY).agg(F.count("*").alias("n")).where("n > 1").select(_KEY)
    each = df.join(F.broadcast(several), _KEY, "left_semi").groupBy(_SLICE, _KEY).agg(*(total.alias(name) for name, total in totals.items()))
    carry = each.select(_SLICE, _KEY, *(merge(F.col(name)).over(earlier).alias(f"__in_{name}") for name in totals))
    return df.join(F.broadcast(carry.where(F.coalesce(*(F.col(f"__in_{name}").isNotNull() for name in totals)))), [_SLICE, _KEY], "left")


def _within(order: list[str], start: int, end: int):
    return Window.partitionBy(_SLICE, _KEY).orderBy(*order).rowsBetween(start, end)


def _done(df: DataFrame, names) -> DataFrame:
    return df.drop(_SLICE, _KEY, *(f"__in_{name}" for name in names))


def carried(rows: DataFrame, keys: list[str], order: list[str], labels: dict[str, Column], back: bool = False) -> DataFrame:
    """rows with, under each name, the last value of its label up to and with the row that is not null (back: the first from the row on)."""
    df = sliced(rows.withColumns(labels), keys, order)
    pick = F.min_by if back else F.max_by
    df = _handed(df, {name: pick(name, F.when(F.col(name).isNotNull(), F.struct(*order))) for name in labels}, lambda own: F.last(own, ignorenulls=True), back)
    w = _within(order, 0, Window.unboundedFollowing) if back else _within(order, Window.unboundedPreceding, 0)
    near = F.first if back else F.last
    return _done(df.withColumns({name: F.coalesce(near(name, ignorenulls=True).over(w), f"__in_{name}") for name in labels}), labels)


def highest_before(rows: DataFrame, keys: list[str], order: list[str], number: str, name: str) -> DataFrame:
    """rows with the highest number of the rows before, null for the first."""
    df = _handed(sliced(rows, keys, order), {name: F.max(number)}, F.max)
    return _done(df.withColumn(name, F.greatest(F.max(number).over(_within(order, Window.unboundedPreceding, -1)), f"__in_{name}")), [name])


def following(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the next row, null for the last. Values are not null."""
    df = _handed(sliced(rows, keys, order), {name: F.min_by(value, F.struct(*order))}, lambda own: F.last(own, ignorenulls=True), back=True)
    return _done(df.withColumn(name, F.coalesce(F.lead(value).over(Window.partitionBy(_SLICE, _KEY).orderBy(*order)), f"__in_{name}")), [name])


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, under each name, the sum of its column up to and with the row; null counts as 0."""
    df = sliced(rows.withColumns({name: F.coalesce(c, F.lit(0)).cast("long") for name, c in sums.items()}), keys, order)
    df = _handed(df, {name: F.sum(name) for name in sums}, F.sum)
    own = _within(order, Window.unboundedPreceding, 0)
    return _done(df.withColumns({name: F.sum(name).over(own) + F.coalesce(f"__in_{name}", F.lit(0)) for name in sums}), sums)


def parts(rows: DataFrame, keys: list[str], order: list[str], size: str, target: int) -> DataFrame:
    """rows with __part: a group's rows in order are packed, a part ends with the row by which its sizes reach the target.

    Each slice is packed in one pass. That is right for every group that lies in it whole; only the first and
    the last group of a slice may go on in others, however long they are, and these go by jumps (_far_parts).
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys))).alias(_KEY), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__own"), *rows.columns)
    dealt = dealt.repartitionByRange(n, *keys, *order, size).sortWithinPartitions(*keys, *order, size)
    schema = T.StructType([*rows.schema.fields, T.StructField(_SLICE, T.IntegerType()), T.StructField("__nth", T.LongType()), T.StructField("__part", T.IntegerType())])
    near = stored(dealt.withColumn(_SLICE, F.spark_partition_id()).mapInArrow(_packing(target), schema), "packed-slices")
    last = near.groupBy(_SLICE).agg(F.max("__nth").alias("__last"))
    met = near.join(F.broadcast(last), _SLICE)
    edge = (F.col("__nth") == 0) | (F.col("__nth") == F.col("__last"))
    whole = met.where(~edge).select(*rows.columns, "__part")
    far = stored(met.where(edge).select(*rows.columns), "packed-edges")
    return whole.unionByName(_far_parts(far, keys, order, size, target))


def _packing(target: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of one slice in order, with the slice, the place of each row's group in it and the row's part, as if every group began there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nth, part, held = None, -1, 0, 0
        for batch in batches:
            groups, packed = [], []
            # a struct's values as a tuple; NaN is equal to itself here, as in Spark's grouping
            own = list(zip(*(["NaN" if x != x else x for x in column.to_pylist()] for column in batch.column(0).flatten())))
            for k, size in zip(own, batch.column(1).to_pylist()):
                if k != key or nth < 0:
                    key, nth, part, held = k, nth + 1, 0, 0
                groups.append(nth)
                packed.append(part)
                held += size
                if held >= target:
                    part, held = part + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(groups, pa.int64()), pa.array(packed, pa.int32())], names=[*batch.schema.names[2:], "__nth", "__part"])

    return run


def _far_parts(rows: DataFrame, keys: list[str], order: list[str], size: str, target: int) -> DataFrame:
    """parts of groups that need not lie in one slice.

    Where a part begins depends on all before it, yet each row's jump, to the row behind the part that
    would begin with it, does not: it is found among the running sums. Which rows do begin a part is then
    found by doubling: the marked rows' jumps are marked, and jumps become jumps of twice as many parts.
    """
    df = stored(running(rows, keys, [*order, size], {"__n": F.lit(1), "__sum": F.col(size)}).withColumn("__key", F.struct(*keys)), "packed-sums")
    ends = df.select("__key", F.col("__sum").alias("v"), F.lit(1).alias("kind"), F.col("__n").alias("n"))
    aims = df.select("__key", (F.col("__sum") - F.coalesce(size, F.lit(0)) + target).alias("v"), F.lit(0).alias("kind"), F.col("__n").alias("n"))
    met = carried(ends.unionByName(aims).withColumnRenamed("__key", "k"), ["k"], ["v", "kind", "n"], {"end": F.when(F.col("kind") == 1, F.col("n"))}, back=True)
    jumps = stored(met.where("kind = 0 AND end IS NOT NULL").select("k", "n", (F.col("end") + 1).alias("to")), "packed-jumps")
    marked = df.where("__n = 1").select(F.col("__key").alias("k"), F.col("__n").alias("n"))
    while not jumps.isEmpty():
        marked = stored(marked.unionByName(marked.join(jumps, ["k", "n"]).select("k", F.col("to").alias("n"))), "packed-marks")
        further = jumps.select("k", F.col("n").alias("to"), F.col("to").alias("beyond"))
        jumps = stored(jumps.join(further, ["k", "to"]).select("k", "n", F.col("beyond").alias("to")), "packed-jumps")
    begins = df.join(marked.select(F.col("k").alias("__key"), F.col("n").alias("__n"), F.lit(1).alias("__begin")), ["__key", "__n"], "left").drop("__key")
    return running(begins, keys, ["__n"], {"__part": F.col("__begin")}).withColumn("__part", (F.col("__part") - 1).cast("int")).drop("__n", "__sum", "__begin")
