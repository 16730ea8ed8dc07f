"""Counts of groups brought back to their rows, whatever share of the rows one group has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

#: So many of the largest groups are broadcast; any other holds less than this part of the rows.
LARGEST = 1000


def with_counts(rows: DataFrame, keys: list[str], name: str, least: int = 2, where: Column | None = None) -> DataFrame:
    """rows with, as `name`, how many of them (that fulfil `where`) have the same keys; null below `least`. Nulls are a group of their own.

    rows are read three times, so they should be stored. Counts are partial in each task. The LARGEST
    groups' counts go to all tasks, bounded by their number, and only rows of other groups are shuffled.
    """
    key = F.struct(*keys)
    counted = rows if where is None else rows.where(where)
    counts = stored(counted.groupBy(key.alias("__key")).agg(F.count("*").alias(name)).where(F.col(name) >= least), "counts")
    largest = counts.orderBy(F.desc(name), "__key").limit(LARGEST)
    met = rows.withColumn("__key", key).join(F.broadcast(largest), "__key", "left")
    rest = met.where(F.col(name).isNull()).drop(name).join(counts, "__key", "left")
    return met.where(F.col(name).isNotNull()).unionByName(rest).drop("__key")
