"""Passages for a reader: verse ranges, quotations; spans of anchors, gaps and runs in numbered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def ranges(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers of each key as a reference: runs of three or more as 4–6, of two as 4, 5."""
    n = rows.where(F.col(number).isNotNull()).select(key, F.col(number).alias("n")).distinct()
    island = n.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy(key).orderBy("n")))
    runs = island.groupBy(key, "run").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).when(F.col("b") == F.col("a") + 1, F.concat_ws(", ", "a", "b")).otherwise(F.concat_ws("–", "a", "b"))
    ordered = F.array_sort(F.collect_list(F.struct("a", text.alias("text"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), ", ").alias("reference"))


def quotes(chosen: DataFrame, key: str, joiner: str) -> DataFrame:
    """Chosen segments (idx, text) of each key as a quotation; a gap shows as an ellipsis."""
    gap = F.col("idx") - F.lag("idx").over(Window.partitionBy(key).orderBy("idx"))
    lead = F.when(gap.isNull(), "").when(gap == 1, joiner).otherwise(joiner + "… ")
    parts = chosen.withColumn("part", F.concat(lead, "text"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "part"))), lambda x: x["part"]), "").alias("quote"))


def number_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers from 1 to a key's largest that it does not have."""
    have = rows.select(key, F.col(number).cast("int").alias("n")).distinct()
    all_ = have.groupBy(key).agg(F.max("n").alias("m")).select(key, F.explode(F.sequence(F.lit(1), F.col("m"))).alias("n"))
    return all_.join(have, [key, "n"], "left_anti")


def span_ends(marks: DataFrame, key: str, start: str, length: Column) -> DataFrame:
    """Each mark's span ends where the next begins, the last one's at the end. A work's marks need not fit one task."""
    return scans.following(marks, [key], [start], start, "span_end").withColumn("span_end", F.coalesce("span_end", length))


def carried(rows: DataFrame, key: str, order: list[str], label: Column) -> DataFrame:
    """The last label that was seen, for rows that have none."""
    return scans.carried(rows, [key], order, {"carried": label})


def rising(rows: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    """Rows whose number is higher than all before it: headings in order, without strays. skipped() tells which were left out."""
    return scans.highest_before(rows, [key], order, number, "__before").where(F.col("__before").isNull() | (F.col(number) > F.col("__before"))).drop("__before")


def skipped(rows: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    """The rows that rising() leaves out, with the number that they are not above."""
    return scans.highest_before(rows, [key], order, number, "above").where(F.col(number).isNull() | (F.col(number) <= F.col("above")))


def without_runs(rows: DataFrame, key: str, at: str, gap: int, length: int) -> DataFrame:
    """Rows but for runs of `length` or more that follow each other more closely than `gap`: headings of a table of contents."""
    w = Window.partitionBy(key).orderBy(at)
    fresh = F.when(F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(gap)) >= gap, 1).otherwise(0)
    runs = rows.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("__n", F.count("*").over(Window.partitionBy(key, "__run"))).where(F.col("__n") < length).drop("__fresh", "__run", "__n")
