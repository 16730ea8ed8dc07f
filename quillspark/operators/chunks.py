"""Overlapping chunks of units, and the chunk that answers a question best."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans

TARGET, MOST, OVERLAP, PER_UNIT, FAR = 1200, 1800, 200, 1000, 10_000_000
_PARAGRAPH, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")


def spans(text: str) -> list[tuple[int, int]]:
    """Starts and ends that cover a text: cut behind a paragraph, else a sentence, else at a blank, else at the limit."""
    n, out, start = len(text), [], 0
    if n <= MOST:
        return [(0, n)]
    breaks = [[m.end() for m in p.finditer(text)] for p in (_PARAGRAPH, _SENTENCE)]
    while True:
        limit, floor, ideal = start + MOST, start + TARGET // 2, start + TARGET
        if limit >= n:
            return [*out, (start, n)]
        end = None
        for places in breaks:
            near = places[bisect.bisect_left(places, floor) : bisect.bisect_right(places, limit)]
            if near:
                end = min(near, key=lambda p: abs(p - ideal))
                break
        if end is None:
            blank = text.rfind(" ", floor, limit)
            end = blank if blank > floor else limit
        out.append((start, end))
        start = max(start + 1, end - OVERLAP)


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(unit, seq, a, b) for unit, text in zip(pdf["unit_id"], pdf["content"]) for seq, (a, b) in enumerate(spans(text or ""))]
        yield pd.DataFrame(rows, columns=["unit_id", "seq", "char_start", "char_end"])


def chunk(units: DataFrame) -> DataFrame:
    """chunk_id, unit_id, seq, char_start, char_end. Ids are unit_id * PER_UNIT + seq; from a unit's chunk PER_UNIT on,
    which would have the next unit's ids, they are -(unit_id * FAR + seq), so every id is there once."""
    long = units.select("unit_id", "content").where(F.length("content") > MOST).mapInPandas(_explode, "unit_id long, seq int, char_start int, char_end int")
    whole = units.where(F.coalesce(F.length("content"), F.lit(0)) <= MOST).select(F.col("unit_id").cast("long").alias("unit_id"), F.lit(0).alias("seq"), F.lit(0).alias("char_start"), F.coalesce(F.length("content"), F.lit(0)).alias("char_end"))
    near, far = F.col("unit_id") * PER_UNIT + F.col("seq"), -(F.col("unit_id") * FAR + F.col("seq"))
    return whole.unionByName(long).withColumn("chunk_id", F.when(F.col("seq") < PER_UNIT, near).otherwise(far))


def slices(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """Chunks with their text, by a join on the unit."""
    return chunks.join(units.select("unit_id", "content"), "unit_id").withColumn("text", F.substring(F.col("content"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("content")


def best(pieces: DataFrame, terms: list[str]) -> DataFrame:
    """For each unit the piece that holds most of the terms, of equal ones the first."""
    found = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("text"), t)))
    return pieces.withColumn("found", found).groupBy("unit_id").agg(F.max_by(F.struct("seq", "found"), F.struct("found", -F.col("seq"))).alias("b")).select("unit_id", "b.seq", "b.found")


def packed(rows: DataFrame, group: str, order: list[str], size: str, target: int) -> DataFrame:
    """Rows of a group in order, packed into parts: a part ends when its sizes reach the target.

    A group need not fit one task (scans.parts). Texts stay where they are; rows that the order leaves equal go by size, and a size that is null counts as 0.
    """
    own = rows.select(group, *order, F.col(size).cast("long").alias("__size"))
    return scans.parts(own, [group], order, "__size", target).select(group, *order, F.col("__part").alias("part"))


def ordinal(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Place of each row in its group and the group's size: labels like (2 of 5)."""
    w = Window.partitionBy(group)
    return rows.withColumn("nth", F.row_number().over(w.orderBy(*order))).withColumn("of", F.count("*").over(w))
