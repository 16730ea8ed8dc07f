"""Vector search over small sets of queries, and fusion of ranked lists."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot

RRF_K = 60
#: Queries of one call are sent to every task; more than this many must be asked in several calls.
MOST_QUERIES = 1000


def nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """qid, unit_id, score, rank: every vector is scored against each of the few queries, without a shuffle of vectors."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    few = F.broadcast(queries.groupBy().agg(F.collect_list(F.struct("qid", "query")).alias("queries")))
    scored = vectors.join(few).select("unit_id", "vector", F.explode("queries").alias("q")).select("q.qid", "unit_id", dot(F.col("vector"), F.col("q.query")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "unit_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def best_per_unit(chunks: DataFrame) -> DataFrame:
    """The best chunk of each unit: the higher score, then the earlier chunk."""
    best = F.max_by(F.struct("chunk_id", "score"), F.struct("score", -F.col("chunk_id")))
    return chunks.groupBy("qid", "unit_id").agg(best.alias("best")).select("qid", "unit_id", "best.chunk_id", "best.score")


def fuse(lists: list[tuple[DataFrame, float]], limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (qid, unit_id, rank), each with a weight; equal scores by id."""
    parts = [df.select("qid", "unit_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    scored = whole.groupBy("qid", "unit_id").agg(F.sum("part").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "unit_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists as one: ranks of the second go on behind those of the first; an id in both stays twice."""
    length = first.groupBy("qid").agg(F.max("rank").alias("n"))
    return first.select("qid", "unit_id", "rank").unionByName(second.join(length, "qid", "left").select("qid", "unit_id", (F.col("rank") + F.coalesce("n", F.lit(0))).alias("rank")))


def _choose(limit: int, of_source: int, of_tradition: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        left = {"source": defaultdict(lambda: of_source), "tradition": defaultdict(lambda: of_tradition)}
        passed_over = np.ones(len(rows), dtype=bool)
        for at, (source, tradition) in enumerate(zip(rows["source"].astype(object).where(rows["source"].notna(), None), rows["tradition"].astype(object).where(rows["tradition"].notna(), None))):
            if left["source"][source] and left["tradition"][tradition]:
                left["source"][source] -= 1
                left["tradition"][tradition] -= 1
                passed_over[at] = False
                if (~passed_over).sum() == limit:
                    break
        out = rows.iloc[np.argsort(passed_over, kind="stable")[:limit]]
        return out[["qid", "unit_id", "source", "tradition"]].assign(place=np.arange(1, len(out) + 1, dtype=np.int32))

    return run


def diversify(ranked: DataFrame, limit: int, of_source: int = 2, of_tradition: int | None = None) -> DataFrame:
    """Takes rows in rank order under quotas of source and tradition, then fills up with those passed over.

    A row that one quota turns away must not count for the other, so this is a loop over a question's
    rows. It needs few of them: of a source and tradition only the first of_source rows can be taken,
    as neither quota opens again, and the rows that fill up are among the first 2 * limit.
    """
    own = Window.partitionBy("qid", "source", "tradition").orderBy("rank")
    rows = ranked.select("qid", "unit_id", "source", "tradition", "rank").withColumn("__nth", F.row_number().over(own))
    whole = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    few = rows.withColumn("__place", whole).where((F.col("__nth") <= of_source) | (F.col("__place") <= 2 * limit)).drop("__nth", "__place")
    return few.groupBy("qid").applyInPandas(_choose(limit, of_source, of_tradition or math.ceil(limit / 2)), "qid int, unit_id long, source string, tradition string, place int")


def _voiced(limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chosen = rows[rows["kind"] == "chosen"].sort_values("place").to_dict("records")
        for extra in rows[rows["kind"] == "voice"].sort_values("tradition").to_dict("records"):
            if any(r["tradition"] == extra["tradition"] for r in chosen):
                continue
            if len(chosen) < limit:
                chosen.append(extra)
                continue
            counts: dict = {}
            for r in chosen:
                counts[r["tradition"]] = counts.get(r["tradition"], 0) + 1
            crowded = max(counts, key=counts.get)
            chosen[max(i for i, r in enumerate(chosen) if r["tradition"] == crowded)] = extra
        out = pd.DataFrame(chosen, columns=rows.columns)
        out["place"] = range(1, len(out) + 1)
        return out[["qid", "unit_id", "source", "tradition", "place"]]

    return run


def with_named_traditions(chosen: DataFrame, scored: DataFrame, named: DataFrame, limit: int) -> DataFrame:
    """For questions that name two traditions or more: each one that is missing gets its best unit in, for the last of the most crowded."""
    several = named.groupBy("qid").agg(F.countDistinct("tradition").alias("n")).where("n >= 2").join(named, "qid").select("qid", "tradition").distinct()
    best = scored.join(F.broadcast(several), ["qid", "tradition"]).groupBy("qid", "tradition").agg(F.max_by(F.struct("unit_id", "source"), F.struct("score", -F.col("unit_id"))).alias("b"))
    voices = best.select("qid", "b.unit_id", "b.source", "tradition", F.lit(0).alias("place"), F.lit("voice").alias("kind"))
    return chosen.withColumn("kind", F.lit("chosen")).unionByName(voices).groupBy("qid").applyInPandas(_voiced(limit), "qid int, unit_id long, source string, tradition string, place int")
