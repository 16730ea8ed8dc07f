"""Queries on keeping the corpus in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import packs as P
from ..sources.tables import UNITS_SQL, table, units
from .packs import _ASSIGN, fragment_assign


def random_unit(spark, sf):
    """One unit, the same for the same seed."""
    return units(spark, sf).select("unit_id", "title").orderBy(F.md5(F.concat(F.lit("7:"), F.col("unit_id").cast("string"))), "unit_id").limit(1)


def _thousands(spark, sf):
    """Slices of a thousand characters stand for chunks; every third has a vector."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / 1000)).cast("int")
    cut = units(spark, sf).select("unit_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return cut.withColumn("chunk_id", F.col("unit_id") * 1000 + F.col("seq"))


def fragment_export(spark, sf):
    chunks = _thousands(spark, sf)
    out = P.exported("gallic", fragment_assign(spark, sf), units(spark, sf), chunks, chunks.where("chunk_id % 3 = 0").select("chunk_id"))
    whole = None
    for name, df in out.items():
        one = df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        whole = one if whole is None else whole.unionByName(one)
    return whole


def incremental_chunks(spark, sf):
    chunks = _thousands(spark, sf)
    return P.pending(chunks, chunks.where("chunk_id % 3 = 0")).groupBy("unit_id").agg(F.count("*").alias("pending"))


def traceability(spark, sf):
    """Units with and without an origin, by whether they are long."""
    u = units(spark, sf)
    origin = F.coalesce(F.when(~F.col("source").isin("src4", "src9"), F.col("source")), F.lit("")) != ""
    return u.groupBy((F.length("content") >= 500).alias("long")).agg(F.count("*").alias("n"), F.count_if(~origin).alias("untraceable"))


def union_first(spark, sf):
    """Units that two lists found, each once, the first list's row first: long units, and all units."""
    u = units(spark, sf)
    a = u.where(F.length("content") >= 500).select("unit_id", F.lit(1).alias("list"))
    return L.first_seen(a.unionByName(u.select("unit_id", F.lit(2).alias("list"))), ["unit_id"], ["list"])


def repeated_titles(spark, sf):
    """Titles that a work has several times get their number."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_type").alias("title"))
    return L.ordinal_titles(part, ["p_brand"], "title", ["p_partkey"]).select("p_partkey", "title")


QUERIES = {f.__name__: f for f in (random_unit, fragment_export, incremental_chunks, traceability, union_first, repeated_titles)}

_U = "WITH " + UNITS_SQL
_CUT = "cut AS (SELECT unit_id, unit_id * 1000 + seq AS chunk_id FROM (SELECT unit_id, unnest(range(greatest(1, ceil(length(content) / 1000))::BIGINT)) AS seq FROM units))"
SQL = {
    "fragment_export": f"""{_U}, {_ASSIGN}, {_CUT}, own AS (SELECT * FROM units WHERE source IN (SELECT source FROM frag WHERE fragment = 'gallic')), c AS (SELECT * FROM cut WHERE unit_id IN (SELECT unit_id FROM own))
SELECT count(*) AS n, 'units' AS name FROM own UNION ALL SELECT count(*), 'chunks' FROM c UNION ALL SELECT count(*), 'vectors' FROM c WHERE chunk_id % 3 = 0""",
    "incremental_chunks": f"{_U}, {_CUT} SELECT unit_id, count(*) AS pending FROM cut WHERE chunk_id % 3 <> 0 GROUP BY unit_id",
    "traceability": f"{_U} SELECT length(content) >= 500 AS long, count(*) AS n, count(*) FILTER (source IN ('src4', 'src9')) AS untraceable FROM units GROUP BY ALL",
    "union_first": f"{_U} SELECT unit_id, CASE WHEN length(content) >= 500 THEN 1 ELSE 2 END AS list FROM units",
    "random_unit": f"{_U} SELECT unit_id, title FROM units ORDER BY md5('7:' || unit_id), unit_id LIMIT 1",
    "repeated_titles": "SELECT p_partkey, CASE WHEN nth > 1 THEN p_type || ' (' || nth || ')' ELSE p_type END AS title FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS nth FROM part)",
}
