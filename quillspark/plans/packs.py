"""Queries on fragments, ledgers and plans. Nations stand for fragments, regions for collections; documents for the works in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import packs as P
from ..operators import tagging as G
from ..sources.tables import UNITS_SQL, table, units
from .search import _TAGS, KEYWORDS

RULES = [(1, "west", ["src1", "src2", "src3"], ["en"]), (2, "gallic", ["src3", "src4"], ["fr"]), (3, "rest", [], ["de", "en"])]
HELD = (0, 3, 4, 7, 11, 13)


def _rules(spark):
    return spark.createDataFrame(RULES, "nth int, fragment string, authors array<string>, traditions array<string>")


def _works(spark, sf):
    return units(spark, sf).groupBy("source").agg(F.min("tradition").alias("tradition")).withColumn("author", F.col("source"))


def fragment_assign(spark, sf):
    return P.assign(_works(spark, sf), _rules(spark))


def fragment_stats(spark, sf):
    return P.fragment_stats(units(spark, sf), fragment_assign(spark, sf))


def catalogue_tags(spark, sf):
    return P.tag_totals(G.unit_tags(units(spark, sf), KEYWORDS, G.SCAN), fragment_assign(spark, sf))


def id_ledger(spark, sf):
    return P.ledger(units(spark, sf))


def id_space_check(spark, sf):
    """Against a build without src19, in which src1 was elsewhere and src2 said something else."""
    now = P.ledger(units(spark, sf))
    before = now.where("source <> 'src19' AND source <> 'src5'").select("source", F.when(F.col("source") == "src1", F.col("min") + 1).otherwise(F.col("min")).alias("min"), "max", "count", F.when(F.col("source") == "src2", "0").otherwise(F.col("hash")).alias("hash"))
    return P.id_faults(before, now)


def _fragments(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("fragment"), F.col("n_regionkey").alias("collection"), F.md5("n_name").alias("sha256"), (F.length("n_name") * 1000).cast("long").alias("bytes"))


def _members(spark, sf):
    """A fragment is in the collection of its region and in that of the next."""
    f = _fragments(spark, sf)
    return f.select("collection", "fragment").union(f.where("fragment % 3 = 0").select((F.col("collection") + 1) % 5, "fragment"))


def _held(spark, sf):
    return _fragments(spark, sf).where(F.col("fragment").isin(*HELD)).select("fragment", F.when(F.col("fragment") == 4, None).when(F.col("fragment") == 7, "old").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("fragment") == 13, "other").otherwise("m").alias("model"))


def install_plan(spark, sf):
    wanted = _fragments(spark, sf).select("fragment", "sha256", F.when(F.col("fragment") % 10 == 9, 2).otherwise(1).alias("id_space"), F.lit("m").alias("model"))
    return P.install_plan(wanted, _held(spark, sf), 1)


def uninstall_plan(spark, sf):
    return P.uninstall_plan(_members(spark, sf), F.col("collection") == 2)


def bytes_to_install(spark, sf):
    return P.bytes_to_install(_members(spark, sf), _fragments(spark, sf).select("fragment", "bytes"), _held(spark, sf))


def dedup_savings(spark, sf):
    return P.savings(_members(spark, sf), _fragments(spark, sf).select("fragment", "bytes"))


def collections_available(spark, sf):
    return P.available(_members(spark, sf), _held(spark, sf))


def coverage_suggest(spark, sf):
    tags = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("fragment"), F.concat(F.lit("t"), F.col("s_suppkey") % 4).alias("slug")).groupBy("fragment", "slug").agg(F.count("*").alias("n"))
    return P.covers_subject(tags, _members(spark, sf), _held(spark, sf)).select("slug", "collection", "n", F.round("missing", 6).alias("missing"))


def refresh_diff(spark, sf):
    """An old edition without src3, with less of src4, more of src6 and another src7."""
    new = units(spark, sf)
    old = new.where("source <> 'src3' AND NOT (source = 'src4' AND unit_id % 3 = 0)").withColumn("content", F.when(F.col("source") == "src7", "x").otherwise(F.col("content")))
    more = new.where("source = 'src6'").withColumn("sequence", F.col("sequence") + 1_000_000)
    return P.refresh(old.unionByName(more), new)


def supersede_load(spark, sf):
    held = table(spark, sf, "nation").select(F.col("n_name").alias("title"), F.col("n_regionkey").alias("edition"))
    return P.supersede(held, held.where("edition = 1").withColumn("edition", F.lit(9)), table(spark, sf, "nation").where("n_nationkey < 4").select(F.col("n_name").alias("title")))


def relabel(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("u"), "n_nationkey")).alias("source_url"))
    labels = table(spark, sf, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("title"), F.concat(F.lit("http://x/"), "n_nationkey").alias("source_url"))
    return P.relabelled(rows, labels)


def prune_cascade(spark, sf):
    u = units(spark, sf)
    chunks = C.chunk(u)
    kept = P.doomed_cascade(u.where("source IN ('src1', 'src2')").select("source").distinct(), u, chunks, chunks.select("chunk_id"))
    return kept["units"].groupBy("source").agg(F.count("*").alias("n"))


def prune_guard(spark, sf):
    s = units(spark, sf).select("source").distinct()
    must = spark.createDataFrame([("src0",), ("src1",), ("src77",)], "source string")
    return P.violations(s.where("source LIKE 'src1%'"), s, must, 12)


QUERIES = {f.__name__: f for f in (fragment_assign, fragment_stats, catalogue_tags, id_ledger, id_space_check, install_plan, uninstall_plan, bytes_to_install, dedup_savings, collections_available, coverage_suggest, refresh_diff, supersede_load, relabel, prune_cascade, prune_guard)}

_U = "WITH " + UNITS_SQL
_HELD = ", ".join(map(str, HELD))
_ASSIGN = "frag AS (SELECT source, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'west' WHEN source = 'src4' THEN 'gallic' WHEN min(tradition) = 'en' THEN 'west' WHEN min(tradition) = 'fr' THEN 'gallic' WHEN min(tradition) = 'de' THEN 'rest' ELSE 'core' END AS fragment FROM units GROUP BY source)"
_LEDGER = "led AS (SELECT source, min(unit_id) AS min, max(unit_id) AS max, count(*) AS count, substr(sha256(sum(('0x' || substr(sha256(sequence || chr(31) || unit_id || chr(31) || content), 1, 15))::BIGINT)::VARCHAR), 1, 16) AS hash FROM units GROUP BY source)"
_PACK = f"""fr AS (SELECT n_nationkey AS fragment, n_regionkey AS collection, md5(n_name) AS sha256, length(n_name) * 1000 AS bytes FROM nation),
mem AS (SELECT collection, fragment FROM fr UNION ALL SELECT (collection + 1) % 5, fragment FROM fr WHERE fragment % 3 = 0),
held AS (SELECT fragment, CASE WHEN fragment = 4 THEN NULL WHEN fragment = 7 THEN 'old' ELSE sha256 END AS sha256, CASE WHEN fragment = 13 THEN 'other' ELSE 'm' END AS model FROM fr WHERE fragment IN ({_HELD})),
av AS (SELECT collection, bool_and(fragment IN ({_HELD})) AS available FROM mem GROUP BY collection)"""

SQL = {
    "fragment_assign": f"{_U}, {_ASSIGN} SELECT source, fragment FROM frag",
    "fragment_stats": f"{_U}, {_ASSIGN} SELECT fragment, count(DISTINCT source) AS sources, count(*) AS units, sum(length(content))::BIGINT AS chars FROM units JOIN frag USING (source) GROUP BY fragment",
    "catalogue_tags": f"{_U}, {_ASSIGN}, {_TAGS} SELECT fragment, slug, count(*) AS n FROM tags JOIN units USING (unit_id) JOIN frag USING (source) GROUP BY fragment, slug",
    "id_ledger": f"{_U}, {_LEDGER} SELECT * FROM led",
    "id_space_check": f"""{_U}, {_LEDGER}, before AS (SELECT source, CASE WHEN source = 'src1' THEN min + 1 ELSE min END AS min, max, count, CASE WHEN source = 'src2' THEN '0' ELSE hash END AS hash FROM led WHERE source NOT IN ('src19', 'src5'))
SELECT * FROM (SELECT n.source, CASE WHEN b.source IS NULL THEN CASE WHEN n.min <= mark THEN 'occupied' END WHEN n.min = b.min AND n.max = b.max AND n.count = b.count THEN CASE WHEN n.hash <> b.hash THEN 'rewritten' END
  WHEN n.hash = b.hash THEN CASE WHEN n.min <= mark THEN 'moved' END WHEN n.min <= mark THEN 'occupied' END AS fault FROM led n LEFT JOIN before b USING (source), (SELECT max(max) AS mark FROM before)) WHERE fault IS NOT NULL""",
    "install_plan": f"WITH {_PACK} SELECT fr.fragment, CASE WHEN fr.fragment % 10 = 9 THEN 'refuse' WHEN held.fragment IS NULL THEN 'install' WHEN held.model <> 'm' THEN 'refuse' WHEN held.sha256 = fr.sha256 THEN 'keep' ELSE 'replace' END AS action FROM fr LEFT JOIN held USING (fragment)",
    "uninstall_plan": f"WITH {_PACK} SELECT fragment FROM mem GROUP BY fragment HAVING bool_and(collection = 2)",
    "bytes_to_install": f"WITH {_PACK} SELECT collection, coalesce(sum(bytes) FILTER (fragment NOT IN ({_HELD})), 0)::BIGINT AS bytes FROM (SELECT DISTINCT mem.collection, fragment, bytes FROM mem JOIN fr USING (fragment)) GROUP BY collection",
    "dedup_savings": f"WITH {_PACK} SELECT (SELECT sum(bytes) FROM mem JOIN fr USING (fragment))::BIGINT AS standalone, sum(bytes)::BIGINT AS published FROM fr",
    "collections_available": f"WITH {_PACK} SELECT * FROM av",
    "coverage_suggest": f"""WITH {_PACK}, tags AS (SELECT s_nationkey AS fragment, 't' || s_suppkey % 4 AS slug, count(*) AS n FROM supplier GROUP BY ALL),
mis AS (SELECT slug, sum(CASE WHEN fragment IN ({_HELD}) THEN 0 ELSE n END) / sum(n) AS missing FROM tags GROUP BY slug HAVING missing >= 0.5)
SELECT slug, collection, n, round(missing, 6) AS missing FROM (SELECT slug, collection, sum(n)::BIGINT AS n FROM mem JOIN av USING (collection) JOIN tags USING (fragment) WHERE NOT available GROUP BY ALL) JOIN mis USING (slug) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n DESC, collection) = 1""",
    "refresh_diff": f"{_U} SELECT source, CASE WHEN source = 'src3' THEN 'absent' WHEN source = 'src4' AND bool_or(unit_id % 3 = 0) THEN 'changed' WHEN source = 'src6' THEN 'shrunk' WHEN source = 'src7' THEN 'changed' ELSE 'unchanged' END AS state FROM units GROUP BY source",
    "supersede_load": "SELECT n_name AS title, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS edition FROM nation WHERE n_regionkey = 1 OR n_nationkey >= 4",
    "relabel": "SELECT n_name AS title, CASE WHEN n_nationkey % 3 = 1 THEN 'u' || n_nationkey WHEN n_nationkey < 12 THEN 'http://x/' || n_nationkey WHEN n_nationkey % 3 = 0 THEN '' END AS source_url FROM nation",
    "prune_cascade": f"{_U} SELECT source, count(*) AS n FROM units WHERE source NOT IN ('src1', 'src2') GROUP BY source",
    "prune_guard": "SELECT * FROM (VALUES ('count is 11'), ('would lose src1'), ('not there: src77')) AS t(why)",
}
