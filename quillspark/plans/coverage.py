"""Queries on coverage of questions, and on small text functions. Parts stand for works, brands for authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coverage as V
from ..operators import library as L
from ..sources.tables import UNITS_SQL, table, units
from .packs import _held, _members


def coverage_suggestions(spark, sf):
    parts = table(spark, sf, "part")
    fragment = (F.col("p_partkey") % 25).cast("int")
    title = F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string"))
    contents = parts.select(fragment.alias("fragment"), F.lit("author").alias("kind"), F.concat(F.lit("Writer "), F.translate("p_brand", "#", "x")).alias("value")).union(parts.select(fragment, F.lit("title"), title)).union(parts.select(fragment, F.lit("tradition"), F.when(F.col("p_partkey") % 3 == 0, "Baptist").otherwise("Catholic"))).distinct()
    first = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    asked = parts.join(first, ["p_brand", "p_partkey"]).select(F.col("p_partkey").cast("int").alias("qid"), F.concat_ws(" ", F.lit("What do baptists say of"), title).alias("text"))
    tags = parts.groupBy(fragment.alias("fragment"), F.concat(F.lit("size-"), F.col("p_size") % 4).alias("slug")).agg(F.count("*").alias("n"))
    wanted = asked.select("qid", F.concat(F.lit("size-"), F.col("qid") % 4).alias("slug"))
    return V.suggest(asked, contents, _members(spark, sf), _held(spark, sf), tags, wanted)


def title_trigrams(spark, sf):
    part = table(spark, sf, "part")
    runs = T.ngrams(V.significant(F.concat_ws(" of the ", "p_name", "p_type")), 3)
    return part.select("p_partkey", F.explode(runs).alias("run"))


def shelf_order(spark, sf):
    """Pinned works first, then those of one kind, then by name."""
    works = units(spark, sf).select("source").distinct()
    pinned = F.col("source").isin("src7", "src2")
    return L.shelved(works, pinned, F.col("source").endswith("1"), "source")


def shingle_counts(spark, sf):
    """Runs of eight words of each witness."""
    return table(spark, sf, "benchmark").select("item_id", F.size(F.array_distinct(T.ngrams(T.words(F.col("text")), 8))).alias("n"))


_FOOTER = """concat('Text. Translated by S.', CASE WHEN c_custkey % 2 = 0 THEN 'D.F. ' ELSE ' ' END, initcap(c_mktsegment), CASE c_custkey % 3 WHEN 0 THEN concat('. From Fathers, Vol. ', CAST(c_custkey % 9 AS STRING), '. Edited by P. Schaff. (Buffalo, ', CAST(1700 + c_custkey % 200 AS STRING), '.)') WHEN 1 THEN '. Revised by K. Knight.' ELSE '.' END)"""
_PLURAL = "concat('On Letters and ', element_at(array('Orations', 'Lectures', 'Treatises', 'Conferences', 'things', 'Hymns'), CAST(c_custkey % 6 + 1 AS INT)), ' of Men')"


def footers(spark, sf):
    c = table(spark, sf, "customer")
    p = T.provenance_footer(F.expr(_FOOTER))
    return c.select("c_custkey", p["translator"].alias("translator"), p["edition"].alias("edition"), p["year"].alias("year"), T.part_noun(F.expr(_PLURAL)).alias("noun"), T.reference_apparatus(F.concat(F.lit("see http://x.org/"), F.col("c_name"))).alias("links"))


def first_lines(spark, sf):
    return units(spark, sf).select("unit_id", T.headingish(F.col("title")).alias("heading"))


QUERIES = {f.__name__: f for f in (coverage_suggestions, title_trigrams, shelf_order, shingle_counts, footers, first_lines)}

_FILL = ", ".join(f"'{w}'" for w in T.FILLER)
SQL = {
    "title_trigrams": f"SELECT p_partkey, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS run FROM (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' of the ' || p_type), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({_FILL})) AS w FROM part) WHERE len(w) >= 3",
    "shelf_order": f"WITH {UNITS_SQL} SELECT source, CASE WHEN source IN ('src7', 'src2') THEN 0 WHEN ends_with(source, '1') THEN 1 ELSE 2 END AS shelf FROM (SELECT DISTINCT source FROM units)",
    "shingle_counts": "SELECT item_id, len(list_distinct(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' '))))::INT AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)",
    "first_lines": rf"""WITH {UNITS_SQL}, w AS (SELECT unit_id, trim(title) AS t FROM units)
SELECT unit_id, length(t) > 0 AND length(t) <= 90 AND (regexp_matches(t, '{T.SPACED}') OR regexp_matches(t, '{T.HEADING_WORDS}') OR (regexp_matches(t, '\pL') AND length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) > 0.9 * length(regexp_replace(t, '[^\pL]', '', 'g')))) AS heading FROM w""",
    "footers": rf"""WITH t AS (SELECT c_custkey, c_name, {_FOOTER.replace("initcap(c_mktsegment)", "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])").replace("STRING", "VARCHAR")} AS t FROM customer)
SELECT c_custkey, nullif(regexp_extract(t, 'Translated by (.+?)\.(\s+(From|Edited|Revised)\b|\s*$)', 1), '') AS translator, nullif(regexp_extract(t, 'From (.+?)\.(\s*(Edited|Revised)\b|\s*\(|\s*$)', 1), '') AS edition, try_cast(regexp_extract(t, '\b(1[6-9]\d\d)\b', 1) AS INT) AS year,
  ['Oration', 'Lecture', 'Treatise', 'Conference', 'Letter', 'Letter'][c_custkey % 6 + 1] AS noun, (length(c_name) + 13)::DOUBLE / (length(c_name) + 17) > 0.5 AS links FROM t""",
}
