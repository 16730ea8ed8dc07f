"""Queries on auditing and corroborating the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..sources.tables import UNITS_SQL, table, units


def _witnesses(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("witness_id"), "text")


def dup_content(spark, sf):
    return A.copies(units(spark, sf))


def provenance_verdict(spark, sf):
    return A.verdicts(units(spark, sf))


def verdict_histogram(spark, sf):
    v = A.verdicts(units(spark, sf))
    return v.groupBy("source").agg(*(F.count_if(F.col("verdict") == name).alias(name) for name in ("primary_text", "summary", "unknown", "boilerplate")))


def reason_histogram(spark, sf):
    v = A.verdicts(units(spark, sf)).where("reasons <> ''")
    return v.select(F.explode(F.split("reasons", "; ")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def generated_sources(spark, sf):
    return A.doomed_sources(A.verdicts(units(spark, sf)), 0.05).select("source", F.round("generated", 6).alias("generated"))


def ngram_repeat(spark, sf):
    return units(spark, sf).select("unit_id", A.most_repeated(F.col("content")).alias("most"))


def marker_density(spark, sf):
    found = A.contents_pages(units(spark, sf))
    return found.select("unit_id", F.round("markers", 6).alias("markers"), F.round("sentences", 6).alias("sentences"), "suspect")


def case_shares(spark, sf):
    return units(spark, sf).select("unit_id", T.display_matter(F.col("content")).alias("display"))


def bigram_containment(spark, sf):
    return A.containment(units(spark, sf), _witnesses(spark, sf)).where("containment >= 0.5").select("unit_id", "witness_id", "shared", F.round("containment", 6).alias("containment"))


def best_witness(spark, sf):
    found = A.containment(units(spark, sf), _witnesses(spark, sf)).withColumn("containment", F.round("containment", 6))
    return A.best_witness(found)


def corroboration_gate(spark, sf):
    found = A.containment(units(spark, sf), _witnesses(spark, sf)).withColumn("containment", F.round("containment", 6))
    best = A.best_witness(found).join(units(spark, sf).select("unit_id", "source"), "unit_id")
    return A.gate(best, "source", 0.02, 0.2).select("source", "n", F.round("median", 6).alias("median"), F.round("worst", 6).alias("worst"), "ok")


def union_coverage(spark, sf):
    return A.union_coverage(units(spark, sf), _witnesses(spark, sf))


def rights_gate(spark, sf):
    part = table(spark, sf, "part")
    statement = F.when(F.col("p_partkey") % 5 == 0, "Public Domain").when(F.col("p_partkey") % 7 == 0, F.col("p_brand"))
    edition = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("London, "), F.lit(1850) + F.col("p_partkey") % 150))
    died = F.when(F.col("p_partkey") % 11 != 0, 1600 + F.col("p_partkey") % 400)
    return part.select("p_partkey", A.rights(statement, edition, F.col("p_size") % 2 == 0, died).alias("why"))


def bylined_works(spark, sf):
    part = table(spark, sf, "part")
    title = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ("), F.col("p_type"), F.lit(")"))).otherwise(""))
    date = F.when(F.col("p_partkey") % 2 == 0, (1800 + F.col("p_partkey") % 250).cast("string"))
    return part.select("p_partkey", A.modern_and_bylined(title, date, F.when(F.col("p_partkey") % 9 == 0, "fair use").otherwise("")).alias("modern"))


QUERIES = {f.__name__: f for f in (dup_content, provenance_verdict, verdict_histogram, reason_histogram, generated_sources, ngram_repeat, marker_density, case_shares, bigram_containment, best_witness, corroboration_gate, union_coverage, rights_gate, bylined_works)}

_U = "WITH " + UNITS_SQL
_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)
_MARKS = ", ".join(f"'{m}'" for m in A.BOILERPLATE_MARKERS)
_WORDS = r"SELECT unit_id, regexp_extract_all(lower(content), '[a-z'']+') AS w, content FROM units"
_RUNS = " UNION ALL ".join(f"SELECT unit_id, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM (SELECT * FROM ws WHERE len(w) >= {n})" for n in (3, 4))
_REPEAT = f"ws AS ({_WORDS}), rep AS (SELECT unit_id, max(c) AS most FROM (SELECT unit_id, n, gram, count(*) AS c FROM ({_RUNS}) GROUP BY ALL) GROUP BY unit_id)"
_VERDICTS = rf"""{_U}, {_REPEAT},
f AS (SELECT unit_id, source, lower(trim(title)) AS t, trim(content) AS c, length(trim(content)) AS n,
    list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP})))) AS tokens,
    len(list_filter([{_MARKS}], lambda m: contains(lower(content), m))) AS markers,
    regexp_matches(trim(title), '{A.TEMPLATE_TITLE}') AS templated,
    len(regexp_extract_all(trim(content), '{A.CHAIN}')) >= {A.CHAINS} AS chain,
    coalesce(most, 0) AS most FROM units LEFT JOIN rep USING (unit_id)),
g AS (SELECT *, len(tokens) > 1 AND len(list_filter(tokens, lambda x: NOT regexp_matches(x, '^[0-9]+$'))) > 1 AS worded,
    count(*) OVER (PARTITION BY source) AS n_units, count(*) OVER (PARTITION BY source, t) AS same_title, count(*) OVER (PARTITION BY source, tokens) AS same_tokens, count(*) OVER (PARTITION BY c) AS copies FROM f),
h AS (SELECT unit_id, source, n_units,
    concat_ws('; ', CASE WHEN t IN ('about this page', 'about this page.', 'footer', 'credits') THEN 'boilerplate title' END, CASE WHEN markers > 0 AND (n < 1200 OR markers > 1) THEN 'boilerplate markers' END) AS bp,
    concat_ws('; ', CASE WHEN templated THEN 'templated title' END, CASE WHEN chain THEN 'relative-clause chain' END, CASE WHEN n > 0 AND n < {A.REPEAT_MOST_LENGTH} AND most >= {A.REPEATS} THEN 'repeated phrase' END,
      CASE WHEN worded AND same_tokens > 1 THEN 'shuffled title' END, CASE WHEN same_title > 1 THEN 'duplicate title' END, CASE WHEN n > 0 AND copies > 1 THEN 'duplicate content' END) AS strong FROM g),
v AS (SELECT unit_id, source, CASE WHEN bp <> '' THEN 'boilerplate' WHEN contains(strong, ';') OR (strong <> '' AND n_units IN (7, 9)) THEN 'summary' WHEN strong <> '' THEN 'unknown' ELSE 'primary_text' END AS verdict, CASE WHEN bp <> '' THEN bp ELSE strong END AS reasons FROM h)"""
_PAIR = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_GRAMS = rf"""{_U}, ug AS (SELECT unit_id, unnest({_PAIR}) AS gram FROM (SELECT unit_id, regexp_extract_all(lower(content), '[a-z]{{2,}}') AS w FROM units)),
wg AS (SELECT item_id AS witness_id, unnest({_PAIR}) AS gram FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM benchmark)),
con AS (SELECT unit_id, witness_id, count(*) AS shared, round(count(*) / any_value(size), 6) AS containment FROM ug JOIN wg USING (gram) JOIN (SELECT witness_id, count(*) AS size FROM wg GROUP BY ALL) USING (witness_id) GROUP BY unit_id, witness_id),
best AS (SELECT * FROM con QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY containment DESC, witness_id) = 1)"""

SQL = {
    "dup_content": f"{_U} SELECT unit_id, count(*) OVER (PARTITION BY trim(content)) AS copies FROM units",
    "provenance_verdict": f"{_VERDICTS} SELECT * FROM v",
    "verdict_histogram": f"{_VERDICTS} SELECT source, count(*) FILTER (verdict = 'primary_text') AS primary_text, count(*) FILTER (verdict = 'summary') AS summary, count(*) FILTER (verdict = 'unknown') AS unknown, count(*) FILTER (verdict = 'boilerplate') AS boilerplate FROM v GROUP BY source",
    "reason_histogram": f"{_VERDICTS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '; ')) AS reason FROM v WHERE reasons <> '') GROUP BY reason",
    "generated_sources": f"{_VERDICTS} SELECT source, round(avg((verdict <> 'primary_text')::INT), 6) AS generated FROM v GROUP BY source HAVING avg((verdict <> 'primary_text')::INT) >= 0.05",
    "ngram_repeat": f"{_U}, {_REPEAT} SELECT unit_id, coalesce(most, 0)::INT AS most FROM units LEFT JOIN rep USING (unit_id)",
    "marker_density": rf"""{_U} SELECT unit_id, round(m, 6) AS markers, round(s, 6) AS sentences, m >= {A.MARKERS_PER_1K} AND s < {A.SENTENCES_PER_1K} AS suspect FROM (SELECT unit_id,
  CASE WHEN content = '' THEN 0 ELSE len(regexp_extract_all(content, '{A.MARKER}')) * 1000.0::DOUBLE / length(content) END AS m, CASE WHEN content = '' THEN 0 ELSE len(regexp_extract_all(content, '{A.SENTENCE}')) * 1000.0::DOUBLE / length(content) END AS s FROM units)""",
    "case_shares": rf"{_U} SELECT unit_id, CASE WHEN length(regexp_replace(content, '[^\pL]', '', 'g')) = 0 THEN true ELSE length(regexp_replace(content, '[^\p{{Ll}}]', '', 'g')) / length(regexp_replace(content, '[^\pL]', '', 'g')) < 0.55 END AS display FROM units",
    "bigram_containment": f"{_GRAMS} SELECT unit_id, witness_id, shared, containment FROM con WHERE containment >= 0.5",
    "best_witness": f"{_GRAMS} SELECT unit_id, witness_id, containment FROM best",
    "corroboration_gate": f"{_GRAMS} SELECT source, count(*) AS n, round(median(containment), 6) AS median, min(containment) AS worst, median(containment) >= 0.2 AND min(containment) >= 0.02 AS ok FROM best JOIN units USING (unit_id) GROUP BY source",
    "union_coverage": f"{_GRAMS} SELECT unit_id, count(*) AS pairs, count(k.gram) AS known FROM ug LEFT JOIN (SELECT DISTINCT gram FROM wg) k USING (gram) GROUP BY unit_id",
    "rights_gate": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'allowed: stated' WHEN p_partkey % 7 = 0 THEN 'refused: other rights' WHEN p_partkey % 3 = 0 AND 1850 + p_partkey % 150 >= 1929 THEN 'refused: modern edition'
  WHEN p_size % 2 <> 0 THEN 'refused: translation of unknown date' WHEN p_partkey % 11 = 0 THEN 'refused: no dates' WHEN 1600 + p_partkey % 400 >= 1929 THEN 'refused: recent author' ELSE 'allowed: old author in English' END AS why FROM part""",
    "bylined_works": r"""SELECT p_partkey, (p_partkey % 9 = 0 OR (p_partkey % 2 = 0 AND 1800 + p_partkey % 250 > 1928)) AND p_partkey % 3 = 0 AND p_type <> '' AND len(string_split_regex(trim(p_type), '\s+')) <= 3 AND NOT regexp_matches(trim(p_type), '^[0-9]+$') AS modern FROM part""",
}
