"""Queries on the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import library as L
from ..sources.tables import UNITS_SQL, table, units

NEEDLE = "the this"
#: Notes of several shapes, in SQL that both engines read.
_NOTES = """concat_ws(' | ', 'Translated by ' || p_name, CASE WHEN p_partkey % 2 = 0 THEN 'Print basis:  ' || p_type END,
  CASE p_partkey % 5 WHEN 0 THEN 'Nicene and Post-Nicene Fathers , Vol. ' || CAST(p_size AS STRING) WHEN 1 THEN 'Public-domain translation, ' || CAST(1800 + p_size AS STRING) WHEN 2 THEN '' WHEN 3 THEN 'From ' || p_type END,
  CASE WHEN p_partkey % 7 = 0 THEN 'Rights: Public  Domain' END, CASE WHEN p_partkey % 3 = 0 THEN 'Corroborated against ' || p_brand END, 'Ingested from ' || p_brand)"""


def library_stats(spark, sf):
    return L.stats(units(spark, sf))


def source_shelf(spark, sf):
    return L.shelf(units(spark, sf)).orderBy("source")


def nation_shelf(spark, sf):
    """Suppliers stand for units, nations for sources: a source without units counts 0."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_name").alias("content"))
    return L.with_totals(table(spark, sf, "nation").select(F.col("n_nationkey").alias("source"), "n_name"), suppliers)


def content_for_source(spark, sf):
    return units(spark, sf).where("source = 'src3'").select("unit_id", "sequence", F.length("content").alias("n")).orderBy("sequence", "unit_id")


def dimension_scan(spark, sf):
    return table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name").orderBy("n_name")


def _sources(spark, sf):
    nations = table(spark, sf, "nation")
    return nations.select(F.concat(F.lit("src"), "n_nationkey").alias("source"), F.col("n_name").alias("source_title"), F.when(F.col("n_nationkey") % 3 == 0, "public domain").alias("license")).where("n_nationkey < 15")


def citation_lookup(spark, sf):
    """What every passage is cited as, whether its source is known or not."""
    return L.citations(units(spark, sf), _sources(spark, sf)).withColumn("label", L.prompt_label(F.col("source_title"), F.col("license"), F.col("tradition")))


def opening_units(spark, sf):
    return L.openings(units(spark, sf)).select("source", "place", "unit_id", "title")


def section_pages(spark, sf):
    return L.neighbours(units(spark, sf))


def like_fallback(spark, sf):
    return L.like(units(spark, sf), NEEDLE, 40).select("unit_id", "source", "tradition")


def shelf_filter(spark, sf):
    return L.containing(units(spark, sf), "SRC1", "source", "tradition").groupBy("source").count().withColumnRenamed("count", "n")


def contents_stems(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.concat_ws(" ", F.col("p_type"), F.col("p_size").cast("string")).alias("title"))
    return L.stems(parts)


def part_slugs(spark, sf):
    """Some titles end in the number that another's slug would get."""
    title = F.when(F.col("p_partkey") % 50 == 7, F.concat_ws(" ", F.col("p_type"), F.lit("2"))).otherwise(F.col("p_type"))
    return L.slugs(table(spark, sf, "part").select("p_partkey", title.alias("title")), "p_partkey", F.col("title"))


def works_by_date(spark, sf):
    """Parts of one brand stand for works of a type, sizes for dates as text; every fourth is undated."""
    works = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("source_type"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string")).alias("date_composed"))
    return L.of_dimension(works, "source_type", "Brand#13")


def works_listing(spark, sf):
    """The listing's order, as places."""
    works = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("author"), F.col("p_name").alias("title"))
    return L.listing(works, "author", "title", "p_partkey").limit(100).select("p_partkey", "author", "title")


def citation_json(spark, sf):
    """Citations to JSON and back."""
    u = units(spark, sf)
    made = u.select("unit_id", L.citation_json(F.col("unit_id"), F.col("source"), F.nullif(F.col("tradition"), F.lit("fr")), F.col("tradition"), F.lit(None).cast("string")).alias("json"))
    back = made.withColumn("c", L.citation_of(F.col("json")))
    return back.select("unit_id", "json", F.col("c.contentId").alias("content_id"), F.col("c.author").alias("author"), F.col("c.sourceUrl").alias("url"))


def id_assignment(spark, sf):
    return L.numbered(table(spark, sf, "supplier"), 5000, "s_nationkey", ["s_suppkey"]).select("s_suppkey", "new_id")


def prompt_context(spark, sf):
    df = units(spark, sf)
    return df.select("unit_id", F.md5(L.context(F.col("content"), 6000, 6)).alias("context_md5"), F.md5(text.truncated(F.col("content"), 1500, "… [passage truncated]")).alias("passage_md5"), L.thread_title(F.col("content")).alias("title"))


def notes_fields(spark, sf):
    part = table(spark, sf, "part")
    n = L.parse_notes(F.expr(_NOTES))
    return part.select("p_partkey", n["translator"].alias("translator"), n["edition"].alias("edition"), n["rights"].alias("rights"), n["source"].alias("origin"), n["corroboration"].alias("corroboration"), F.array_join(n["extra"], ";").alias("extra"))


def relative_dates(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", dates.when_label(F.col("ts"), F.lit("2024-01-20 12:00:00").cast("timestamp")).alias("label"))


def numerals(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 3999 + 1).alias("n"))
    roman = text.int_to_roman(F.col("n"))
    return parts.select("p_partkey", roman.alias("roman"), text.roman_to_int(roman).alias("back"))


def byte_labels(spark, sf):
    return units(spark, sf).select("unit_id", text.byte_label(F.octet_length("content").cast("long") * 37).alias("label"))


QUERIES = {f.__name__: f for f in (library_stats, source_shelf, nation_shelf, content_for_source, dimension_scan, citation_lookup, opening_units, section_pages, like_fallback, shelf_filter, contents_stems, part_slugs, id_assignment, prompt_context, notes_fields, works_by_date, works_listing, citation_json, relative_dates, numerals, byte_labels)}

_W = "WITH " + UNITS_SQL
SQL = {
    "library_stats": f"{_W} SELECT count(*) AS n_units, count(DISTINCT source) AS n_sources, count(DISTINCT tradition) AS n_traditions, sum(length(content))::BIGINT AS n_chars FROM units",
    "source_shelf": f"{_W} SELECT source, count(*) AS n_units, sum(length(content))::BIGINT AS n_chars FROM units GROUP BY source",
    "nation_shelf": "SELECT n_nationkey AS source, n_name, count(s_suppkey) AS n_units, coalesce(sum(length(s_name)), 0)::BIGINT AS n_chars FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL",
    "content_for_source": f"{_W} SELECT unit_id, sequence, length(content) AS n FROM units WHERE source = 'src3'",
    "dimension_scan": "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "citation_lookup": f"""{_W}, sources AS (SELECT 'src' || n_nationkey AS source, n_name AS source_title, CASE WHEN n_nationkey % 3 = 0 THEN 'public domain' END AS license FROM nation WHERE n_nationkey < 15)
SELECT unit_id, title, coalesce(source_title, '(none)') AS source_title, coalesce(tradition, 'Other') AS tradition, coalesce(license, '') AS license, concat_ws(' — ', coalesce(source_title, '(none)'), license, coalesce(tradition, 'Other')) AS label
FROM units LEFT JOIN sources USING (source)""",
    "opening_units": f"{_W} SELECT source, place, unit_id, title FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sequence, unit_id) AS place FROM units) WHERE place <= 3",
    "section_pages": f"{_W} SELECT unit_id, coalesce(lag(unit_id) OVER w, -1) AS previous, coalesce(lead(unit_id) OVER w, -1) AS next FROM units WINDOW w AS (PARTITION BY source ORDER BY sequence, unit_id)",
    "like_fallback": f"{_W} SELECT unit_id, source, tradition FROM units WHERE contains(lower(content), '{NEEDLE}') ORDER BY sequence, unit_id LIMIT 40",
    "shelf_filter": f"{_W} SELECT source, count(*) AS n FROM units WHERE contains(lower(concat_ws(' ', source, tradition)), 'src1') GROUP BY source",
    "contents_stems": r"SELECT *, n_titles > 30 AND n_stems <= 0.5 * n_titles AS grouped FROM (SELECT p_brand AS source, count(*) AS n_titles, count(DISTINCT regexp_replace(p_type || ' ' || p_size, '\s+\d+\s*$', '')) AS n_stems FROM part GROUP BY p_brand)",
    "part_slugs": """WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey, coalesce(nullif(substr(trim(regexp_replace(lower(CASE WHEN p_partkey % 50 = 7 THEN p_type || ' 2' ELSE p_type END), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''), 'source') AS base FROM part),
t AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS p_partkey, ''::VARCHAR AS slug, []::VARCHAR[] AS taken
  UNION ALL SELECT i, p_partkey, s, list_append(taken, s) FROM (SELECT i, p_partkey, taken, CASE WHEN NOT list_contains(taken, base) THEN base ELSE base || '-' || list_min(list_filter(range(2, len(own) + 3), lambda n: NOT list_contains(own, base || '-' || n))) END AS s FROM (SELECT b.i, b.p_partkey, base, taken, list_filter(taken, lambda x: starts_with(x, base)) AS own FROM t JOIN b ON b.i = t.i + 1)))
SELECT p_partkey, slug FROM t WHERE i > 0""",
    "id_assignment": "SELECT s_suppkey, 5000 + row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS new_id FROM supplier",
    "prompt_context": rf"""{_W} SELECT unit_id, md5(CASE WHEN length(content) > 1000 THEN regexp_replace(substr(content, 1, 1000), ' +$', '') || '… [truncated]' ELSE content END) AS context_md5,
  md5(CASE WHEN length(content) <= 1500 THEN content ELSE regexp_replace(CASE WHEN regexp_matches(substr(content, 1, 1500), '\s') AND 1499 - length(regexp_extract(substr(content, 1, 1500), '\s([^\s]*)$', 1)) > 750 THEN substr(content, 1, 1499 - length(regexp_extract(substr(content, 1, 1500), '\s([^\s]*)$', 1))) ELSE substr(content, 1, 1500) END, ' +$', '') || '… [passage truncated]' END) AS passage_md5,
  CASE WHEN length(line) > 80 THEN rtrim(substr(line, 1, 80)) || '…' ELSE line END AS title FROM (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS line FROM units)""",
    "notes_fields": rf"""WITH n AS (SELECT p_partkey, {_NOTES} AS notes FROM part),
p AS (SELECT p_partkey, list_filter(list_transform(string_split(notes, '|'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM n)
SELECT p_partkey, regexp_extract(list_filter(parts, lambda x: x LIKE 'Translated by %')[-1], '^Translated by (.*)$', 1) AS translator,
  list_transform(list_filter(parts, lambda x: x LIKE 'Print basis: %' OR x LIKE '%Nicene Fathers%'), lambda x: CASE WHEN x LIKE 'Print%' THEN x[14:] ELSE replace(x, ' ,', ',') END)[-1] AS edition,
  coalesce(list_filter(parts, lambda x: x LIKE 'Rights: %')[-1][9:], list_filter(parts, lambda x: x LIKE 'Public-domain translation,%')[1]) AS rights,
  list_filter(parts, lambda x: x LIKE 'Ingested from %')[-1][15:] AS origin, list_filter(parts, lambda x: x LIKE 'Corroborated against %')[-1][22:] AS corroboration,
  array_to_string(list_filter(parts, lambda x: x LIKE 'From %'), ';') AS extra FROM p""",
    "works_by_date": "SELECT p_partkey AS source, p_brand AS source_type, CASE WHEN p_partkey % 4 <> 0 THEN p_size::VARCHAR END AS date_composed FROM part WHERE p_brand = 'Brand#13'",
    "works_listing": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS author, p_name AS title FROM part ORDER BY author NULLS LAST, title, p_partkey LIMIT 100",
    "citation_json": f"""{_W} SELECT unit_id, '{{"contentId":' || unit_id || ',"source":' || coalesce('"' || source || '"', 'null') || ',"author":' || coalesce('"' || nullif(tradition, 'fr') || '"', 'null') || ',"tradition":' || coalesce('"' || tradition || '"', 'null') || ',"sourceUrl":null}}' AS json,
  unit_id AS content_id, nullif(tradition, 'fr') AS author, NULL::VARCHAR AS url FROM units""",
    "relative_dates": """SELECT event_id, CASE WHEN d = 0 THEN (CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END) || ':' || lpad(minute(ts)::VARCHAR, 2, '0') || CASE WHEN hour(ts) < 12 THEN ' am' ELSE ' pm' END
  WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN dayname(ts) WHEN year(ts) = 2024 THEN day(ts) || ' ' || strftime(ts, '%b') ELSE day(ts) || ' ' || strftime(ts, '%b') || ' ' || year(ts) END AS label
FROM (SELECT *, datediff('day', ts::DATE, DATE '2024-01-20') AS d FROM events)""",
    "numerals": """SELECT p_partkey, repeat('M', (n // 1000)::INT) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(n // 100 % 10 + 1)::INT] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n // 10 % 10 + 1)::INT] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][(n % 10 + 1)::INT] AS roman, n::INT AS back FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)""",
    "byte_labels": f"{_W} SELECT unit_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576) WHEN n >= 1024 THEN round(n / 1024)::BIGINT || ' KB' ELSE n || ' B' END AS label FROM (SELECT unit_id, strlen(content) * 37 AS n FROM units)",
}
