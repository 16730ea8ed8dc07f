"""Queries on the way from a work's text to its units. A conversation stands for a printed work: a header, a page of contents, a section for each turn; SQL builds the same text and parses it by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carving as C
from ..operators.parsers import Form
from ..sources.tables import spread, table
from .works import _WORDS

#: A line of contents is shorter than 40 characters; the editor's preface behind it is longer.
PRINTED = C.Collection(Form(r"^Turn (\d+)\. ([^\n]*)", gap=40, run=3), target=600)
WITNESSED = C.Collection(PRINTED.form, rights=None, min_units=2)
_PREFACE = "A preface of the editor, which is longer than forty characters."


def _works(spark, sf):
    """Every fifth work has headings that the form does not know; every eleventh states no right, others of three kinds."""
    turns = spread(table(spark, sf, "conversations")).select(F.col("conv_id").alias("work"), F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    each = turns.groupBy("work").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    word = F.when(F.col("work") % 5 == 0, "Part ").otherwise("Turn ")
    head = lambda t: F.concat(word, t["turn"] + 1, F.lit(". "), t["role"], F.lit("\n"))
    said = F.when(F.col("work") % 3 == 0, "Copyright 1999").when(F.col("work") % 3 == 1, "Public Domain").otherwise("This is in the public domain.")
    right = F.when(F.col("work") % 11 == 0, "").otherwise(F.concat(F.lit("Rights: "), said))
    contents = F.array_join(F.transform("ts", head), "")
    body = F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["text"], F.lit("\n\n"))), "")
    return each.select("work", F.concat(F.lit("A work\n"), right, F.lit("\n\n"), contents, F.lit(_PREFACE + "\n\n"), body).alias("text"))


def carved_units(spark, sf):
    """Sections, or paragraphs packed where a work has too few."""
    return C.carve(_works(spark, sf), PRINTED).select("work", "nth", "number", "title", F.md5("body").alias("body_md5"), F.length("body").alias("chars"), "how")


def carved_works(spark, sf):
    """What became of every work."""
    texts = _works(spark, sf)
    return C.verdicts(texts, PRINTED, C.carve(texts, PRINTED))


def witnessed_works(spark, sf):
    """Works of which no right is asked; documents are the witnesses."""
    texts = _works(spark, sf)
    units = C.carve(texts, WITNESSED)
    return C.verdicts(texts, WITNESSED, units, C.backed(units, table(spark, sf, "documents").select("text")))


QUERIES = {f.__name__: f for f in (carved_units, carved_works, witnessed_works)}

_HEAD = "CASE WHEN conv_id % 5 = 0 THEN 'Part ' ELSE 'Turn ' END || (turn + 1) || '. ' || role || chr(10)"
_TRIM = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
_TEXTS = f"""texts AS (
  SELECT conv_id AS work, 'A work' || chr(10) || CASE WHEN conv_id % 11 = 0 THEN '' WHEN conv_id % 3 = 0 THEN 'Rights: Copyright 1999' WHEN conv_id % 3 = 1 THEN 'Rights: Public Domain' ELSE 'Rights: This is in the public domain.' END || chr(10) || chr(10)
    || string_agg({_HEAD}, '' ORDER BY turn, role, text) || '{_PREFACE}' || chr(10) || chr(10) || string_agg({_HEAD} || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn, role, text) AS text
  FROM conversations GROUP BY conv_id
), told AS (SELECT *, trim(regexp_extract(substr(text, 1, {C.HEADER}), 'Rights:[ \\t]*([^\\n]+)', 1)) AS said FROM texts)"""
_SECTIONS = lambda free, least: rf"""{_TEXTS}, free AS (SELECT work, text FROM told WHERE {free}),
cut AS (SELECT work, string_split(regexp_replace(text, '(?m)^(Turn \d+\. )', chr(1) || '\1', 'g'), chr(1)) AS p FROM free),
heads AS (SELECT * FROM (SELECT work, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM cut) WHERE regexp_matches(raw, '^Turn \d+\. ')),
near AS (SELECT *, coalesce(lag(length(raw)) OVER (PARTITION BY work ORDER BY pos) < 40, false) AS near FROM heads),
runs AS (SELECT *, sum((NOT near)::INT) OVER (PARTITION BY work ORDER BY pos) AS run FROM near),
kept AS (SELECT work, raw, pos, CASE WHEN count(*) OVER (PARTITION BY work, run) < 3 THEN pos END AS own FROM runs),
held AS (SELECT work, raw, pos, last_value(own IGNORE NULLS) OVER (PARTITION BY work ORDER BY pos) AS own FROM kept),
joined AS (SELECT work, own, string_agg(raw, '' ORDER BY pos) AS raw FROM held WHERE own IS NOT NULL GROUP BY ALL),
sections AS (SELECT work, own, regexp_extract(raw, '^Turn (\d+)\. ', 1)::INT AS number, trim(regexp_replace(regexp_extract(raw, '^Turn \d+\. ([^\n]*)', 1), '\s+', ' ', 'g')) AS title, {_TRIM(r"regexp_replace(raw, '^Turn \d+\. [^\n]*', '')")} AS body FROM joined),
long AS (SELECT * FROM sections WHERE length(body) >= 60 QUALIFY count(*) OVER (PARTITION BY work) >= {least}),
divided AS (SELECT work, row_number() OVER (PARTITION BY work ORDER BY own)::INT AS nth, number, title, body, 'sections' AS how FROM long)"""  # noqa: E731
_ALL = rf"""WITH RECURSIVE {_SECTIONS("contains(lower(said), 'public domain')", 3)},
split AS (SELECT work, string_split_regex(text, '\n\s*\n') AS p FROM free WHERE work NOT IN (SELECT work FROM long)),
paras AS (SELECT work, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS raw, pos FROM (SELECT work, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM split)),
numbered AS (SELECT work, raw, row_number() OVER (PARTITION BY work ORDER BY pos) AS k FROM paras WHERE length(raw) >= 2),
packed AS (SELECT work, k, raw, 1 AS nth, length(raw) AS size FROM numbered WHERE k = 1 UNION ALL
  SELECT n.work, n.k, n.raw, CASE WHEN p.size >= 600 THEN p.nth + 1 ELSE p.nth END, CASE WHEN p.size >= 600 THEN 0 ELSE p.size END + length(n.raw) FROM packed p JOIN numbered n ON n.work = p.work AND n.k = p.k + 1),
units AS (SELECT * FROM divided UNION ALL SELECT work, nth, nth, 'part ' || nth, string_agg(raw, chr(10) || chr(10) ORDER BY k), 'paragraphs' FROM packed GROUP BY work, nth)"""
_VERDICT = lambda why, more="": f"SELECT work, count(u.work) AS units, coalesce(sum(length(body)), 0)::BIGINT AS chars, min(how) AS how, {why} AS why FROM told LEFT JOIN {{units}} u USING (work) {more} GROUP BY work, said"

SQL = {
    "carved_units": f"{_ALL} SELECT work, nth, number, title, md5(body) AS body_md5, length(body)::INT AS chars, how FROM units",
    "carved_works": f"{_ALL} "
    + _VERDICT("CASE WHEN NOT contains(lower(said), 'public domain') THEN 'rights: ' || CASE WHEN said = '' THEN 'absent' ELSE said END WHEN count(u.work) = 0 THEN 'too few units' END").format(units="units"),
    "witnessed_works": f"""WITH {_SECTIONS("true", 2)}, k AS (SELECT DISTINCT unnest({_WORDS("text")}) AS word FROM documents), own AS (SELECT work, nth, {_WORDS("body")} AS words FROM divided),
lows AS (SELECT work, min(coalesce(share, 0)) AS lowest FROM own LEFT JOIN (SELECT work, nth, count(k.word) / count(*) AS share FROM (SELECT work, nth, unnest(words) AS word FROM own) LEFT JOIN k USING (word) GROUP BY ALL) USING (work, nth) GROUP BY work)
{_VERDICT(f"CASE WHEN count(u.work) = 0 THEN 'too few units' WHEN coalesce(min(lowest), 0) < {C.KNOWN} THEN 'not known to witnesses' END", "LEFT JOIN lows USING (work)").format(units="divided")}""",
}
