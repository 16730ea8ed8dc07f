"""Queries on texts of several levels and on endnotes. Orders and line items stand for the chapters and paragraphs of a customer's work; SQL builds the same text and parses it by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import endnotes as E
from ..operators import nested as N
from ..sources.tables import table


def _acts(spark, sf):
    """A confession for each customer: an order is a chapter, its lines are paragraphs, of which some are lost, doubled or unnumbered."""
    lines = table(spark, sf, "lineitem").where("l_quantity < 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    number = lambda x: F.when(x["l_linenumber"] % 2 == 0, F.concat(F.lit("'''"), x["l_linenumber"], F.lit("'''"))).otherwise(x["l_linenumber"].cast("string"))
    words = lambda x: F.concat(F.lit("\nOf part "), x["l_partkey"], F.lit(", of which more is said\nthan forty characters.\n\n"))
    head = lambda x, i: F.when((i == 0) & (F.col("o_orderkey") % 2 == 0) & (x["l_linenumber"] == 1), "").otherwise(number(x))
    own = F.array_join(F.transform("l", lambda x, i: F.concat(head(x, i), words(x))), "")
    orders = table(spark, sf, "orders").join(lines, "o_orderkey").select("o_custkey", F.struct("o_orderkey", "o_orderpriority", own.alias("body")).alias("o"))
    chapter = lambda o, i: F.concat(F.lit("{{c|{{larger|{{sc|Chap. "), F.lower(T.int_to_roman(i + 1)), F.lit(". Of "), o["o_orderpriority"], F.lit("}}}}}}\n"), o["body"])
    each = orders.groupBy(F.col("o_custkey").alias("work")).agg(F.array_sort(F.collect_list("o")).alias("os"))
    end = F.when(F.col("work") % 7 != 0, "{{PD-UKGov}} tail").otherwise("[[Category:x]]")
    return each.select("work", F.concat(F.lit("The Act\n7\n"), F.array_join(F.transform("os", chapter), ""), end).alias("text"))


def nested_sections(spark, sf):
    """Chapters and paragraphs, the chapter's number carried down."""
    return N.sections(_acts(spark, sf), N.FORMS["westminster"]).select("work", "level", "chapter", "paragraph", "title", "body")


def nested_report(spark, sf):
    """What each work lacks, chapter by chapter."""
    texts = _acts(spark, sf)
    return N.report(N.sections(texts, N.FORMS["westminster"]), N.FORMS["westminster"], texts)


def _pages(spark, sf):
    """A page for each customer: an order is an article, its lines are marks; notes are the numbers up to a bound."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"))
    body = F.concat(F.lit('<p class="main_body">Of order <i>'), "o_orderkey", F.lit("</i>"), F.array_join(F.transform("l", lambda n: F.concat(F.lit(' and<a href="#n">'), n, F.lit("</a>"))), ""), F.lit(" see 1 Tim. 6:16</p>"))
    orders = table(spark, sf, "orders").join(lines, "o_orderkey").select(F.col("o_custkey").alias("work"), F.struct("o_orderkey", body.alias("body")).alias("o"))
    each = orders.groupBy("work").agg(F.array_sort(F.collect_list("o")).alias("os"))
    numeral = lambda i: T.int_to_roman(F.when((F.col("work") % 5 == 0) & (i == 1), 9).otherwise(i + 1))
    articles = F.array_join(F.transform("os", lambda o, i: F.concat(F.lit('<p class="main_body">'), numeral(i), F.lit(".</p>"), o["body"])), "")
    notes = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("work") % 4 + 2).cast("int")), lambda n: F.concat(F.lit('<a name="n">['), n, F.lit("]</a> Proof "), n)), " ")
    return each.select("work", F.concat(articles, F.lit('<p class="main_body">NOTES: '), notes, F.lit("</p>")).alias("html"))


def endnote_proofs(spark, sf):
    """Articles with the notes that their marks point at."""
    return E.articles(E.page_paragraphs(_pages(spark, sf)))


def endnote_report(spark, sf):
    return E.report(E.page_paragraphs(_pages(spark, sf)), table(spark, sf, "customer").select(F.col("c_custkey").alias("work")), 10, 4, {2: "IX"}, 40)


QUERIES = {f.__name__: f for f in (nested_sections, nested_report, endnote_proofs, endnote_report)}

_ROMAN = "list_transform(range(1, 100), lambda n: ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1])"
_HEAD, _PARAGRAPH = r"\{\{c\|\{\{larger\|\{\{sc\|Chap\.\s*([ivxl]+)\.\s*(.*?)\}\}\}\}\}\}", r"[ \t]*(?:\x27\x27\x27)?(\d+)(?:\x27\x27\x27)?[ \t]*"
_TRIM = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
_ACTS = rf"""li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nth FROM lineitem WHERE l_quantity < 45),
ob AS (SELECT l_orderkey, string_agg(CASE WHEN nth = 1 AND l_orderkey % 2 = 0 AND l_linenumber = 1 THEN '' WHEN l_linenumber % 2 = 0 THEN repeat(chr(39), 3) || l_linenumber || repeat(chr(39), 3) ELSE l_linenumber::VARCHAR END
  || chr(10) || 'Of part ' || l_partkey || ', of which more is said' || chr(10) || 'than forty characters.' || chr(10) || chr(10), '' ORDER BY nth) AS body FROM li GROUP BY l_orderkey),
oc AS (SELECT o_custkey AS work, o_orderkey, o_orderpriority, body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders JOIN ob ON l_orderkey = o_orderkey),
acts AS (SELECT work, 'The Act' || chr(10) || '7' || chr(10) || string_agg('{{{{c|{{{{larger|{{{{sc|Chap. ' || lower(({_ROMAN})[nth]) || '. Of ' || o_orderpriority || '}}}}}}}}}}}}' || chr(10) || body, '' ORDER BY nth) || CASE WHEN work % 7 <> 0 THEN '{{{{PD-UKGov}}}} tail' ELSE '[[Category:x]]' END AS text FROM oc GROUP BY work),
cut AS (SELECT work, string_split(regexp_replace(text, '(?m)({_HEAD}|^{_PARAGRAPH}$)', chr(1) || '\1', 'g'), chr(1)) AS p FROM acts),
pieces AS (SELECT work, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM cut),
told AS (SELECT work, pos, raw, regexp_matches(raw, '^{_HEAD}') AS head, regexp_matches(raw, '(?m)\A{_PARAGRAPH}$') AS para FROM pieces),
own AS (SELECT work, pos, head, CASE WHEN head THEN list_position({_ROMAN}, upper(regexp_extract(raw, '^{_HEAD}', 1))) END AS chapter, CASE WHEN para THEN regexp_extract(raw, '^{_PARAGRAPH}', 1)::INT END AS paragraph,
  CASE WHEN head THEN regexp_extract(raw, '^{_HEAD}', 2) ELSE '' END AS title, {_TRIM(rf"string_split_regex(regexp_replace(raw, CASE WHEN head THEN '^{_HEAD}' ELSE '^{_PARAGRAPH}' END, ''), '\{{\{{PD-|\[\[Category:')[1]")} AS body FROM told WHERE head OR para),
held AS (SELECT *, last_value(chapter IGNORE NULLS) OVER (PARTITION BY work ORDER BY pos) AS c FROM own),
found AS (SELECT work, 'chapter' AS level, c AS chapter, NULL::INT AS paragraph, title, '' AS body FROM held WHERE head UNION ALL SELECT work, 'paragraph', c, CASE WHEN head THEN 1 ELSE paragraph END, '', body FROM held WHERE c IS NOT NULL AND (NOT head OR body <> ''))"""
_CHILDREN = ", ".join(f"({path[0]}, {n})" for path, n in N.FORMS["westminster"].children.items())
_GAPS = lambda numbers: rf"array_to_string(list_transform(list_filter(range(1, list_max({numbers})), lambda k: NOT list_contains({numbers}, k) AND (k = 1 OR list_contains({numbers}, k - 1))), lambda a: CASE WHEN list_contains({numbers}, a + 1) THEN a::VARCHAR ELSE a || '–' || (list_min(list_filter({numbers}, lambda m: m > a)) - 1) END), ', ')"
_PAGES = rf"""lb AS (SELECT l_orderkey, string_agg(' and<a href="#n">' || l_linenumber || '</a>', '' ORDER BY l_linenumber) AS l FROM lineitem GROUP BY l_orderkey),
oc AS (SELECT o_custkey AS work, '<p class="main_body">Of order <i>' || o_orderkey || '</i>' || l || ' see 1 Tim. 6:16</p>' AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders JOIN lb ON l_orderkey = o_orderkey),
pages AS (SELECT work, string_agg('<p class="main_body">' || ({_ROMAN})[CASE WHEN work % 5 = 0 AND nth = 2 THEN 9 ELSE nth END] || '.</p>' || body, '' ORDER BY nth) || '<p class="main_body">NOTES: '
  || array_to_string(list_transform(range(1, work % 4 + 3), lambda n: '<a name="n">[' || n || ']</a> Proof ' || n), ' ') || '</p>' AS html FROM oc GROUP BY work),
pl AS (SELECT work, regexp_extract_all(html, '<p[^>]*class="main_body"[^>]*>(.*?)</p>', 1) AS p FROM pages),
ps AS (SELECT work, pos, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '<a[^>]*>.*?</a>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM (SELECT work, unnest(p) AS html, generate_subscripts(p, 1) AS pos FROM pl)),
hd AS (SELECT *, regexp_matches(plain, '^[IVXL]+\.?$') AS head, starts_with(plain, 'NOTES') AS notes FROM ps),
pn AS (SELECT *, sum(head::INT) OVER (PARTITION BY work ORDER BY pos)::INT AS nth FROM hd),
mk AS (SELECT work, nth, pos, unnest(regexp_extract_all(html, '<a[^>]*>(\d+)</a>', 1))::INT AS number, unnest(range(len(regexp_extract_all(html, '<a[^>]*>(\d+)</a>', 1)))) AS place FROM pn WHERE NOT head AND NOT notes),
nt AS (SELECT work, regexp_extract(raw, '^(\d+)', 1)::INT AS number, trim(regexp_replace(regexp_replace(raw, '^\d+\]</a>', ''), '\s+', ' ', 'g')) AS note FROM (SELECT work, unnest(string_split_regex(html, '<a[^>]*>\[')[2:]) AS raw FROM pn WHERE notes)),
art AS (SELECT h.work, h.nth, replace(h.plain, '.', '') AS printed, coalesce(b.text, '') AS text, coalesce(p.proofs, '') AS proofs FROM pn h LEFT JOIN (SELECT work, nth, string_agg(plain, ' ' ORDER BY pos) AS text FROM pn WHERE NOT head AND NOT notes GROUP BY ALL) b USING (work, nth)
  LEFT JOIN (SELECT work, nth, string_agg(note, '; ' ORDER BY pos, place) AS proofs FROM mk JOIN nt USING (work, number) GROUP BY ALL) p USING (work, nth) WHERE h.head)"""

SQL = {
    "nested_sections": f"WITH {_ACTS} SELECT work, level, chapter::INT AS chapter, paragraph, title, body FROM found",
    "nested_report": rf"""WITH {_ACTS}, want(chapter, wanted) AS (VALUES {_CHILDREN}),
cs AS (SELECT work, list(DISTINCT chapter)::BIGINT[] AS n FROM found GROUP BY work), kids AS (SELECT work, chapter, list(DISTINCT paragraph)::BIGINT[] AS n FROM found WHERE level = 'paragraph' GROUP BY ALL),
leaf AS (SELECT work, chapter || '.' || paragraph AS path, count(*) AS n, min(length(body)) AS short FROM found WHERE level = 'paragraph' GROUP BY ALL)
SELECT work, 'chapters in all' AS "check", '' AS section, 33::BIGINT AS expected, coalesce(len(n), 0) AS actual, '' AS missing, coalesce(len(n), 0) = 33 AS ok FROM acts LEFT JOIN cs USING (work)
UNION ALL SELECT work, 'chapters run without a gap', '', list_max(n), len(n), {_GAPS("n")}, list_max(n) = len(n) FROM cs
UNION ALL SELECT work, 'paragraphs run without a gap', chapter::VARCHAR, list_max(n), len(n), {_GAPS("n")}, list_max(n) = len(n) FROM kids
UNION ALL SELECT work, 'paragraphs of the section', chapter::VARCHAR, wanted, coalesce(len(n), 0), '', coalesce(len(n), 0) = wanted FROM (SELECT work, chapter, wanted FROM acts, want) LEFT JOIN kids USING (work, chapter)
UNION ALL SELECT work, 'every section has a number', '', 0, 0, '', true FROM acts
UNION ALL SELECT work, 'no paragraph twice', '', 0, count(path) FILTER (n > 1), coalesce(string_agg(path, ', ' ORDER BY path) FILTER (n > 1), ''), count(path) > 0 AND count(path) FILTER (n > 1) = 0 FROM acts LEFT JOIN leaf USING (work) GROUP BY work
UNION ALL SELECT work, 'no paragraph too short', '', 0, count(path) FILTER (short < 40), coalesce(string_agg(path, ', ' ORDER BY path) FILTER (short < 40), ''), count(path) > 0 AND count(path) FILTER (short < 40) = 0 FROM acts LEFT JOIN leaf USING (work) GROUP BY work
UNION ALL SELECT work, 'the text says', '\{{\{{PD-UKGov\}}\}}', 1, contains(text, 'PD-UKGov')::INT, '', contains(text, 'PD-UKGov') FROM acts""",
    "endnote_proofs": f"WITH {_PAGES} SELECT work, nth, printed, text, proofs FROM art",
    "endnote_report": f"""WITH {_PAGES}, shape AS (SELECT work, count(*) AS n, list(nth ORDER BY nth) FILTER (printed <> CASE WHEN nth = 2 THEN 'IX' ELSE ({_ROMAN})[nth] END) AS nums, list(nth ORDER BY nth) FILTER (length(text) < 40) AS texts FROM art GROUP BY work),
met AS (SELECT work, number, m, n FROM (SELECT work, number, count(*) AS m FROM mk GROUP BY ALL) FULL JOIN (SELECT work, number, count(*) AS n FROM nt GROUP BY ALL) USING (work, number)),
pairs AS (SELECT work, count(*) FILTER (n > 0) AS numbers, list(number ORDER BY number) FILTER (m IS NULL) AS unmarked, list(number ORDER BY number) FILTER (n IS NULL) AS unfounded, list(number ORDER BY number) FILTER (m > 1 OR n > 1) AS twice FROM met GROUP BY work),
e AS (SELECT c_custkey AS work, s.* EXCLUDE (work), p.* EXCLUDE (work) FROM customer LEFT JOIN shape s ON s.work = c_custkey LEFT JOIN pairs p ON p.work = c_custkey),
lists AS (SELECT work, n, unnest(['numerals in sequence', 'no article without a text', 'every note has a mark', 'every mark has a note', 'no number twice']) AS "check", unnest([nums, texts, unmarked, unfounded, twice]) AS odd FROM e)
SELECT work, 'articles' AS "check", 10::BIGINT AS expected, coalesce(n, 0) AS actual, '' AS odd, coalesce(n = 10, false) AS ok FROM e UNION ALL SELECT work, 'notes', 4, coalesce(numbers, 0), '', coalesce(numbers = 4, false) FROM e
UNION ALL SELECT work, "check", 0, coalesce(len(odd), 0), coalesce(array_to_string(odd, ', '), ''), n IS NOT NULL AND coalesce(len(odd), 0) = 0 FROM lists""",
}
