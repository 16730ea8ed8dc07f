"""Queries on works: sections of known forms, gates, the catalogue, shelves. Line items stand for numbered text where documents have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..operators import audit as A
from ..operators import catalogue as C
from ..operators import library as L
from ..operators import packs as P
from ..operators import parsers as R
from ..operators import state as S
from ..sources.tables import UNITS_SQL, table, units
from ..streaming.tokens import until_cancelled
from .audit import _GRAMS, _witnesses
from .curation import _CUT, _thousands
from .packs import _ASSIGN, fragment_assign
from .streams import SQL as _STREAMS
from .streams import _VERSIONS, _chunks


def _numbered(spark, sf, line):
    """A text for each order, from its lines in order: line(n, part)."""
    rows = table(spark, sf, "lineitem").where("l_quantity < 45").groupBy(F.col("l_orderkey").alias("work")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x, i: line(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), (2 * i + 1).cast("string"))), "")
    return rows.select("work", F.concat(F.lit("A preface\n\n"), body).alias("text"))


def _sermons(spark, sf):
    return R.sections(_numbered(spark, sf, lambda n, part, _: F.concat(F.lit("  Sermon "), n, F.lit("  On part "), part, F.lit("\n\nText of\n"), part, F.lit(".\n\n"))), R.FORMS["sermons"])


def form_sections(spark, sf):
    return _sermons(spark, sf)


def form_report(spark, sf):
    """All orders as works: some lack numbers, some have one twice, some have no text at all."""
    return R.report(_sermons(spark, sf), R.FORMS["sermons"], table(spark, sf, "orders").select(F.col("o_orderkey").alias("work")))


def catechism_answers(spark, sf):
    """Numbered points within an answer are no questions."""
    texts = _numbered(spark, sf, lambda n, part, k: F.concat(k, F.lit(". What of "), part, F.lit("? It is\nno "), part, F.lit(".\n1. A point.\n")))
    found = R.sections(texts, R.FORMS["numbered_catechism"]).withColumn("qa", R.asked(F.col("body")))
    return found.select("work", "nth", "number", "qa.question", "qa.answer")


def work_hubs(spark, sf):
    part = table(spark, sf, "part")
    page = F.concat(F.lit("http://x/"), F.col("p_brand"), F.lit(".html"))
    link = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("http://x/"), "p_brand", F.lit("/"), "p_type")).otherwise(F.concat(F.lit("http://y/"), "p_type"))
    return R.hubs(part.select(page.alias("page"), link.alias("link")))


def divisible_works(spark, sf):
    texts = _numbered(spark, sf, lambda n, part, _: F.concat(F.lit("Sermon "), n, F.lit("\n"), part, F.lit("\n")))
    return R.divisible(texts, R.sections(texts, R.FORMS["sermons"]))


def substantial_works(spark, sf):
    return R.substantial(units(spark, sf), r"\.\n")


def length_floors(spark, sf):
    u = units(spark, sf)
    return u.groupBy("source").agg(*(F.count_if(R.long_enough(F.col("content"), k)).alias(k) for k in R.FLOORS))


def contents_works(spark, sf):
    found = A.contents_works(units(spark, sf))
    return found.select("source", F.round("markers", 6).alias("markers"), F.round("sentences", 6).alias("sentences"), "suspect")


def unexpanded_works(spark, sf):
    hubs = table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("source"), (F.col("n_nationkey") * 371 % 9000).cast("int").alias("parts"))
    return A.unexpanded(hubs, units(spark, sf), hubs.where("source IN ('src3', 'src7')").select("source"))


def corroborated_works(spark, sf):
    u, w = units(spark, sf), _witnesses(spark, sf)
    whole = A.union_coverage(u, w).select("unit_id", F.round(F.col("known") / F.col("pairs"), 6).alias("whole"))
    scores = A.best_witness(A.containment(u, w).withColumn("containment", F.round("containment", 6))).join(whole, "unit_id").join(u.select("unit_id", "source"), "unit_id")
    return A.corroborated(scores, "source", "edition").select("source", "n", "failing", F.round("median", 6).alias("median"), "ok")


def negative_control(spark, sf):
    return A.control_holds(A.containment(units(spark, sf), _witnesses(spark, sf)).withColumn("containment", F.round("containment", 6)), "commentary")


def vocabulary_share(spark, sf):
    return A.vocabulary_share(units(spark, sf), table(spark, sf, "benchmark"))


def title_bodies(spark, sf):
    """Sentences stand for blocks."""
    found = T.title_and_body(F.regexp_replace("content", r"[.] ", "\n\n"))
    return units(spark, sf).select("unit_id", found["title"].alias("title"), F.md5(found["body"]).alias("body_md5"))


_MEMBERS = [("c1", "west"), ("c1", "gallic"), ("c2", "rest"), ("c2", "west"), ("c3", "none")]


def _cards(spark, sf):
    works = units(spark, sf).groupBy("source").agg(F.min("tradition").alias("tradition"))
    nth = F.substring("source", 4, 9).try_cast("int")
    author = F.when(nth % 3 == 0, "").otherwise(F.concat(F.lit("Writer "), (nth % 4).cast("string")))
    works = works.select(
        "source", F.concat(F.lit("Work "), "source").alias("title"), author.alias("author"), F.when(nth % 2 == 0, "1600").alias("date_composed"), F.lit("").alias("source_url"), F.lit("public domain").alias("license"),
        F.concat(F.lit("Rights: Public | From X | kept "), "source").alias("notes"), F.when(nth % 5 != 0, F.col("tradition")).alias("tradition"), F.lit(None).cast("string").alias("source_type"),
    )
    return C.cards(works, units(spark, sf), fragment_assign(spark, sf), _members(spark))


def _members(spark):
    return spark.createDataFrame(_MEMBERS, "collection string, fragment string")


def catalogue_cards(spark, sf):
    c = _cards(spark, sf)
    return c.select("source", "title", "author", "dates", "tradition", "type", "n_units", "n_chars", "url", "fragment", "bundled", F.array_join("collections", ",").alias("collections"), F.md5("excerpt").alias("excerpt_md5"), "rights", F.array_join("notes", ";").alias("notes"))


def catalogue_totals(spark, sf):
    return C.totals(_cards(spark, sf))


def collection_sizes(spark, sf):
    return C.collection_sizes(_cards(spark, sf), _members(spark).select("collection").distinct())


def merged_catalogues(spark, sf):
    c = _cards(spark, sf)
    tags = c.groupBy("fragment", F.concat(F.lit("from-"), F.lower("tradition")).alias("slug")).agg(F.count("*").alias("n"))
    names, sums = C.merged(C.contents(c), tags, _members(spark))
    return names.groupBy("collection", "kind").agg(F.count("*").alias("n")).unionByName(sums.withColumnRenamed("slug", "kind"))


def core_tables(spark, sf):
    u, chunks = units(spark, sf), _thousands(spark, sf)
    works = u.select("source").distinct()
    out = P.core(works.where("source IN ('src1', 'src4', 'src9')"), works, u, chunks, chunks.where("chunk_id % 3 = 0").select("chunk_id"), u.select("unit_id"))
    whole = None
    for name, key in (("sources", "source"), ("units", "unit_id"), ("chunks", "chunk_id"), ("vectors", "chunk_id"), ("tags", "unit_id")):
        one = out[name].agg(F.count("*").alias("n"), F.max(key).cast("string").alias("last")).withColumn("name", F.lit(name))
        whole = one if whole is None else whole.unionByName(one)
    return whole


def collapsed_shelf(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 50 == 0, "close_all").when(F.col("event_id") % 50 == 25, "open_all").otherwise("toggle")
    events = e.select("user_id", F.col("event_id").alias("at"), kind.alias("kind"), F.concat(F.lit("t"), F.col("event_id") % 5).alias("tradition"))
    users = e.select("user_id").union(table(spark, sf, "customer").select("c_custkey"))
    return S.collapsed(users, events, ["t0", "t1", "t2", "t3"]).select("user_id", "arranged", F.array_join("collapsed", ",").alias("collapsed"))


def opened_sections(spark, sf):
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select(
        k.alias("request"), F.concat(F.lit("src"), k % 25).alias("source"), F.when(k % 4 == 0, k % 500).alias("wanted"),
        F.when(k % 4 == 1, k % 700 - 100).cast("int").alias("at"), F.when(k % 4 == 2, 3).alias("resume"),
    )
    return L.opened(units(spark, sf), asked)


def last_headings(spark, sf):
    return L.last_seen(units(spark, sf).select("source", "tradition", "unit_id", "title"), ["source", "tradition"], "unit_id")


def library_groups(spark, sf):
    """Kinds of collections in the order in which a library shows them."""
    kinds = ("ECONOMY", "STANDARD", "LARGE")
    of = F.element_at(F.split("p_type", " "), 1)
    return table(spark, sf, "part").select("p_partkey", L.kind_place(of, *kinds).cast("int").alias("place"))


def cancelled_streams(spark, sf):
    shown = _chunks(spark, sf, F.col("text")).select("stream_id", "seq", F.col("chunk").alias("text"))
    cancels = table(spark, sf, "conversations").where("turn % 3 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.lit(2).cast("long").alias("seq"))
    return until_cancelled(shown, cancels).select("stream_id", F.md5("text").alias("md5"), "cancelled")


_URL = "concat(CASE WHEN p_partkey % 4 = 1 THEN 'http' ELSE 'https' END, '://x.org/a')"


def release_check(spark, sf):
    """Manifests with odd versions, insecure addresses, downloads without a size."""
    file = F.struct(F.lit("download").alias("kind"), F.expr(_URL).alias("url"), (F.col("p_size") % 3).cast("long").alias("bytes"), F.upper(F.sha2("p_name", 256)).alias("sha256"))
    other = F.struct(F.when(F.col("p_partkey") % 6 == 0, "store").otherwise("torrent").alias("kind"), F.lit("https://store.org/b").alias("url"), F.lit(None).cast("long").alias("bytes"), F.lit("none").alias("sha256"))
    doc = F.to_json(F.struct(F.expr(_VERSIONS).alias("version"), F.lit(" ").alias("notes"), F.create_map(F.lit("mac"), file, F.lit("web"), other).alias("platforms")))
    r = table(spark, sf, "part").select("p_partkey", dates.release(doc).alias("r"))
    return r.select("p_partkey", "r.version", F.array_join(F.array_sort(F.map_keys("r.platforms")), ",").alias("platforms"), F.col("r.platforms").getItem("mac")["sha256"].alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        form_sections, form_report, catechism_answers, work_hubs, divisible_works, substantial_works, length_floors, contents_works, unexpanded_works, corroborated_works, negative_control, vocabulary_share, title_bodies,
        catalogue_cards, catalogue_totals, collection_sizes, merged_catalogues, core_tables, collapsed_shelf, opened_sections, last_headings, library_groups, cancelled_streams, release_check,
    )
}

_U = "WITH " + UNITS_SQL
_LINES = "lines AS (SELECT l_orderkey AS work, l_linenumber AS number, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT AS nth FROM lineitem WHERE l_quantity < 45)"
_WORDS = lambda x: rf"list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower({x}), '-\s*\n\s*(?:[a-z]\s*\n\s*)?', '', 'g'), '[’'']', '', 'g'), '[a-z]+'), lambda x: length(x) >= 2))"
_FLAT = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_HEADS = lambda x: rf"length({x}) <= 90 AND (regexp_matches({x}, '{T.SPACED}') OR regexp_matches({x}, '{T.HEADING_WORDS}') OR length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g')) > 0.9 * length(regexp_replace({x}, '[^\pL]', '', 'g')) OR NOT regexp_matches({x}, '[.?!,;:]$'))"
_NAMED = lambda x: rf"regexp_replace(CASE WHEN regexp_matches({_FLAT(x)}, '{T.SPACED}') THEN upper({x}[1]) || lower(replace({_FLAT(x)}[2:], ' ', '')) ELSE {_FLAT(x)} END, '\.+$', '')"
_CARDS = f"""{_U}, {_ASSIGN}, ex AS ({_STREAMS["work_excerpts"]}), wk AS (SELECT source, min(tradition) AS tradition, count(*) AS n_units, sum(length(content))::BIGINT AS n_chars, try_cast(substr(source, 4, 9) AS INT) AS k FROM units GROUP BY source),
cards AS (SELECT source, 'Work ' || source AS title, CASE WHEN k % 3 = 0 THEN 'Anonymous' ELSE 'Writer ' || (k % 4) END AS author, CASE WHEN k % 2 = 0 THEN '1600' END AS dates, CASE WHEN k % 5 <> 0 THEN tradition ELSE 'Unattributed' END AS tradition, 'Text' AS type, n_units, n_chars,
  NULL::VARCHAR AS url, fragment, fragment = 'core' AS bundled, CASE fragment WHEN 'west' THEN 'c1,c2' WHEN 'gallic' THEN 'c1' WHEN 'rest' THEN 'c2' ELSE '' END AS collections, md5(excerpt) AS excerpt_md5, 'Public' AS rights, 'kept ' || source AS notes FROM wk JOIN frag USING (source) JOIN ex USING (source)),
mem AS (SELECT * FROM (VALUES ('c1', 'west'), ('c1', 'gallic'), ('c2', 'rest'), ('c2', 'west'), ('c3', 'none')) m(collection, fragment))"""

SQL = {
    "form_sections": rf"""WITH {_LINES}, texts AS (SELECT work, 'A preface' || chr(10) || chr(10) || string_agg('  Sermon ' || number || '  On part ' || part || chr(10) || chr(10) || 'Text of' || chr(10) || part || '.' || chr(10) || chr(10), '' ORDER BY nth) AS text FROM lines GROUP BY work),
p AS (SELECT work, unnest(string_split(regexp_replace(text, '(?m)^([ \t]*Sermon[ \t]+\d+\b.*)$', chr(1) || '\1', 'g'), chr(1))) AS raw, generate_subscripts(string_split(regexp_replace(text, '(?m)^([ \t]*Sermon[ \t]+\d+\b.*)$', chr(1) || '\1', 'g'), chr(1)), 1) - 1 AS nth FROM texts)
SELECT work, nth::INT AS nth, regexp_extract(raw, '^[ \t]*Sermon[ \t]+(\d+)', 1)::INT AS number, regexp_extract(raw, '^[ \t]*Sermon[ \t]+(\d+)', 1) AS printed, trim(regexp_extract(raw, '^[ \t]*Sermon[ \t]+\d+\b(.*)', 1)) AS title, trim(regexp_replace(raw, '^.*', ''), ' ' || chr(10)) AS body FROM p WHERE nth > 0""",
    "form_report": f"""WITH {_LINES}, g AS (SELECT o_orderkey AS work, count(number) AS n, count(DISTINCT number) AS numbers, coalesce(max(number), 0) AS last FROM orders LEFT JOIN lines ON work = o_orderkey GROUP BY o_orderkey)
SELECT work, 'numbers run without a gap' AS "check", last AS expected, numbers AS actual, n > 0 AND numbers = last AS ok FROM g UNION ALL SELECT work, 'no number twice', n, numbers, n > 0 AND n = numbers FROM g UNION ALL SELECT work, 'no section too short', 0, 0, n > 0 FROM g UNION ALL SELECT work, 'sections', 141, n, n = 141 FROM g""",
    "catechism_answers": f"WITH {_LINES} SELECT work, nth, 2 * nth - 1 AS number, 'What of ' || part || '?' AS question, 'It is' || chr(10) || 'no ' || part || '.' || chr(10) || '1. A point.' AS answer FROM lines",
    "work_hubs": "SELECT 'http://x/' || p_brand || '.html' AS page, count(DISTINCT p_type) AS parts FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand HAVING count(DISTINCT p_type) >= 2",
    "divisible_works": f"WITH {_LINES} SELECT work, count(*) >= 3 AND sum(length(part::VARCHAR)) >= 0.6 * (11 + sum(length(part::VARCHAR) + length(number::VARCHAR) + 9)) AS by_sections FROM lines GROUP BY work",
    "substantial_works": rf"""{_U}, g AS (SELECT source, count(*) AS units, sum(length(content))::BIGINT AS chars, sum(len(string_split(content, '.' || chr(10))) - 1) AS images FROM units GROUP BY source)
SELECT source, units, chars, CASE WHEN units < 3 THEN 'too few units' WHEN chars < 20000 THEN 'too short' WHEN images * 1000.0::DOUBLE / chars > 1.0 THEN 'page images' END AS why FROM g""",
    "length_floors": f"{_U} SELECT source, " + ", ".join(f"count(*) FILTER (length(content) >= {n}) AS {k}" for k, n in R.FLOORS.items()) + " FROM units GROUP BY source",
    "contents_works": rf"""{_U}, j AS (SELECT source, string_agg(content, ' ' ORDER BY unit_id) AS t FROM units GROUP BY source), d AS (SELECT source, len(regexp_extract_all(t, '{A.MARKER}')) * 1000.0::DOUBLE / length(t) AS m, len(regexp_extract_all(t, '{A.SENTENCE}')) * 1000.0::DOUBLE / length(t) AS s FROM j)
SELECT source, round(m, 6) AS markers, round(s, 6) AS sentences, m >= {A.MARKERS_PER_1K} AND s < {A.SENTENCES_PER_1K} AS suspect FROM d""",
    "unexpanded_works": f"""{_U}, h AS (SELECT 'src' || n_nationkey AS source, (n_nationkey * 371 % 9000)::INT AS parts FROM nation), c AS (SELECT source, count(*) AS units FROM units GROUP BY source)
SELECT * FROM (SELECT source, parts, coalesce(units, 0) AS units, CASE WHEN source IN ('src3', 'src7') THEN 'withheld' WHEN units IS NULL THEN 'absent' WHEN parts >= 2 AND units < greatest(2, parts / 2) THEN 'short' END AS state FROM h LEFT JOIN c USING (source)) WHERE state IS NOT NULL""",
    "corroborated_works": f"""{_GRAMS}, w AS (SELECT unit_id, round(count(k.gram) / count(*), 6) AS whole FROM ug LEFT JOIN (SELECT DISTINCT gram FROM wg) k USING (gram) GROUP BY unit_id)
SELECT source, count(*) AS n, count(*) FILTER (NOT (containment >= 0.75 OR whole >= 0.9)) AS failing, round(median(containment), 6) AS median, count(*) FILTER (NOT (containment >= 0.75 OR whole >= 0.9)) = 0 AS ok FROM best JOIN w USING (unit_id) JOIN units USING (unit_id) GROUP BY source""",
    "negative_control": f"{_GRAMS} SELECT max(containment) AS highest, coalesce(max(containment) < 0.55, false) AS ok FROM con",
    "vocabulary_share": f"{_U}, k AS (SELECT DISTINCT unnest({_WORDS('text')}) AS word FROM benchmark) SELECT unit_id, count(*) AS words, count(k.word) AS known FROM (SELECT unit_id, unnest({_WORDS('content')}) AS word FROM units) u LEFT JOIN k USING (word) GROUP BY unit_id",
    "title_bodies": rf"""{_U}, b AS (SELECT unit_id, list_filter(string_split_regex(trim(replace(content, '. ', chr(10) || chr(10)), chr(10)), '\n\s*\n'), lambda x: regexp_matches(x, '\S')) AS b FROM units),
h AS (SELECT *, CASE WHEN len(b) > 1 AND {_HEADS(_FLAT("b[1]"))} THEN CASE WHEN len(b) > 2 AND {_HEADS(_FLAT("b[2]"))} THEN 2 ELSE 1 END ELSE 0 END AS n FROM b)
SELECT unit_id, array_to_string(list_filter(list_transform(b[1:n], lambda x: {_NAMED("x")}), lambda x: x <> ''), ' — ') AS title, md5(array_to_string(b[n + 1:], chr(10) || chr(10))) AS body_md5 FROM h""",
    "catalogue_cards": f"{_CARDS} SELECT * FROM cards",
    "catalogue_totals": f"{_CARDS} SELECT count(*) AS n_sources, sum(n_units)::BIGINT AS n_units, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT author) AS n_authors, count(DISTINCT tradition) AS n_traditions FROM cards",
    "collection_sizes": f"{_CARDS} SELECT collection, count(source) AS n_sources FROM mem LEFT JOIN cards USING (fragment) GROUP BY collection",
    "merged_catalogues": f"""{_CARDS}, c AS (SELECT * FROM cards JOIN mem USING (fragment)) SELECT collection, 'author' AS kind, count(DISTINCT author) AS n FROM c GROUP BY collection UNION ALL SELECT collection, 'title', count(DISTINCT title) FROM c GROUP BY collection
UNION ALL SELECT collection, 'tradition', count(DISTINCT tradition) FROM c GROUP BY collection UNION ALL SELECT collection, 'from-' || lower(tradition), count(*) FROM c GROUP BY ALL""",
    "core_tables": f"""{_U}, {_CUT}, own AS (SELECT * FROM units WHERE source IN ('src1', 'src4', 'src9')), c AS (SELECT * FROM cut WHERE unit_id IN (SELECT unit_id FROM own))
SELECT 'sources' AS name, count(DISTINCT source) AS n, max(source) AS last FROM own UNION ALL SELECT 'units', count(*), max(unit_id)::VARCHAR FROM own UNION ALL SELECT 'tags', count(*), max(unit_id)::VARCHAR FROM own UNION ALL SELECT 'chunks', count(*), max(chunk_id)::BIGINT::VARCHAR FROM c UNION ALL SELECT 'vectors', count(*), max(chunk_id)::BIGINT::VARCHAR FROM c WHERE chunk_id % 3 = 0""",
    "collapsed_shelf": """WITH e AS (SELECT user_id, event_id AS t_at, CASE WHEN event_id % 50 = 0 THEN 'close_all' WHEN event_id % 50 = 25 THEN 'open_all' ELSE 'toggle' END AS kind, 't' || event_id % 5 AS tradition FROM events),
r AS (SELECT user_id, max(t_at) AS reset_at, arg_max(kind, t_at) = 'close_all' AS closed FROM e WHERE kind <> 'toggle' GROUP BY user_id),
p AS (SELECT user_id, tradition, count(*) AS n FROM e LEFT JOIN r USING (user_id) WHERE kind = 'toggle' AND (reset_at IS NULL OR t_at > reset_at) GROUP BY ALL)
SELECT user_id, user_id IN (SELECT user_id FROM e) AS arranged, coalesce(string_agg(tradition, ',' ORDER BY tradition) FILTER (coalesce(closed, true) <> (coalesce(n, 0) % 2 = 1)), '') AS collapsed
FROM (SELECT user_id FROM e UNION SELECT c_custkey FROM customer) u CROSS JOIN (VALUES ('t0'), ('t1'), ('t2'), ('t3')) t(tradition) LEFT JOIN r USING (user_id) LEFT JOIN p USING (user_id, tradition) GROUP BY user_id""",
    "opened_sections": f"""{_U}, o AS (SELECT source, unit_id, row_number() OVER w - 1 AS place, coalesce(lag(unit_id) OVER w, -1) AS previous, coalesce(lead(unit_id) OVER w, -1) AS next, count(*) OVER (PARTITION BY source) AS n FROM units WINDOW w AS (PARTITION BY source ORDER BY sequence, unit_id)),
q AS (SELECT c_custkey AS request, 'src' || c_custkey % 25 AS source, CASE c_custkey % 4 WHEN 0 THEN (SELECT place FROM o WHERE o.source = 'src' || c_custkey % 25 AND o.unit_id = c_custkey % 500) WHEN 1 THEN c_custkey % 700 - 100 WHEN 2 THEN 3 END AS wished FROM customer)
SELECT request, place::INT AS place, unit_id, previous, next FROM q JOIN o ON o.source = q.source AND place = greatest(0, least(coalesce(wished, 0), n - 1))""",
    "last_headings": f"{_U} SELECT source, tradition, max(unit_id) AS unit_id, arg_max(title, unit_id) AS title FROM units GROUP BY ALL",
    "library_groups": "SELECT p_partkey, CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'LARGE' THEN 3 ELSE 4 END AS place FROM part",
    "cancelled_streams": "SELECT conv_id || '-' || turn AS stream_id, md5(CASE WHEN turn % 3 = 0 THEN substr(text, 1, 14) ELSE text END) AS md5, turn % 3 = 0 AS cancelled FROM conversations",
    "release_check": rf"""WITH v AS (SELECT p_partkey, p_name, p_partkey % 4 <> 1 AND p_size % 3 > 0 AS mac, p_partkey % 6 = 0 AS web, {_VERSIONS.replace("STRING", "VARCHAR")} AS v FROM part)
SELECT p_partkey, CASE WHEN ok THEN v END AS version, CASE WHEN ok THEN concat_ws(',', CASE WHEN mac THEN 'mac' END, CASE WHEN web THEN 'web' END) END AS platforms, CASE WHEN ok AND mac THEN sha256(p_name) END AS sha256 FROM (SELECT *, NOT contains(v, 'x') AND (mac OR web) AS ok FROM v)""",
}
