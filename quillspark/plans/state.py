"""Queries on reader state and on passages. Events stand for what readers do, line items for numbered text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import reader as R
from ..operators import segments as G
from ..operators import state as S
from ..sources.tables import UNITS_SQL, table, units


def _highlights(spark, sf, kind):
    """A click or a view stands for an interval of the user's page."""
    e = table(spark, sf, "events").where(F.col("event_type") == kind)
    start = (F.col("event_id") % 997).cast("int")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("unit_id"), start.alias("start"), (start + 1 + F.col("event_id") % 13).cast("int").alias("end"))


def highlight_overlap(spark, sf):
    return S.overlapping(_highlights(spark, sf, "click"), _highlights(spark, sf, "purchase")).select("id", "other_id", "unit_id")


def highlight_write(spark, sf):
    return S.written(_highlights(spark, sf, "click"), _highlights(spark, sf, "purchase"))


def threads(spark, sf):
    found = S.threads(table(spark, sf, "conversations"), 50)
    return found.select("conv_id", "messages", "last_turn", "next_turn", F.md5("last_text").alias("last_md5"), F.md5("first_text").alias("first_md5"))


def _actions(spark, sf):
    item = F.concat(F.when(F.col("event_id") % 2 == 0, "Item ").otherwise("ITEM "), F.floor(F.col("value")).cast("string"))
    return table(spark, sf, "events").select("event_id", "user_id", "ts", item.alias("item"), "event_type")


def mru_list(spark, sf):
    return S.recent(_actions(spark, sf), "user_id", "item", "ts", "event_id", 20).select("user_id", "item", "event_id", "nth")


def toggle_state(spark, sf):
    return S.toggled(_actions(spark, sf), ["user_id", "event_type"])


def bookmarks(spark, sf):
    return S.bookmarks(_actions(spark, sf).where("event_type = 'click'")).select("user_id", "item", "event_id")


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_partkey", "l_quantity")


def verse_ranges(spark, sf):
    return R.ranges(_lines(spark, sf).where("l_quantity < 30"), "l_orderkey", "n")


def verse_quotes(spark, sf):
    chosen = _lines(spark, sf).where("l_quantity < 30").groupBy("l_orderkey", F.col("n").alias("idx")).agg(F.min("l_partkey").cast("string").alias("text"))
    return R.quotes(chosen, "l_orderkey", " ")


def numbering_gaps(spark, sf):
    return R.number_gaps(_lines(spark, sf).where("l_quantity < 40"), "l_orderkey", "n")


def span_ends(spark, sf):
    marks = table(spark, sf, "events").select("event_id", "user_id", F.col("event_id").alias("start"))
    return R.span_ends(marks, "user_id", "start", F.lit(10**9)).select("event_id", "span_end")


def carry_forward(spark, sf):
    c = table(spark, sf, "conversations")
    return R.carried(c, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", F.coalesce("carried", F.lit(-1)).alias("carried"))


def rising_numbers(spark, sf):
    return R.rising(_lines(spark, sf), "l_orderkey", ["n", "l_partkey"], "l_partkey").select("l_orderkey", "n", "l_partkey")


def heading_runs(spark, sf):
    marks = table(spark, sf, "events").select("event_id", "user_id", F.col("event_id").alias("at"))
    return R.without_runs(marks, "user_id", "at", 60, 3).select("event_id")


def part_ordinals(spark, sf):
    return C.ordinal(_lines(spark, sf), "l_orderkey", ["n"]).select("l_orderkey", "n", "nth", "of")


def packed_units(spark, sf):
    """Line items packed into parts of 60 pieces or more."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("size"))
    return C.packed(rows, "l_orderkey", ["n"], "size", 60)


def passage_segments(spark, sf):
    return G.segment(units(spark, sf)).select("unit_id", "idx", "kind", "start", "end", F.coalesce("number", F.lit(-1)).alias("number"))


QUERIES = {f.__name__: f for f in (highlight_overlap, highlight_write, threads, mru_list, toggle_state, bookmarks, verse_ranges, verse_quotes, numbering_gaps, span_ends, carry_forward, rising_numbers, heading_runs, part_ordinals, packed_units, passage_segments)}

_H = "SELECT event_id AS id, user_id AS unit_id, (event_id % 997)::INT AS start, (event_id % 997 + 1 + event_id % 13)::INT AS \"end\" FROM events WHERE event_type = "
_PAIR = f"WITH a AS ({_H} 'click'), b AS ({_H} 'purchase')"
_ACT = "act AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 2 = 0 THEN 'Item ' ELSE 'ITEM ' END || floor(value)::BIGINT AS item, event_type FROM events)"
_ISLANDS = "SELECT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_quantity < 30"

_SEGMENTS = r"""
WITH t AS (SELECT doc_id AS unit_id, coalesce(text, '') AS s FROM documents),
m AS (
  SELECT unit_id, s, len(regexp_extract_all(s, '(?m)^[ \t]*[0-9]{1,3}\.[ \t]+')) >= 2 AS verse,
    len(list_filter(regexp_split_to_array(s, '\n[ \t]*\n+'), lambda x: x <> '')) > 1 AS blank
  FROM t
),
k AS (
  SELECT unit_id, verse, string_split(CASE WHEN verse THEN regexp_replace(s, '(?m)^([ \t]*[0-9]{1,3}\.[ \t]+)', chr(1) || '\1', 'g') WHEN blank THEN regexp_replace(s, '(\n[ \t]*\n+)', '\1' || chr(1), 'g') ELSE regexp_replace(s, '(\n+)', '\1' || chr(1), 'g') END, chr(1)) AS blocks
  FROM m
),
b AS (SELECT unit_id, verse, unnest(blocks) AS raw, generate_subscripts(blocks, 1) AS i FROM k),
l AS (SELECT *, NOT verse AND length(regexp_replace(raw, '^\s+|\s+$', '', 'g')) > 700 AS long FROM b),
c AS (SELECT unit_id, verse, i, long, string_split(CASE WHEN long THEN regexp_replace(raw, '([.!?][")\]]?\s+)(["“A-Z(\[])', '\1' || chr(1) || '\2', 'g') ELSE raw END, chr(1)) AS cuts FROM l),
p AS (SELECT unit_id, verse, i, bool_or(long) OVER (PARTITION BY unit_id) AS split, cuts FROM c),
q AS (SELECT unit_id, verse, split, i, unnest(cuts) AS raw, generate_subscripts(cuts, 1) AS j FROM p),
r AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY unit_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos, regexp_extract(raw, '^[ \t]*([0-9]{1,3})\.[ \t]+', 1) AS number, regexp_replace(raw, '\s+$', '') AS own FROM q)
SELECT unit_id, (row_number() OVER (PARTITION BY unit_id ORDER BY i, j) - 1)::INT AS idx, CASE WHEN verse THEN 'verse' WHEN split THEN 'sentence' ELSE 'paragraph' END AS kind,
  (pos + CASE WHEN verse THEN 0 ELSE length(own) - length(regexp_replace(own, '^\s+', '')) END)::INT AS start, (pos + length(own))::INT AS "end", CASE WHEN verse AND number <> '' THEN number::INT ELSE -1 END AS number
FROM r WHERE regexp_replace(CASE WHEN verse THEN regexp_replace(raw, '^[ \t]*[0-9]{1,3}\.[ \t]+', '') ELSE raw END, '\s+', '', 'g') <> ''
"""

SQL = {
    "passage_segments": _SEGMENTS,
    "highlight_overlap": f'{_PAIR} SELECT a.id, b.id AS other_id, unit_id FROM a JOIN b USING (unit_id) WHERE a.start < b."end" AND b.start < a."end"',
    "highlight_write": f'{_PAIR} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.unit_id = a.unit_id AND a.start < b."end" AND b.start < a."end") UNION ALL SELECT * FROM b',
    "threads": "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, max(turn) + 1 AS next_turn, md5(arg_max(text, turn)) AS last_md5, md5(arg_min(text, turn)) AS first_md5 FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC LIMIT 50",
    "mru_list": f"WITH {_ACT} SELECT user_id, item, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS nth FROM (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY user_id, lower(item) ORDER BY ts DESC, event_id DESC) = 1)) WHERE nth <= 20",
    "toggle_state": f"WITH {_ACT} SELECT user_id, event_type FROM act GROUP BY ALL HAVING count(*) % 2 = 1",
    "bookmarks": f"WITH {_ACT} SELECT user_id, item, event_id FROM act WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) = 1",
    "verse_ranges": f"SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR WHEN b = a + 1 THEN a || ', ' || b ELSE a || '–' || b END, ', ' ORDER BY a) AS reference FROM (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM (SELECT DISTINCT * FROM ({_ISLANDS}))) GROUP BY l_orderkey, run) GROUP BY l_orderkey",
    "verse_quotes": "SELECT l_orderkey, string_agg(part, '' ORDER BY n) AS quote FROM (SELECT l_orderkey, n, CASE WHEN gap IS NULL THEN '' WHEN gap = 1 THEN ' ' ELSE ' … ' END || p AS part FROM (SELECT l_orderkey, l_linenumber AS n, min(l_partkey)::VARCHAR AS p, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap FROM lineitem WHERE l_quantity < 30 GROUP BY l_orderkey, l_linenumber)) GROUP BY l_orderkey",
    "numbering_gaps": "WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber::INT AS n FROM lineitem WHERE l_quantity < 40) SELECT l_orderkey, n FROM (SELECT l_orderkey, unnest(range(1, max(n) + 1))::INT AS n FROM h GROUP BY l_orderkey) ANTI JOIN h USING (l_orderkey, n)",
    "span_ends": "SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) AS span_end FROM events",
    "carry_forward": "SELECT conv_id, turn, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS carried FROM conversations",
    "rising_numbers": "SELECT l_orderkey, n, l_partkey FROM (SELECT l_orderkey, l_linenumber AS n, l_partkey, max(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lineitem) WHERE b IS NULL OR l_partkey > b",
    "heading_runs": "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, run) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT event_id, user_id, CASE WHEN coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 60) >= 60 THEN 1 ELSE 0 END AS fresh FROM events))) WHERE n < 3",
    "packed_units": """WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem),
f AS (SELECT l_orderkey, n, k, 0 AS part, size AS s FROM r WHERE k = 1 UNION ALL SELECT r.l_orderkey, r.n, r.k, CASE WHEN f.s >= 60 THEN f.part + 1 ELSE f.part END, CASE WHEN f.s >= 60 THEN 0 ELSE f.s END + r.size FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.k = f.k + 1)
SELECT l_orderkey, n, part FROM f""",
    "part_ordinals": "SELECT l_orderkey, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS nth, count(*) OVER (PARTITION BY l_orderkey) AS of FROM lineitem",
}
