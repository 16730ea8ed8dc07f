"""Queries on token streams, versions and devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.vectors import dot
from ..functions.wordpiece import FOLDED, wordpiece
from ..operators.excerpts import excerpts, tiers
from ..sources.tables import UNITS_SQL, table, units
from ..streaming import answers as N
from ..streaming import tokens as S


def _chunks(spark, sf, text):
    """Conversations as streams, in chunks of 7 characters."""
    whole = table(spark, sf, "conversations").withColumn("whole", text)
    n = F.greatest(F.lit(1), F.ceil(F.length("whole") / 7)).cast("int")
    cut = whole.select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), "whole", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return cut.select("stream_id", F.col("seq").cast("long").alias("seq"), F.substring(F.col("whole"), F.col("seq") * 7 + 1, F.lit(7)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("is_last"))


def _joined(found):
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return found.groupBy("stream_id").agg(F.md5(texts).alias("md5"))


def reasoning_filter(spark, sf):
    thought = F.concat(F.lit("<think>hm "), F.col("role"), F.lit("</think>\n\n"), F.rtrim(F.ltrim("text")), F.when(F.col("turn") % 3 == 0, "<|channel>thought\nno<channel|> yes").otherwise(""))
    return _joined(S.batch(_chunks(spark, sf, thought), "reasoning"))


def sse_frames(spark, sf):
    event = lambda text: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    body = F.concat(event(F.col("role")), F.lit(": ping\ndata: {broken\n"), event(F.col("text")), F.lit("data: [DONE]\n"))
    return _joined(S.batch(_chunks(spark, sf, body), "frames"))


def ndjson_frames(spark, sf):
    body = F.concat(F.to_json(F.struct(F.col("role").alias("response"))), F.lit("\n"), F.to_json(F.struct(F.col("text").alias("response"))))
    return _joined(S.batch(_chunks(spark, sf, body), "frames"))


_VERSIONS = """concat(CASE WHEN p_partkey % 4 = 0 THEN 'v' ELSE '' END, CAST(p_partkey % 12 AS STRING), '.', CAST(p_size % 12 AS STRING), CASE p_partkey % 5 WHEN 0 THEN '.0.0' WHEN 1 THEN '.0.0.7' WHEN 2 THEN '.x' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN concat('+', CAST(p_size % 9 AS STRING)) ELSE '' END)"""


def newer_versions(spark, sf):
    """Versions with and without a v, trailing zeros, a fifth part and a build; some are no versions."""
    part = table(spark, sf, "part")
    return part.select("p_partkey", F.coalesce(dates.version_key(F.expr(_VERSIONS)) > dates.version_key(F.lit("v5.10.0+3")), F.lit(False)).alias("newer"), F.col("p_type").rlike("^[0-9a-f]{64}$").alias("digest"))


def model_tiers(spark, sf):
    """Nations stand for models."""
    models = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nth"), (F.col("n_nationkey") * 100).cast("long").alias("bytes"))
    return tiers(models, 1500)


def work_excerpts(spark, sf):
    return excerpts(units(spark, sf).select("source", "unit_id", "sequence", "content"))


def wordpiece_ids(spark, sf):
    """A vocabulary of letters and a few endings, as no real one is there."""
    vocabulary = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), "the", "and", "##ing", "##tion", ".", ","])}
    ids = wordpiece(F.col("content"), vocabulary)
    return units(spark, sf).select("unit_id", F.size(ids).alias("n"), F.md5(F.array_join(ids.cast("array<string>"), ",")).alias("md5"))


def two_stage_vectors(spark, sf):
    """Vectors of one label first, then the exact order of these: a prefiltered search."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"), F.col("label").alias("wanted"))
    few = e.join(F.broadcast(q), F.col("label") == F.col("wanted"))
    return few.select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(10)


def answers_kept(spark, sf):
    """Answers that begin with a thought and come in chunks of seven characters; some are cancelled on the way or after their end."""
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), "conv_id", "turn", F.concat(F.lit("<think>"), "role", F.lit("</think>"), F.coalesce("text", F.lit(""))).alias("t"))
    n = F.greatest(F.lit(1), F.ceil(F.length("t") / 7)).cast("int")
    chunks = c.select("stream_id", "t", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    chunks = chunks.select("stream_id", "seq", F.substring(F.col("t"), F.col("seq") * 7 + 1, F.lit(7)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("is_last"))
    cancels = c.where("conv_id % 3 = 0").select("stream_id", (F.col("turn") * 5 % 40).alias("seq"))
    return N.kept(N.batch(N.events(chunks, cancels))).select("stream_id", "event", F.md5("text").alias("md5"))


QUERIES = {f.__name__: f for f in (answers_kept, reasoning_filter, sse_frames, ndjson_frames, newer_versions, model_tiers, work_excerpts, wordpiece_ids, two_stage_vectors)}

_FOLD = f"translate(lower(content), '{''.join(FOLDED.values())}', '{''.join(bare * len(marks) for bare, marks in FOLDED.items())}')"
_SIGN = r"!-/:-@\[-`{-~\x{2000}-\x{206F}"

SQL = {
    # single letters begin and go on with a word, so what is longest at each place is told by one alternation
    "wordpiece_ids": rf"""WITH {UNITS_SQL}, w AS (SELECT unit_id, regexp_extract_all({_FOLD}, '[{_SIGN}]|[^{_SIGN} \t\n\r]+')[1:254] AS ws FROM units),
i AS (SELECT unit_id, flatten(list_transform(ws, lambda w: CASE WHEN w = '.' THEN [59] WHEN w = ',' THEN [60] WHEN NOT regexp_matches(w, '^[a-z]{{1,100}}$') THEN [0]
  ELSE list_concat([CASE WHEN starts_with(w, 'the') THEN 55 WHEN starts_with(w, 'and') THEN 56 ELSE ascii(w) - 94 END],
    list_transform(regexp_extract_all(substr(w, CASE WHEN regexp_matches(w, '^(the|and)') THEN 4 ELSE 2 END), 'tion|ing|[a-z]'), lambda p: CASE p WHEN 'tion' THEN 58 WHEN 'ing' THEN 57 ELSE ascii(p) - 68 END)) END))[1:254] AS ids FROM w)
SELECT unit_id, (len(ids) + 2)::INT AS n, md5(array_to_string(list_concat([1], ids, [2]), ',')) AS md5 FROM i""",
    "answers_kept": """WITH c AS (SELECT conv_id || '-' || turn AS stream_id, '<think>' || role || '</think>' || coalesce(text, '') AS t, CASE WHEN conv_id % 3 = 0 THEN turn * 5 % 40 END AS stop FROM conversations),
k AS (SELECT stream_id, t, stop, coalesce(stop < greatest(1, ceil(length(t) / 7)), false) AS cut FROM c),
v AS (SELECT stream_id, cut, ltrim(regexp_replace(CASE WHEN cut THEN substr(t, 1, 7 * stop) ELSE t END, '(?s)^<think>.*?(?:</think>|$)', ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM k)
SELECT stream_id, CASE WHEN cut THEN 'cancelled' ELSE 'end' END AS event, md5(text || CASE WHEN cut AND text <> '' THEN chr(10) || chr(10) || '_(stopped)_' ELSE '' END) AS md5 FROM v""",
    "reasoning_filter": "SELECT conv_id || '-' || turn AS stream_id, md5(ltrim(rtrim(ltrim(text)) || CASE WHEN turn % 3 = 0 THEN ' yes' ELSE '' END, ' ' || chr(10))) AS md5 FROM conversations",
    "sse_frames": "SELECT conv_id || '-' || turn AS stream_id, md5(role || text) AS md5 FROM conversations",
    "ndjson_frames": "SELECT conv_id || '-' || turn AS stream_id, md5(role || text) AS md5 FROM conversations",
    "model_tiers": """WITH m AS (SELECT n_nationkey AS nth, row_number() OVER (ORDER BY n_nationkey) AS k, count(*) OVER () AS n FROM nation WHERE n_nationkey * 100 <= 1500)
SELECT nth, tier FROM (SELECT nth, CASE WHEN n = 1 THEN 'recommended' WHEN n = 2 THEN CASE WHEN k = 1 THEN 'small' ELSE 'recommended' END WHEN k = 1 THEN 'small' WHEN k = n - 1 THEN 'recommended' WHEN k = n THEN 'large' END AS tier FROM m) WHERE tier IS NOT NULL""",
    "newer_versions": rf"""WITH v AS (SELECT p_partkey, p_type, regexp_replace({_VERSIONS.replace("STRING", "VARCHAR")}, '^v', '') AS v FROM part),
k AS (SELECT *, list_transform(range(1, 6), lambda i: coalesce(try_cast(string_split(string_split(v, '+')[1], '.')[i] AS INT), 0)) || [coalesce(try_cast(string_split(v, '+')[2] AS INT), 0)] AS key FROM v)
SELECT p_partkey, NOT contains(v, 'x') AND key > [5, 10, 0, 0, 0, 3] AS newer, regexp_full_match(p_type, '[0-9a-f]{{64}}') AS digest FROM k""",
    "work_excerpts": rf"""WITH {UNITS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sequence, unit_id) AS place, trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat FROM units QUALIFY place <= 3),
c AS (SELECT source, place, 1 AS kind, unnest(l) AS c, generate_subscripts(l, 1) AS k FROM (SELECT *, CASE WHEN length(flat) <= 400 THEN [flat] ELSE string_split_regex(content, '
\s*
') END AS l FROM o) UNION ALL SELECT source, place, 2, flat, 1 FROM o),
t AS (SELECT source, place, kind, k, regexp_replace(trim(regexp_replace(c, '\s+', ' ', 'g')), '^\[[^\]]{{1,12}}\]\s*', '') AS c FROM c),
g AS (SELECT * FROM t WHERE length(c) >= CASE kind WHEN 1 THEN 80 ELSE 60 END AND regexp_matches(c, '\pL') AND 2 * len(regexp_extract_all(c, '\p{{Lu}}')) <= len(regexp_extract_all(c, '\pL')) AND NOT regexp_matches(c, '(?i)transcriber') AND NOT (length(c) < 120 AND regexp_matches(c, '^(BY|By|Translated|Edited|PREFACE|CONTENTS)'))
  AND NOT regexp_matches(c, '^(The following are the contents|Contents of)') QUALIFY row_number() OVER (PARTITION BY source ORDER BY kind, place, k) = 1),
x AS (SELECT source, c, regexp_extract(substr(c, 1, 400), '(?s)^(.*[.?!]) ', 1) AS s, regexp_extract(substr(c, 1, 400), '(?s)^(.*) ', 1) AS w FROM g)
SELECT source, coalesce(CASE WHEN length(c) <= 400 THEN c WHEN length(s) > 241 THEN s ELSE regexp_replace(w, '[,;:]+$', '') || '…' END, '') AS excerpt FROM (SELECT DISTINCT source FROM units) LEFT JOIN x USING (source)""",
    "two_stage_vectors": "SELECT v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 3 AND v.label = q.label ORDER BY score DESC, v.vec_id LIMIT 10",
}
