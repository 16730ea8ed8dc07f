"""Queries on search: lexical, tags, vectors, fusion, scope, chunks, and the whole question pipeline."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import SEARCH_STOPWORDS
from ..operators import answering as A
from ..operators import chunks as C
from ..operators import kept_index as K
from ..operators import lexical as X
from ..operators import scope as S
from ..operators import semantic as M
from ..operators import tagging as G
from ..sources.store import shared_dir
from ..sources.tables import UNITS_SQL, table, units

#: Questions in the words of the synthetic documents.
QUESTIONS = [(1, "What did they say about onthe and ering heon?"), (2, "quel est le menten dans leaux"), (3, "der Ungen und keiter")]
KEYWORDS = {"that": "that-tag", "with": "with-tag", "this": "with-tag", "pour": "pour-tag", "nicht": "nicht-tag", "para": "para-tag", "worthless": "rare-tag"}
LIMIT, PLACES = 20, 6


def lexical_bm25_topk(spark, sf):
    found = X.top(X.bm25(units(spark, sf), QUESTIONS), LIMIT)
    return found.select("qid", "unit_id", "rank", F.round("score", 6).alias("score"))


def kept(spark, sf):
    """The folder of the index of a corpus: it is written when it is first asked for in an application, then kept."""
    root = f"{shared_dir(spark)}/kept-index-{spark.sparkContext.applicationId}-{hashlib.md5(sf.encode()).hexdigest()[:12]}"
    if not K.Reader(spark, root).segments:
        K.add(units(spark, sf), root)
    return root


def _ranked(found):
    return found.rows.select(F.col("ask").alias("qid"), "unit_id", "rank", F.round("score", 6).alias("score"))


def bm25_index_topk(spark, sf):
    """The same through a kept index."""
    return _ranked(K.top(spark, kept(spark, sf), K.asks(QUESTIONS, LIMIT)))


#: The shelves that a question may use: works, traditions.
SCOPES = {1: (["src3", "src5"], []), 2: ([], ["fr"]), 3: (["src1"], ["en"])}


def kept_index_scoped(spark, sf):
    """Each question within some works or traditions."""
    scope = spark.createDataFrame([(q, w, None) for q, (works, _) in SCOPES.items() for w in works] + [(q, None, t) for q, (_, traditions) in SCOPES.items() for t in traditions], "ask int, source string, tradition string")
    return _ranked(K.top(spark, kept(spark, sf), [replace(a, scoped=True) for a in K.asks(QUESTIONS, LIMIT)], scope))


def kept_index_upkeep(spark, sf):
    """An index that took in all units, lost the short ones and got the long ones again with nothing but their titles."""
    u, root = units(spark, sf), f"{shared_dir(spark)}/upkeep-{uuid.uuid4().hex}"
    K.add(u, root)
    K.remove(spark, root, u.where(F.length("content") < 300))
    K.add(u.where(F.length("content") > 3000).withColumn("content", F.col("title")), root)
    return _ranked(K.top(spark, root, K.asks(QUESTIONS, LIMIT)))


def _bm25_sql(units_sql: str = UNITS_SQL) -> str:
    asked = [(qid, X.query_terms(text)) for qid, text in QUESTIONS]
    rows = ", ".join(f"({qid}, '{t}')" for qid, own in asked for t in own)
    return f"""WITH {units_sql}, asked(qid, term) AS (VALUES {rows}),
tokens AS (SELECT unit_id, unnest(regexp_extract_all(lower(content || ' ' || title), '[a-z0-9]+')) AS token FROM units),
lengths AS (SELECT unit_id, len(regexp_extract_all(lower(content || ' ' || title), '[a-z0-9]+')) AS dl FROM units),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM lengths),
tf AS (SELECT term, unit_id, count(*)::DOUBLE AS tf FROM tokens JOIN (SELECT DISTINCT term FROM asked) ON starts_with(token, term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT qid, unit_id, sum(ln(greatest(1.000001, (n - df + 0.5) / (df + 0.5))) * tf * {X.K1 + 1} / (tf + {X.K1} * (1 - {X.B} + {X.B} * dl / mean))) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (unit_id), stats GROUP BY qid, unit_id),
lexical AS (SELECT * FROM (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id)::INT AS rank FROM scored) WHERE rank <= {LIMIT})"""


def postings_dictionary(spark, sf):
    return X.dictionary(X.postings(units(spark, sf)))


def query_expression(spark, sf):
    asked = [(i, q) for i, (_, q) in enumerate(QUESTIONS)] + [(10, "what are these about"), (11, "a an"), (12, 'The "Synod" (of Dort)')]
    return spark.createDataFrame([(i, X.match_expression(q)) for i, q in asked], "qid int, expression string")


def keyword_tags(spark, sf):
    return G.unit_tags(units(spark, sf), KEYWORDS, G.SCAN).select("unit_id", "slug")


def tag_coverage(spark, sf):
    tags = G.unit_tags(units(spark, sf), KEYWORDS, G.SCAN)
    tagged = tags.groupBy("tradition").agg(F.countDistinct("unit_id").alias("tagged"), F.countDistinct("slug").alias("slugs"))
    return units(spark, sf).groupBy("tradition").agg(F.count("*").alias("n")).join(tagged, "tradition", "left").select("tradition", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tagged", "slugs")))


def tag_search(spark, sf):
    return G.search(G.unit_tags(units(spark, sf), KEYWORDS, G.SCAN), ["With Tag", "that-tag", "RARE-TAG"]).orderBy(F.col("matches").desc(), "unit_id").limit(LIMIT)


TAG_QUESTIONS = [(1, "Are sins forgiven by grace alone?"), (2, "hello sincere evangelical"), (3, "The Lord's Supper and Baptisms"), (4, "free will, Hell and the second coming")]


def query_tags(spark, sf):
    asked = spark.createDataFrame(TAG_QUESTIONS, "qid int, text string")
    return asked.select("qid", F.array_join(G.question_tags(F.col("text")), ",").alias("tags"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"), "label")


def _asked_vectors(spark, sf):
    return _vectors(spark, sf).where("unit_id IN (3, 5, 7)").select(F.floor(F.col("unit_id") / 2).cast("int").alias("qid"), F.col("vector").alias("query"))


def vector_topk(spark, sf):
    return M.nearest(_vectors(spark, sf), _asked_vectors(spark, sf), LIMIT).select("qid", "unit_id", "rank", F.round("score", 6).alias("score"))


def quantize_int8(spark, sf):
    q = V.quantised(V.normalised(F.col("vector")))
    rows = _vectors(spark, sf).select("unit_id", q.alias("q"), "vector")
    return rows.select("unit_id", F.aggregate("q", F.lit(0), lambda a, x: a + x.cast("int")).alias("total"), F.element_at("q", 1).cast("int").alias("first"), F.round(V.dot(F.col("q"), F.col("vector")) / V.SCALE, 4).alias("own_cosine"))


def best_chunk_per_unit(spark, sf):
    """Four vectors stand for the chunks of a unit."""
    v = _vectors(spark, sf).select(F.col("unit_id").alias("chunk_id"), F.floor(F.col("unit_id") / 4).alias("unit_id"), "vector")
    asked = _asked_vectors(spark, sf).where("qid = 1")
    scored = v.crossJoin(F.broadcast(asked)).select("qid", "chunk_id", "unit_id", F.round(V.dot(F.col("vector"), F.col("query")), 6).alias("score"))
    return M.best_per_unit(scored)


def _fused(spark, sf):
    lexical = X.top(X.bm25(units(spark, sf), QUESTIONS), LIMIT)
    return M.fuse([(lexical, 1.0), (M.nearest(_vectors(spark, sf), _asked_vectors(spark, sf), LIMIT), 1.0)], LIMIT)


def rrf_hybrid(spark, sf):
    return _fused(spark, sf).select("qid", "unit_id", "rank", F.round("score", 9).alias("score"))


def rrf_with_tags(spark, sf):
    """The lexical list goes on with the units that have the question's tags; a unit in both counts twice."""
    lexical = X.top(X.bm25(units(spark, sf), QUESTIONS), LIMIT)
    tags = G.search(G.unit_tags(units(spark, sf), KEYWORDS, G.SCAN), ["that-tag", "with-tag"]).orderBy(F.col("matches").desc(), "unit_id").limit(LIMIT)
    tagged = X.top(tags.select(F.lit(1).alias("qid"), "unit_id", F.col("matches").cast("double").alias("score")), LIMIT)
    return M.fuse([(M.appended(lexical.where("qid = 1"), tagged), 1.0)], LIMIT).select("qid", "unit_id", "rank", F.round("score", 9).alias("score"))


def diversified(spark, sf):
    ranked = _fused(spark, sf).join(units(spark, sf).select("unit_id", "source", "tradition"), "unit_id", "left")
    return M.diversify(ranked, PLACES)


def _works(spark, sf):
    """A work for each brand and type; every brand but each fourth type has a writer."""
    part = table(spark, sf, "part")
    one = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("source"))
    return one.select("source", F.concat_ws(" ", "p_type", "p_brand").alias("title"), F.when(F.col("source") % 4 != 0, F.concat_ws(" ", F.col("p_brand"), F.lit("Writer"), (F.col("source") % 7).cast("string"))).alias("author"), "p_brand")


def scope_recognise(spark, sf):
    """A question on the first work of each brand."""
    works = _works(spark, sf)
    asked = works.groupBy("p_brand").agg(F.min(F.struct("source", "title")).alias("w")).select(F.col("w.source").cast("int").alias("qid"), F.concat_ws(" ", F.lit("what does the"), "w.title", F.lit("say of africa and the europes?")).alias("text"))
    return S.recognise(asked, works, table(spark, sf, "region").select(F.initcap("r_name").alias("tradition")))


def entity_tokens(spark, sf):
    return S.source_tokens(_works(spark, sf))


def chunk_spans(spark, sf):
    return C.chunk(units(spark, sf))


def chunk_text(spark, sf):
    return C.slices(C.chunk(units(spark, sf)), units(spark, sf)).select("chunk_id", F.length("text").alias("n"), F.md5("text").alias("md5"))


def fixed_slices(spark, sf):
    """Slices of 1,000 characters, cut in SQL, and for each unit the one with most of the terms."""
    u = units(spark, sf)
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / 1000)).cast("int")
    pieces = u.select("unit_id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq")).select("unit_id", "seq", F.substring(F.col("content"), F.col("seq") * 1000 + 1, F.lit(1000)).alias("text"))
    return C.best(pieces, ["onth", "ering", "ment", "ungen"])


#: Questions that name a work, several traditions, a topic, nothing, and one that no token answers.
ASKED = [(1, "What did the annals of src3 say about onthe and ering heon?"), (2, "how do the ens and the frs differ on menten and that"), (3, "der Ungen und keiter with"), (4, "zzzz qqqq"), (5, "")]
ASKED_PHRASES = {"onthe": ["that-tag"], "with": ["with-tag", "nicht-tag"]}


def _annals(u):
    """Every source is the work `src… Annals`, by an author of its own."""
    return u.select("source").distinct().select("source", F.concat(F.col("source"), F.lit(" Annals")).alias("title"), F.concat(F.lit("Keeper x"), F.col("source")).alias("author"))


def search_rag(spark, sf):
    """The whole pipeline on a few questions; two vectors in a row stand for the chunks of a unit."""
    u = units(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).cast("long").alias("unit_id"), F.col("embedding").alias("vector"))
    found = A.answer(u, ASKED, _annals(u), u.select("tradition").distinct(), G.unit_tags(u, KEYWORDS), vectors, _asked_vectors(spark, sf), PLACES, index=kept(spark, sf), phrases=ASKED_PHRASES)
    return found.select("qid", "place", "unit_id", "source", "tradition", "chunk_seq", F.md5("passage").alias("md5"))


def postings_upkeep(spark, sf):
    """An index from which one part of the units was taken, and into which another came again."""
    u = units(spark, sf)
    index = X.postings(u)
    short, long = u.where(F.length("content") < 300), u.where(F.length("content") > 3000)
    return X.dictionary(X.with_units(X.without_units(index, short.unionByName(long)), long))


QUERIES = {f.__name__: f for f in (lexical_bm25_topk, bm25_index_topk, kept_index_scoped, kept_index_upkeep, postings_dictionary, query_expression, keyword_tags, tag_coverage, tag_search, query_tags, vector_topk, quantize_int8, best_chunk_per_unit, rrf_hybrid, rrf_with_tags, diversified, scope_recognise, entity_tokens, chunk_spans, chunk_text, fixed_slices, search_rag, postings_upkeep)}

_LEX = _bm25_sql()
_INSIDE = " OR ".join(f"qid = {q} AND {column} = '{name}'" for q, both in SCOPES.items() for column, names in zip(("source", "tradition"), both) for name in names)
_UPKEPT = f"{UNITS_SQL.replace('units AS', 'every AS', 1)}, units AS (SELECT unit_id, title, CASE WHEN length(content) > 3000 THEN title ELSE content END AS content FROM every WHERE length(content) >= 300)"
_VEC = f"""vec AS (SELECT * FROM (SELECT q.vec_id // 2 AS qid, v.vec_id AS unit_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id)::INT AS rank
  FROM embeddings v, embeddings q WHERE q.vec_id IN (3, 5, 7)) WHERE rank <= {LIMIT})"""
_FUSED = f"SELECT qid, unit_id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, unit_id)::INT AS rank FROM (SELECT qid, unit_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ranked GROUP BY qid, unit_id)) WHERE rank <= {LIMIT}"
_TAGS = "tags AS (SELECT DISTINCT unit_id, tradition, slug FROM units JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in KEYWORDS.items()) + r") AS k(word, slug) ON regexp_matches(title || ' ' || substr(content, 1, 4000), '(?i)\b' || word || '(s|es)?\b'))"
_STOP = ", ".join(f"'{w}'" for w in S.ENTITY_STOPWORDS)
_TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9'']+'), lambda t: length(t) > 2 AND t NOT IN (" + _STOP + ")))"
_WORKS = f"""works AS (SELECT source, p_type || ' ' || p_brand AS title, CASE WHEN source % 4 <> 0 THEN p_brand || ' Writer ' || source % 7 END AS author, p_brand FROM (SELECT p_brand, p_type, min(p_partkey) AS source FROM part GROUP BY ALL)),
st AS (SELECT *, count(*) OVER (PARTITION BY token) AS works FROM (SELECT source, len(own)::INT AS total, unnest(own) AS token FROM (SELECT source, {_TOKENS.format("concat_ws(' ', title, author)")} AS own FROM works)))"""
_CHUNKS = r"""text AS (SELECT unit_id, content, length(content) AS n FROM units),
breaks AS (SELECT unit_id, kind, list(pos ORDER BY pos) AS ends FROM (
  SELECT unit_id, kind, sum(length(piece) + length(sep)) OVER (PARTITION BY unit_id, kind ORDER BY k) AS pos FROM (
    SELECT unit_id, kind, unnest(p[1:len(s)]) AS piece, unnest(s) AS sep, generate_subscripts(s, 1) AS k FROM (
      SELECT unit_id, kind, string_split_regex(content, pattern) AS p, regexp_extract_all(content, pattern) AS s FROM text, (VALUES ('p', '\n\s*\n'), ('s', '[.!?]\s+')) AS t(kind, pattern) WHERE n > 1800))) GROUP BY ALL),
whole AS (SELECT t.unit_id, content, n, coalesce(p.ends, []) AS p, coalesce(s.ends, []) AS s FROM text t LEFT JOIN breaks p ON p.unit_id = t.unit_id AND p.kind = 'p' LEFT JOIN breaks s ON s.unit_id = t.unit_id AND s.kind = 's'),
walk AS (SELECT unit_id, -1::BIGINT AS seq, 0::BIGINT AS a, 0::BIGINT AS e, 0::BIGINT AS next FROM whole
  UNION ALL SELECT unit_id, seq + 1, a, e, CASE WHEN e = n THEN NULL ELSE greatest(a + 1, e - 200) END FROM (
    SELECT *, CASE WHEN n - a <= 1800 THEN n ELSE coalesce(near(p, a), near(s, a), CASE WHEN strpos(reverse(substr(content, a + 601, 1200)), ' ') > 0 AND 1200 - strpos(reverse(substr(content, a + 601, 1200)), ' ') > 0 THEN a + 1800 - strpos(reverse(substr(content, a + 601, 1200)), ' ') END, a + 1800) END AS e FROM (
      SELECT w.unit_id, w.seq, w.next AS a, content, n, p, s FROM walk w JOIN whole USING (unit_id) WHERE w.next IS NOT NULL))),
spans AS (SELECT unit_id, seq, a AS char_start, e AS char_end, CASE WHEN seq < 1000 THEN unit_id * 1000 + seq ELSE -(unit_id * 10000000 + seq) END AS chunk_id FROM walk WHERE seq >= 0)"""
for _list in ("p", "s"):  # the break of a list that is nearest to the aimed length, the first of equal ones
    _CHUNKS = _CHUNKS.replace(f"near({_list}, a)", f"list_sort(list_transform(list_filter({_list}, lambda x: x >= a + 600 AND x <= a + 1800), lambda x: {{'d': abs(x - a - 1200), 'x': x}}))[1].x")
_SLASH = ", ".join(f"'{w}'" for w in sorted(SEARCH_STOPWORDS))

SQL = {
    "lexical_bm25_topk": f"{_LEX} SELECT qid, unit_id, rank, round(score, 6) AS score FROM lexical",
    "bm25_index_topk": f"{_LEX} SELECT qid, unit_id, rank, round(score, 6) AS score FROM lexical",
    "kept_index_scoped": f"{_LEX} SELECT qid, unit_id, rank, round(score, 6) AS score FROM (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id)::INT AS rank FROM scored JOIN units USING (unit_id) WHERE {_INSIDE}) WHERE rank <= {LIMIT}",
    "kept_index_upkeep": f"{_bm25_sql(_UPKEPT)} SELECT qid, unit_id, rank, round(score, 6) AS score FROM lexical",
    "postings_dictionary": f"WITH {UNITS_SQL} SELECT token, count(DISTINCT unit_id) AS df, count(*) AS cf FROM (SELECT unit_id, unnest(regexp_extract_all(lower(content || ' ' || title), '[a-z0-9]+')) AS token FROM units) GROUP BY token",
    "postings_upkeep": f"WITH {UNITS_SQL} SELECT token, count(DISTINCT unit_id) AS df, count(*) AS cf FROM (SELECT unit_id, unnest(regexp_extract_all(lower(content || ' ' || title), '[a-z0-9]+')) AS token FROM units WHERE length(content) >= 300) GROUP BY token",
    "query_expression": f"""WITH asked(qid, q) AS (VALUES {", ".join(f"({i}, '{q}')" for i, (_, q) in enumerate(QUESTIONS))}, (10, 'what are these about'), (11, 'a an'), (12, 'The "Synod" (of Dort)')),
w AS (SELECT qid, list_filter(string_split_regex(lower(regexp_replace(q, '[^A-Za-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda t: length(t) > 2) AS own FROM asked)
SELECT qid::INT AS qid, array_to_string(list_transform(CASE WHEN len(list_filter(own, lambda t: t NOT IN ({_SLASH}))) > 0 THEN list_filter(own, lambda t: t NOT IN ({_SLASH})) ELSE own END, lambda t: t || '*'), ' OR ') AS expression FROM w""".replace("\\\\", "\\"),
    "keyword_tags": f"WITH {UNITS_SQL}, {_TAGS} SELECT unit_id, slug FROM tags",
    "tag_coverage": f"WITH {UNITS_SQL}, {_TAGS} SELECT tradition, count(DISTINCT u.unit_id) AS n, count(DISTINCT t.unit_id) AS tagged, count(DISTINCT slug) AS slugs FROM units u LEFT JOIN tags t USING (tradition, unit_id) GROUP BY tradition",
    "tag_search": f"WITH {UNITS_SQL}, {_TAGS} SELECT unit_id, count(slug) AS matches FROM tags WHERE slug IN ('with-tag', 'that-tag', 'rare-tag') GROUP BY unit_id ORDER BY matches DESC, unit_id LIMIT {LIMIT}",
    "query_tags": "SELECT * FROM (VALUES (1, 'grace,sin'), (2, ''), (3, 'baptism,eucharist,sacraments'), (4, 'grace,salvation,eschatology,last-judgment')) AS t(qid, tags)",
    "vector_topk": f"WITH {_VEC} SELECT qid::INT AS qid, unit_id, rank, round(score, 6) AS score FROM vec",
    "quantize_int8": f"""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9) AS size FROM embeddings),
q AS (SELECT vec_id, v, list_transform(v, lambda x: greatest(-{V.SCALE}, least({V.SCALE}, round_even(x / size * {V.SCALE}, 0)))) AS q FROM n)
SELECT vec_id AS unit_id, list_sum(q)::INT AS total, q[1]::INT AS first, round(list_dot_product(q, v) / {V.SCALE}, 4) AS own_cosine FROM q""",
    "best_chunk_per_unit": "SELECT 1 AS qid, unit_id, chunk_id, score FROM (SELECT v.vec_id AS chunk_id, v.vec_id // 4 AS unit_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 3) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, chunk_id) = 1",
    "rrf_hybrid": f"{_LEX}, {_VEC}, ranked AS (SELECT qid, unit_id, rank FROM lexical UNION ALL SELECT qid, unit_id, rank FROM vec) {_FUSED}",
    "rrf_with_tags": f"""{_LEX}, {_TAGS}, tagged AS (SELECT unit_id, row_number() OVER (ORDER BY count(slug) DESC, unit_id) AS rank FROM tags WHERE slug IN ('with-tag', 'that-tag') GROUP BY unit_id ORDER BY rank LIMIT {LIMIT}),
ranked AS (SELECT qid, unit_id, rank FROM lexical WHERE qid = 1 UNION ALL SELECT 1, unit_id, rank + (SELECT max(rank) FROM lexical WHERE qid = 1) FROM tagged) {_FUSED}""",
    "entity_tokens": f"WITH {_WORKS} SELECT * FROM st",
    "scope_recognise": f"""WITH {_WORKS}, asked AS (SELECT source AS qid, unnest({_TOKENS.format("('what does the ' || title || ' say of africa and the europes?')")}) AS token FROM works WHERE source IN (SELECT min(source) FROM works GROUP BY p_brand)),
regions AS (SELECT upper(r_name[1]) || lower(r_name[2:]) AS tradition FROM region),
tt AS (SELECT token, max(tradition) AS tradition FROM (SELECT tradition, unnest({_TOKENS.format("tradition")}) AS token FROM regions UNION SELECT tradition, string_split(lower(tradition), ' ')[-1] FROM regions UNION SELECT tradition, string_split(lower(tradition), ' ')[-1] || 's' FROM regions) GROUP BY token),
authors AS (SELECT token, min(author) AS author FROM (SELECT author, unnest({_TOKENS.format("author")}) AS token FROM (SELECT DISTINCT author FROM works WHERE author IS NOT NULL)) GROUP BY token HAVING count(*) = 1),
hits AS (SELECT qid, source, count(*) AS hits, max(total) AS total, min(works) AS rarest FROM asked JOIN st USING (token) GROUP BY qid, source),
named AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM hits WHERE hits >= 2 AND (hits >= total OR hits >= 0.6 * total OR rarest <= 2))
SELECT DISTINCT qid::INT AS qid, 'tradition' AS kind, tradition AS label FROM asked JOIN tt USING (token) UNION ALL SELECT DISTINCT qid::INT, 'author', author FROM asked JOIN authors USING (token) UNION ALL SELECT qid::INT, 'work', source::VARCHAR FROM named WHERE n <= 6""",
    "chunk_spans": f"WITH RECURSIVE {UNITS_SQL}, {_CHUNKS} SELECT unit_id, seq::INT AS seq, char_start::INT AS char_start, char_end::INT AS char_end, chunk_id FROM spans",
    "chunk_text": f"WITH RECURSIVE {UNITS_SQL}, {_CHUNKS} SELECT chunk_id, length(substr(content, char_start + 1, char_end - char_start))::INT AS n, md5(substr(content, char_start + 1, char_end - char_start)) AS md5 FROM spans JOIN units USING (unit_id)",
    "diversified": f"""{_LEX.replace("WITH ", "WITH RECURSIVE ", 1)}, {_VEC}, ranked AS (SELECT qid, unit_id, rank FROM lexical UNION ALL SELECT qid, unit_id, rank FROM vec), fused AS ({_FUSED}),
r AS (SELECT f.*, source, tradition FROM fused f LEFT JOIN units USING (unit_id)),
walk AS (SELECT DISTINCT qid, 0 AS rank, 0::BIGINT AS unit_id, ''::VARCHAR AS source, ''::VARCHAR AS tradition, false AS taken, []::VARCHAR[] AS s, []::VARCHAR[] AS t FROM r
  UNION ALL SELECT qid, rank, unit_id, source, tradition, ok, CASE WHEN ok THEN list_append(s, coalesce(source, '~')) ELSE s END, CASE WHEN ok THEN list_append(t, coalesce(tradition, '~')) ELSE t END FROM (
    SELECT r.*, s, t, len(s) < {PLACES} AND len(list_filter(s, lambda x: x = coalesce(r.source, '~'))) < 2 AND len(list_filter(t, lambda x: x = coalesce(r.tradition, '~'))) < {-(-PLACES // 2)} AS ok FROM walk w JOIN r ON r.qid = w.qid AND r.rank = w.rank + 1))
SELECT qid::INT AS qid, unit_id, source, tradition, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY NOT taken, rank) AS place FROM walk WHERE rank > 0) WHERE place <= {PLACES}""",
    "fixed_slices": f"""WITH {UNITS_SQL}, pieces AS (SELECT unit_id, seq, substr(content, seq * 1000 + 1, 1000) AS text FROM (SELECT unit_id, content, unnest(range(greatest(1, ceil(length(content) / 1000))::BIGINT)) AS seq FROM units))
SELECT unit_id, seq::INT AS seq, found::INT AS found FROM (SELECT unit_id, seq, contains(lower(text), 'onth')::INT + contains(lower(text), 'ering')::INT + contains(lower(text), 'ment')::INT + contains(lower(text), 'ungen')::INT AS found FROM pieces) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY found DESC, seq) = 1""",
}
