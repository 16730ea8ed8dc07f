"""The passages that answer questions: every step of retrieval as one operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.store import stored
from . import chunks as C
from . import kept_index as K
from . import lexical as X
from . import scope as S
from . import semantic as M
from . import tagging as G


@dataclass(frozen=True)
class Reach:
    """How much each step fetches, as multiples of the passages asked for."""

    scoped: int = 4
    lexical: int = 2
    tags: int = 1
    chunks: int = 6
    semantic: int = 4
    fused: int = 4
    #: Rows that a scope has to give, else the question is asked without it.
    enough: int = 2


def scopes(asked: DataFrame, works: DataFrame, traditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, source) and (qid, tradition) that questions name; an author stands for all works of theirs."""
    named = stored(S.recognise(asked, works, traditions), "scopes")
    of_work = named.where("kind = 'work'").select("qid", F.col("label").alias("source"))
    of_author = named.where("kind = 'author'").select("qid", F.col("label").alias("author")).join(works.select("author", F.col("source").cast("string").alias("source")), "author").select("qid", "source")
    return of_work.unionByName(of_author).distinct(), named.where("kind = 'tradition'").select("qid", F.col("label").alias("tradition")).distinct()


def within(rows: DataFrame, sources: DataFrame, traditions: DataFrame) -> DataFrame:
    """Rows (qid, source, tradition, ...) whose work or whose tradition their question names."""
    own = rows.join(sources.withColumn("__source", F.lit(True)), ["qid", "source"], "left").join(traditions.withColumn("__tradition", F.lit(True)), ["qid", "tradition"], "left")
    return own.where("__source OR __tradition").select(*rows.columns)


def unheard(units: DataFrame, questions: list[tuple[int, str]], found: DataFrame, limit: int) -> DataFrame:
    """Ranked units that hold the very words of a question that the lexical search found nothing for."""
    heard = {r["qid"] for r in found.select("qid").distinct().collect()}  # a row a question
    silent = [(qid, text.lower()) for qid, text in questions if qid not in heard and text.strip()]
    if not silent:
        return found.sparkSession.createDataFrame([], "qid int, unit_id long, rank int")
    texts = F.array(*(F.struct(F.lit(qid).alias("qid"), F.lit(text).alias("text")) for qid, text in silent))
    hits = units.select("unit_id", "sequence", F.explode(F.filter(texts, lambda q: F.contains(F.lower("content"), q["text"]))).alias("q"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("sequence", "unit_id"))
    return hits.select("q.qid", "unit_id", "sequence").withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "unit_id", "rank")


def nearest_units(vectors: DataFrame, asked: DataFrame, units: DataFrame, sources: DataFrame, traditions: DataFrame, limit: int, reach: Reach) -> DataFrame:
    """Units by their nearest chunk (chunk_id, unit_id, vector): the scope filters what was found, each unit counts once."""
    chunks = M.nearest(vectors.select(F.col("chunk_id").alias("unit_id"), "vector"), asked, reach.chunks * limit).select("qid", F.col("unit_id").alias("chunk_id"), "score")
    few = chunks.join(vectors.select("chunk_id", "unit_id"), "chunk_id").join(units.select("unit_id", "source", "tradition"), "unit_id", "left")
    scoped = sources.select("qid").unionByName(traditions.select("qid")).distinct()
    few = stored(few, "near-chunks")
    admitted = few.join(scoped, "qid", "left_anti").unionByName(within(few, sources, traditions))
    return X.top(admitted.groupBy("qid", "unit_id").agg(F.max("score").alias("score")), reach.semantic * limit).select("qid", "unit_id", "rank")


def best_passage(chosen: DataFrame, units: DataFrame, asked: DataFrame) -> DataFrame:
    """chosen with the chunk of its unit that holds most words of the question: chunk_seq and passage. A question without words of over two characters gets the whole text, and no chunk_seq. Only chosen units' texts are read on."""
    few = units.join(chosen.select("unit_id").distinct(), "unit_id", "left_semi").select("unit_id", "content")
    terms = asked.select("qid", F.array_distinct(F.filter(words(F.col("text")), lambda t: F.length(t) > 2)).alias("terms"))
    wanted = chosen.select("qid", "unit_id").join(terms, "qid")
    pieces = C.slices(C.chunk(few), few).join(wanted.where(F.size("terms") > 0), "unit_id")
    held = F.size(F.filter("terms", lambda t: F.contains(F.lower("text"), t)))
    best = pieces.groupBy("qid", "unit_id").agg(F.max_by(F.struct("seq", "text"), F.struct(held, -F.col("seq"))).alias("b"))
    whole = wanted.where(F.size("terms") == 0).join(few, "unit_id").select("qid", "unit_id", F.struct(F.lit(None).cast("int").alias("seq"), F.col("content").alias("text")).alias("b"))
    return chosen.join(best.unionByName(whole), ["qid", "unit_id"], "left").select(*chosen.columns, F.when(F.col("b").isNull(), 0).otherwise(F.col("b.seq")).alias("chunk_seq"), F.coalesce("b.text", F.lit("")).alias("passage"))


def _scanned(units: DataFrame, questions: list[tuple[int, str]], sources: DataFrame, named: DataFrame, limit: int, reach: Reach) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of all units, the ranked ones within scopes and the ranked ones, from a pass over the texts."""
    scored = X.bm25(units, questions).select("qid", "unit_id", F.col("source").cast("string").alias("source"), "tradition", "score")
    scored = stored(scored, "scored")
    scoped = stored(X.top(within(scored, sources, named), reach.scoped * limit).select("qid", "unit_id", "rank"), "scoped")
    return scored, scoped, X.top(scored, reach.lexical * limit).select("qid", "unit_id", "rank")


def _kept(index: str, questions: list[tuple[int, str]], sources: DataFrame, named: DataFrame, limit: int, reach: Reach, spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from a kept index; of the scores only those of ranked units and of the best unit of each tradition that a question names."""
    said = {qid: X.query_terms(text) for qid, text in questions}
    voices = [tuple(r) for r in named.select("qid", "tradition").limit(K.MOST_ASKS + 1).collect()]  # more asks than that are refused
    wanted = [("free", qid, None) for qid in said] + [("scoped", qid, None) for qid in said] + [("voice", qid, tradition) for qid, tradition in voices]
    sizes = {"free": reach.lexical * limit, "scoped": reach.scoped * limit, "voice": 1}
    asks = [K.Ask(n, tuple(said[qid]), sizes[kind], kind != "free") for n, (kind, qid, _) in enumerate(wanted)]
    numbered = spark.createDataFrame([(n, *w) for n, w in enumerate(wanted)], "ask int, kind string, qid int, named string")
    own = numbered.where("kind = 'scoped'").select("ask", "qid")
    none = F.lit(None).cast("string")
    scope = own.join(sources, "qid").select("ask", "source", none.alias("tradition")).unionByName(own.join(named, "qid").select("ask", none.alias("source"), "tradition"))
    scope = scope.unionByName(numbered.where("kind = 'voice'").select("ask", none.alias("source"), F.col("named").alias("tradition")))
    found = stored(K.top(spark, index, asks, scope).rows.join(F.broadcast(numbered), "ask").select("kind", "qid", "unit_id", "source", "tradition", "score", "rank"), "kept-found")
    of = lambda kind: found.where(F.col("kind") == kind).select("qid", "unit_id", "rank")
    return found.where("kind <> 'scoped'").select("qid", "unit_id", "source", "tradition", "score"), of("scoped"), of("free")


def answer(
    units: DataFrame, questions: list[tuple[int, str]], works: DataFrame, traditions: DataFrame, tags: DataFrame | None = None, vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None,
    limit: int = 5, reach: Reach = Reach(), index: str | None = None, phrases: dict[str, list[str]] = G.QUESTION_PHRASES,
) -> DataFrame:
    """qid, place, unit_id, source, tradition, chunk_seq, passage: at most `limit` passages for each question.

    What a question names is a scope: of works, authors' works or traditions. Lexical search keeps to
    it unless it then finds next to nothing; a question without any hit is looked for as it stands.
    Units with the question's topics go on behind the lexical list, the nearest chunks' units make
    the second list, and both are fused by rank. Quotas of source and tradition pick the places, every
    one of several named traditions gets one, and a unit is shown by its best chunk.

    units: unit_id, source, tradition, title, content, sequence. works: source, title, author.
    traditions: tradition. tags: unit_id, slug. vectors: chunk_id, unit_id, vector, with
    asked_vectors: qid, query. index: the folder of a kept index of the units (kept_index), from which
    only what can be among the best is read; without one the texts are scanned once. The questions are few and sent to all tasks; a question without
    words, or without any list, has no passages.
    """
    spark = units.sparkSession
    asked = spark.createDataFrame(questions, "qid int, text string")
    sources, named = scopes(asked, works, traditions)
    about = units.select("unit_id", F.col("source").cast("string").alias("source"), "tradition")
    scored, scoped, free = _scanned(units, questions, sources, named, limit, reach) if index is None else _kept(index, questions, sources, named, limit, reach, spark)
    enough = scoped.groupBy("qid").count().where(F.col("count") >= reach.enough).select("qid")
    lexical = scoped.join(F.broadcast(enough), "qid", "left_semi").unionByName(free.join(F.broadcast(enough), "qid", "left_anti")).unionByName(unheard(units, questions, scored, reach.lexical * limit))
    if tags is not None:
        topics = asked.select("qid", F.explode(G.question_tags(F.col("text"), phrases)).alias("slug"))
        matches = tags.join(F.broadcast(topics), "slug").groupBy("qid", "unit_id").agg(F.count("slug").alias("score"))
        lexical = M.appended(lexical, X.top(matches, reach.tags * limit))
    lists = [(lexical, 1.0)]
    if vectors is not None:
        lists.append((nearest_units(vectors, asked_vectors, about, sources, named, limit, reach), 1.0))
    ranked = M.fuse(lists, reach.fused * limit).join(about, "unit_id")
    chosen = stored(M.with_named_traditions(M.diversify(ranked, limit), scored, named, limit), "chosen")
    return best_passage(chosen.select("qid", "place", "unit_id", "source", "tradition"), units, asked)
