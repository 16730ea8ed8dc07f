"""A kept lexical index: BM25 over prefix terms from tables that are written once and read in part.

A folder holds, for each segment (a set of units that came together):

* words: a row for each unit, with its length dl and its distinct tokens w in order: token, tf, and how
  many characters the token shares with the one before it;
* postings: token, shelf, block, unit_id, tf and the unit's length dl, sorted by token, shelf and block
  over all files, in small row groups; `files` has each file's first and last token, so a range of
  tokens opens the files, and reads the groups, that hold it;
* blocks: for each token and block the number of postings, the highest tf and the least dl, in the same
  order. A block is the units of one work and tradition (a shelf) whose ids agree but for
  the last BLOCK_BITS bits, so a scope keeps or drops whole blocks. A block that reading back cut in two
  has two rows, which only makes its bound less tight;
* tokens: how many units hold a token (its first PREFIXES characters) and share so many characters of it
  with the token before. Of a unit's tokens that begin with a prefix the first in order shares fewer
  characters than the prefix has, the others do not; so these counts tell how many units hold a token
  that begins with it, and no pair of unit and prefix is ever made;
* and stats: units and tokens in all, the row that makes a segment count.

Units that are removed are named in `gone`, up to which segment, and what their words counted is written
as a segment of negative numbers, so document frequencies stay exact without reading or rewriting
postings; compacted() writes all that is left as a new index.

The best k of a question are found from bounds: a block's score is at most the sum over the terms of
idf times the part that its highest tf and least dl give. The FIRST blocks with the highest bounds are
scored exactly, which gives a threshold for the k-th place; then only blocks whose bounds reach it are.
What is read of the postings is the asked tokens' ranges, and of these what lies in chosen blocks goes
on. The result is the same as scoring every unit.

Questions are a batch that the driver knows, at most MOST_ASKS; more are refused. Their terms become
ranges in the filter of a scan, at most MOST_TERMS at a time; a larger batch takes several passes.

Tokens are runs of a-z and 0-9; those of fewer than three characters count for lengths only, as no term
is that short. Null texts are empty; a unit_id that repeats is refused. Rows of an empty table, and
questions without terms, give no rows. One writer at a time; readers see finished segments only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .lexical import B, COUNTED, K1, counted, query_terms

BLOCK_BITS = 7
LEAST, PREFIXES = 3, 32
MOST_ASKS, MOST_TERMS = 10_000, 200
#: Blocks of a question that are scored before there is a threshold.
FIRST = 8
#: Files that a scan names one by one; beyond it all are opened.
MOST_FILES = 5_000
#: Chosen blocks that the driver holds, and their numbers that become a filter of the scan; more are a join alone.
MOST_CHOSEN, MOST_LITERALS = 50_000, 256
ROW_GROUP = 1 << 20
_SCHEMAS = {
    "postings": "token string, shelf long, source string, tradition string, block long, unit_id long, tf int, dl int, segment int",
    "blocks": "token string, shelf long, source string, tradition string, block long, n long, most_tf int, least_dl int, segment int",
    "words": f"unit_id long, source string, tradition string, {COUNTED}, segment int",
    "tokens": "token string, shared int, n long, segment int",
    "files": "name string, file string, first string, last string, segment int",
    "gone": "unit_id long, upto int, segment int",
    "stats": "units long, tokens long, postings long, removal boolean, segment int",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _begins(terms: list[str]) -> Column:
    """Tokens that begin with one of the terms, as ranges that a scan can use."""
    return reduce(Column.__or__, ((F.col("token") >= t) & (F.col("token") < t + "{") for t in terms))  # { comes after z


class Reader:
    """The index as it is at one moment: its finished segments and their sums."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        stats = spark.read.schema(_SCHEMAS["stats"]).parquet(f"{root}/stats").collect() if _exists(spark, f"{root}/stats") else []  # a row a segment
        self.segments = sorted(r["segment"] for r in stats)
        self.removals = sorted(r["segment"] for r in stats if r["removal"])
        self.units, self.tokens, self.postings = (sum(r[c] for r in stats) for c in ("units", "tokens", "postings"))

    def table(self, name: str) -> DataFrame:
        """Rows of finished segments; what a job that died left under a removal's number, or the other way round, is none of them."""
        path = f"{self.root}/{name}"
        own = self.segments if name == "tokens" else self.removals if name == "gone" else [n for n in self.segments if n not in self.removals]
        if not own or not _exists(self.spark, path):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).parquet(path).where(F.col("segment").isin(own))

    def tokens_of(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of postings or blocks whose tokens begin with one of the terms, from the files that can hold them."""
        overlap = reduce(Column.__or__, ((F.col("last") >= t) & (F.col("first") < t + "{") for t in terms))  # { comes after z
        files = self.table("files").where((F.col("name") == name) & overlap).select("segment", "file").limit(MOST_FILES + 1).collect()
        path = f"{self.root}/{name}"
        few = [f"{path}/segment={r['segment']}/{r['file']}" for r in files]
        rows = self.spark.read.schema(_SCHEMAS[name]).option("basePath", path).parquet(*few) if 0 < len(few) <= MOST_FILES else self.table(name)
        return rows.where(_begins(terms))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (unit_id, segment, ...) of units that were not removed since."""
        if not self.removals:
            return rows
        dead = self.table("gone").groupBy("unit_id").agg(F.max("upto").alias("__upto"))
        return rows.join(dead, "unit_id", "left").where("__upto IS NULL OR segment > __upto").drop("__upto")


def _write(df: DataFrame, root: str, name: str, segment: int) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{root}/{name}/segment={segment}")


def _written(spark: SparkSession, root: str, name: str, segment: int) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name].replace(", segment int", "")).parquet(f"{root}/{name}/segment={segment}")


_BLOCK = ["token", "shelf", "source", "tradition", "block"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, sorted as they are, to a row for each token and block of a batch."""
    for batch in batches:
        own = pa.Table.from_batches([batch]).group_by(_BLOCK, use_threads=False).aggregate([("tf", "count"), ("tf", "max"), ("dl", "min")])
        yield from own.rename_columns({"tf_count": "n", "tf_max": "most_tf", "dl_min": "least_dl"}).select([*_BLOCK, "n", "most_tf", "least_dl"]).to_batches()


def _write_postings(rows: DataFrame, root: str, segment: int) -> int:
    """Postings, blocks and the list of their files; the number of postings. Only the sorting moves postings, blocks are made where they lie."""
    order = ["token", "shelf", "block"]
    _write(rows.repartitionByRange(*order).sortWithinPartitions(*order, "unit_id"), root, "postings", segment)
    own = _written(rows.sparkSession, root, "postings", segment)
    _write(own.select(*_BLOCK, "tf", "dl").mapInArrow(_blocks, _SCHEMAS["blocks"].replace(", segment int", "")), root, "blocks", segment)
    blocks = _written(rows.sparkSession, root, "blocks", segment)
    files = [df.groupBy(F.lit(name).alias("name"), F.col("_metadata.file_name").alias("file")).agg(F.min("token").alias("first"), F.max("token").alias("last")) for name, df in (("postings", own), ("blocks", blocks))]
    _write(files[0].unionByName(files[1]), root, "files", segment)
    return own.count()


def _finish(spark: SparkSession, root: str, segment: int, units: int, tokens: int, postings: int, removal: bool = False) -> None:
    _write(_local(spark, {"units": (pa.int64(), [units]), "tokens": (pa.int64(), [tokens]), "postings": (pa.int64(), [postings]), "removal": (pa.bool_(), [removal])}), root, "stats", segment)


def _token_counts(held: DataFrame) -> DataFrame:
    """token, shared and n of some units' words."""
    each = held.select(F.explode("w").alias("w")).where(F.col("w.shared") < PREFIXES)
    return each.groupBy(F.left("w.token", F.lit(PREFIXES)).alias("token"), F.col("w.shared").alias("shared")).agg(F.count("*").alias("n"))


def _derive(spark: SparkSession, root: str, segment: int, n: int, tokens: int) -> None:
    """What follows from a segment's words, and its end."""
    held = _written(spark, root, "words", segment)
    shelf = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.coalesce("tradition", F.lit("")), F.col("tradition").isNull())
    each = held.select(F.explode("w").alias("w"), shelf.alias("shelf"), "source", "tradition", F.shiftright("unit_id", BLOCK_BITS).alias("block"), "unit_id", "dl")
    postings = _write_postings(each.select("w.token", "shelf", "source", "tradition", "block", "unit_id", "w.tf", "dl"), root, segment)
    _write(_token_counts(held), root, "tokens", segment)
    _finish(spark, root, segment, n, tokens, postings)


def add(units: DataFrame, root: str) -> int:
    """Take units (unit_id, source, tradition, title, content) into the index, in place of what it had of them; the segment's number.

    Their texts are read once; tokens are counted where texts lie, so a unit's equal tokens are one row when they move.
    """
    spark = units.sparkSession
    segment = max(Reader(spark, root).segments, default=-1) + 2  # the number before is the removal's
    rows = units.select(F.col("unit_id").cast("long").alias("unit_id"), F.col("source").cast("string").alias("source"), "tradition", F.concat_ws(" ", "content", "title").alias("text"))
    _write(counted(rows, "text", LEAST), root, "words", segment)
    held = _written(spark, root, "words", segment)
    n, distinct, tokens = held.agg(F.count("*"), F.count_distinct("unit_id"), F.sum(F.col("dl").cast("long"))).first()
    if n != distinct:
        raise ValueError("a unit_id repeats or is null")
    remove(spark, root, held.select("unit_id"))
    _derive(spark, root, segment, n, tokens or 0)
    return segment


def remove(spark: SparkSession, root: str, ids: DataFrame) -> None:
    """Take units (unit_id) out of the index. Ids that it does not have change nothing."""
    index = Reader(spark, root)
    if not index.segments:
        return
    out = stored(index.live(index.table("words").select("unit_id", "dl", "segment")).join(ids.select("unit_id").distinct(), "unit_id", "left_semi"), "index-removed")
    units, tokens = out.agg(F.count("*"), F.sum(F.col("dl").cast("long"))).first()
    if not units:
        return
    segment = index.segments[-1] + 1
    leaving = index.table("words").join(out.select("unit_id", "segment"), ["unit_id", "segment"], "left_semi")
    _write(_token_counts(leaving).withColumn("n", -F.col("n")), root, "tokens", segment)
    _write(out.select("unit_id", F.lit(segment).alias("upto")), root, "gone", segment)
    _finish(spark, root, segment, -units, -(tokens or 0), 0, True)


def compacted(spark: SparkSession, root: str, to: str) -> None:
    """What is left of an index as an index of one segment, without any text."""
    index = Reader(spark, root)
    _write(index.live(index.table("words")).drop("segment"), to, "words", 1)
    _derive(spark, to, 1, index.units, index.tokens)


# --- asking ---


@dataclass(frozen=True)
class Ask:
    """A question, how many units it wants, and whether `scope` limits it to shelves."""

    ask: int
    terms: tuple[str, ...]
    k: int
    scoped: bool = False


def asks(questions: list[tuple[int, str]], k: int) -> list[Ask]:
    return [Ask(qid, tuple(query_terms(text)), k) for qid, text in questions]


@dataclass
class Found:
    """ask, unit_id, source, tradition, score, rank, and what was read of the postings for it."""

    rows: DataFrame
    postings_read: int = 0
    passes: list[int] = field(default_factory=list)


def _usable(term: str) -> bool:
    return re.fullmatch("[a-z0-9]{3,}", term) is not None


def _matching(terms: list[str]) -> Column:
    return F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.startswith(F.col("token"), t))).alias("term")


def _part(tf: Column, dl: Column, mean: float) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def _document_frequencies(index: Reader, terms: list[str]) -> dict[str, int]:
    """Units that hold a token with each of these beginnings, without those of no unit."""
    short, long = [t for t in terms if len(t) <= PREFIXES], [t for t in terms if len(t) > PREFIXES]
    df = {}
    if short:
        own = index.table("tokens").where(_begins(short)).select("n", "shared", _matching(short)).where(F.col("shared") < F.length("term"))
        df = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term
    if long:  # beyond the table of tokens: few tokens are that long, their postings are counted
        own = index.live(index.tokens_of("postings", long).select("unit_id", "segment", _matching(long)))
        df |= {r["term"]: r["n"] for r in own.groupBy("term").agg(F.count_distinct("unit_id").alias("n")).collect()}
    return {t: n for t, n in df.items() if n > 0}


def _batches(wanted: list[Ask]) -> list[list[Ask]]:
    out, held = [], set()
    for a in wanted:
        own = set(filter(_usable, a.terms))
        if not out or len(held | own) > MOST_TERMS:
            out, held = [*out, []], set()
        out[-1].append(a)
        held |= own
    return out


def top(spark: SparkSession, root: str, wanted: list[Ask], scope: DataFrame | None = None, first: int = FIRST) -> Found:
    """The best units of each ask. scope: ask, and source or tradition (the other null), the shelves that a scoped ask may use."""
    if len(wanted) > MOST_ASKS:
        raise ValueError(f"at most {MOST_ASKS} questions at a time")
    index = Reader(spark, root)
    parts = [_top(index, batch, scope, first) for batch in _batches(wanted)]
    if not parts:
        return _nothing(spark)
    return Found(reduce(DataFrame.unionByName, (p.rows for p in parts)), sum(p.postings_read for p in parts), [n for p in parts for n in p.passes])


def _nothing(spark: SparkSession) -> Found:
    return Found(spark.createDataFrame([], "ask int, unit_id long, source string, tradition string, score double, rank int"))


def _local(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A few rows that the driver has, as a relation that plans hold."""
    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, (kind, values) in columns.items()}))


_KEYS = {"segment": pa.int32(), "shelf": pa.int64(), "block": pa.int64()}


class _Chosen:
    """Blocks to score, as (ask, segment, shelf, block, n): on the driver while they are few, else a stored table."""

    def __init__(self, rows: DataFrame):
        few = rows.limit(MOST_CHOSEN + 1).collect()
        self.places = None
        if len(few) <= MOST_CHOSEN:
            self.rows = _local(rows.sparkSession, {"ask": (pa.int32(), [r["ask"] for r in few])} | {k: (t, [r[k] for r in few]) for k, t in _KEYS.items()})
            self.n = sum({tuple(r[k] for k in _KEYS): r["n"] for r in few}.values())
            blocks = sorted({r["block"] for r in few})
            self.places = blocks if len(blocks) <= MOST_LITERALS else None
        else:
            self.rows = stored(rows, "index-chosen")
            self.n = int(self.rows.groupBy(*_KEYS).agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0])


def _top(index: Reader, wanted: list[Ask], scope: DataFrame | None, first: int) -> Found:
    spark, terms = index.spark, sorted({t for a in wanted for t in a.terms if _usable(t)})
    df = _document_frequencies(index, terms) if terms and index.units else {}
    if not df:
        return _nothing(spark)
    terms, mean, keys = sorted(df), float(index.tokens) / index.units or 1.0, list(_KEYS)
    idf = {t: math.log(max(1.000001, (index.units - n + 0.5) / (n + 0.5))) for t, n in df.items()}
    pairs = [(a.ask, t) for a in wanted for t in a.terms if t in df]
    own = F.broadcast(_local(spark, {"ask": (pa.int32(), [a for a, _ in pairs]), "term": (pa.string(), [t for _, t in pairs]), "idf": (pa.float64(), [idf[t] for _, t in pairs])}))
    limits = F.broadcast(_local(spark, {"ask": (pa.int32(), [a.ask for a in wanted]), "k": (pa.int32(), [a.k for a in wanted]), "scoped": (pa.bool_(), [a.scoped for a in wanted])}))

    held = index.tokens_of("blocks", terms).select(*keys, "source", "tradition", "n", "most_tf", "least_dl", _matching(terms))
    most = held.groupBy(*keys, "source", "tradition", "term").agg(F.least(F.sum(_part(F.col("most_tf"), F.col("least_dl"), mean)), F.lit(K1 + 1)).alias("part"), F.sum("n").alias("n"))
    bounds = most.join(own, "term").groupBy("ask", *keys, "source", "tradition").agg(F.sum(F.col("idf") * F.col("part")).alias("most"), F.sum("n").alias("n"))
    if scope is not None:
        bounds = bounds.join(limits, "ask")
        free, tied = bounds.where("NOT scoped"), bounds.where("scoped")
        by = lambda c: scope.where(F.col(c).isNotNull()).select("ask", c).distinct().withColumn(f"__{c}", F.lit(True))
        admitted = tied.join(by("source"), ["ask", "source"], "left").join(by("tradition"), ["ask", "tradition"], "left").where("__source OR __tradition")
        bounds = free.unionByName(admitted.select(*free.columns))
    bounds = stored(bounds.select("ask", *keys, "most", "n"), "index-bounds")
    postings = index.tokens_of("postings", terms)

    def scored(chosen: _Chosen) -> DataFrame:
        """Exact scores of all units in the chosen blocks."""
        rows = postings
        if chosen.places is not None:  # the scan can pass over row groups without them
            rows = rows.where(reduce(Column.__or__, (F.col("block") == b for b in chosen.places), F.lit(False)))
        rows = rows.join(chosen.rows.select(*keys).distinct(), keys, "left_semi")
        counts = index.live(rows.select("unit_id", *keys, "source", "tradition", "dl", "tf", _matching(terms)))
        counts = counts.groupBy("unit_id", *keys, "source", "tradition", "dl", "term").agg(F.sum("tf").alias("tf"))
        parts = counts.join(own, "term").join(chosen.rows, ["ask", *keys], "left_semi")
        return parts.groupBy("ask", "unit_id", "source", "tradition").agg(F.sum(F.col("idf") * _part(F.col("tf"), F.col("dl"), mean)).alias("score"))

    def ranked(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.round("score", 9).desc(), "unit_id"))
        return rows.join(limits, "ask").withColumn("rank", rank).where(F.col("rank") <= F.col("k"))

    best = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("most").desc(), *keys))
    opening = _Chosen(bounds.withColumn("nth", best).where(F.col("nth") <= first).select("ask", *keys, "n"))
    kth = ranked(scored(opening)).where(F.col("rank") == F.col("k")).select("ask", "score").collect()  # a row a question
    least = F.broadcast(_local(spark, {"ask": (pa.int32(), [r["ask"] for r in kth]), "least": (pa.float64(), [r["score"] for r in kth])}))
    # as scores tie when they agree to nine digits, a bound just below the k-th score still counts
    rest = _Chosen(bounds.join(least, "ask", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - 2e-9)).select("ask", *keys, "n"))
    rows = stored(ranked(scored(rest)).select("ask", "unit_id", "source", "tradition", "score", "rank"), "index-found")
    return Found(rows, opening.n + rest.n, [opening.n, rest.n])
