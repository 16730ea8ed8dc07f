"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous sweeps.

1. Documents become pieces of at most `size` tokens (an end token closes each document).
2. Pieces are range-sorted by length; a piece's rank within its length comes from its place in its
   sorted partition and the counts of the partitions before, so no task sees a whole length. Pieces
   of one length are alike, and so are gaps of one size: a row of the tables below is a class of
   equal lengths with the ranks that are still to be placed, or an interval of bins with equal gaps.
   There is a class for each length up to `size` at most, however large the input.
3. A round is a Spark job over the table of classes and gaps, which the one before has written:
   a. New bins are opened for the pieces that the gaps cannot hold for certain: of the longest band
      of lengths (as many of which fit a bin) those beyond what the gaps have room for; once LOOSE or
      more fit a bin, as many bins as the volume beyond that of the gaps asks for.
   b. Successor sweep in order of size: pieces heap up, and every gap takes at most one piece (or one
      bundle of equal short pieces) from the top, the longest that it holds and no smaller gap took.
   c. Conflicts are resolved by rank: of a class the lowest ranks that are left are matched first, of
      equal gaps the first bins.
   d. Gaps shrink by what they hold; rounds repeat until all ranks are placed, some 20 of them, up to 80 for short pieces alone.
   The table has at most `size` classes and as many sizes of gaps whatever the input, so the sweep of
   a round is one task; what grows with the input, the sort, the ranks and the join, is distributed.
4. What a round has matched is an interval of ranks onto an interval of bins; pieces find theirs by
   a join on length and rank.

Defined results: a null text is an empty document, one end token; rows that repeat a doc_id are
documents of their own; an empty table packs into nothing. The tokenizer has to be one whose
pre-tokens end at white space and before .,;:!? and whose text is lower-cased, as the default's are;
a file that splits a probing text otherwise is refused.
"""

from __future__ import annotations

import bisect
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash
from .shared import materialize, parts, shared_dir, table

SIZE = 2048
END = 0
#: Distinct pre-tokens whose ids a Python worker keeps, about 40 bytes each.
CACHE = 1_500_000

#: A text on which a tokenizer of other rules gives itself away.
PROBE = "Ab cd, ef-GH 12.5 it's  x\ty\nz... (q) é_è don't 3,000; a:b! w? ünder"

_LETTERS = re.compile("[a-zà-öø-ÿ]+")
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,;:!?")] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceEncoder:
    """Token ids of white-space separated pieces of text; each distinct piece goes through the tokenizer once.

    The tokenizer's rules never reach across white space, nor across the end of a word before one
    of .,;:!? so ids of the pieces in a row are the ids of the text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a byte's printable stand-in, as byte-level vocabularies have it
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.clear()
        ids, _ = self.encode(pa.array([PROBE]))
        if ids[:-1].tolist() != self.tokenizer.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path}: ids of the pieces of a text are not the ids of the text")
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids: list[list[int] | None] = [None] * len(pieces)
        slow = []
        for i, p in enumerate(pieces):
            low = p.lower()
            if _LETTERS.fullmatch(low):  # one pre-token, whatever surrounds it
                text = low if low.isascii() else low.encode().decode("latin-1").translate(self.stand_in)
                ids[i] = [t.id for t in self.tokenizer.model.tokenize(text)]
            else:
                slow.append(i)
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([pieces[i] for i in slow], add_special_tokens=False)):
            ids[i] = e.ids
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(n.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used) + (1 << 16), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter((x for one in ids for x in one), np.uint32, total)
        at = self.used + np.cumsum(n) - n
        self.used += total
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.n = hashes[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END, and the offsets of the texts in them."""
        data, offs = wordhash.text_bytes(column)
        if b"<|" not in data.tobytes():  # a special token's spelling keeps its case
            data = wordhash.LOWER[data]
        starts, ends, _ = wordhash.word_spans(data, offs)
        cuts = np.flatnonzero(_POINT[data[1:]] & _ALNUM[data[:-1]]) + 1
        cuts = cuts[~np.isin(cuts, offs, assume_unique=False)] if len(cuts) else cuts
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        distinct, first, place = np.unique(wordhash.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self.clear()
        where = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = where < len(self.hashes)
        new[inside] = self.hashes[where[inside]] != distinct[inside]
        if new.any():
            self._learn(distinct[new], [bytes(data[starts[i] : ends[i]]).decode() for i in first[new]])
            where = np.searchsorted(self.hashes, distinct)
        n = self.n[where][place]
        closes = np.cumsum(n)
        spans = np.searchsorted(starts, offs)
        tokens = np.r_[0, closes][spans] + np.arange(len(offs))  # each text before has its END
        out = np.full(int(tokens[-1]), END, dtype=np.uint32)
        total = int(closes[-1]) if len(closes) else 0
        if total:
            source = np.repeat(self.at[where][place] - (closes - n), n) + np.arange(total)
            text_of = np.repeat(np.arange(len(offs) - 1), np.diff(np.r_[0, closes][spans]))
            out[np.arange(total) + text_of] = self.flat[source]
        return out, tokens


_encoders: dict[str, PieceEncoder] = {}


def _cut(path: str, size: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, PieceEncoder(path))
        for whole in batches:
            for batch in wordhash.slices(whole, "text"):
                flat, tokens = encoder.encode(batch.column("text"))
                lengths = np.diff(tokens)
                counts = -(-lengths // size)
                row = np.repeat(np.arange(len(lengths)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * size
                length = np.minimum(lengths[row] - start, size)
                at = tokens[row] + start
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pc.cast(pa.array(flat), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; with ids, also the ids themselves."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer or default_tokenizer(), size, ids), schema)


#: From this many pieces a bin on, bins are opened by volume.
LOOSE = 4
#: Bundles of short pieces are no longer than this share of a bin, so they take no gap from a long piece.
BUNDLE = 8
_STATE = "kind int, a long, b long, c long, d long, e long, f long"
#: Kinds of rows: a class (length, first rank, pieces left), a gap (free, first bin, bins), what was placed (length, ranks from and to, each, bin, offset), and the number of bins.
_CLASS, _GAP, _FLOW, _BINS = range(4)


class Round:
    """One round over classes {length: [first rank, left]} and gaps [(free, first bin, bins)]."""

    def __init__(self, classes: dict[int, list[int]], gaps: list[tuple[int, int, int]], bins: int, size: int):
        self.classes, self.gaps, self.bins, self.size = classes, gaps, bins, size
        self.flows: list[tuple[int, ...]] = []

    def put(self, length: int, each: int, free: int, first: int, n: int) -> None:
        """The next ranks of a length into n bins, `each` to a bin."""
        lo = self.classes[length][0]
        self.flows.append((length, lo, lo + each * n, each, first, self.size - free))
        self.classes[length][0] += each * n
        self.classes[length][1] -= each * n
        if free > each * length:
            self.gaps.append((free - each * length, first, n))

    def open(self) -> None:
        top, least = max(self.classes), min(self.classes)
        each = self.size // top
        band = sorted((x for x in self.classes if x > self.size // (each + 1)), reverse=True)
        free, n = (np.array([g[k] for g in self.gaps], dtype=np.int64) for k in (0, 2))
        rest = count = excess = 0
        for length in band:
            left = self.classes[length][1]
            count += left
            # pieces from the longest down to this one, beyond what the gaps could hold of this length
            now = max(0, count - int((free // length * n).sum()) - excess)
            excess += now
            if each < LOOSE:  # pieces of the band in a row fill bins of their own; what is left of a class goes into an empty one
                if now >= each:
                    self.put(length, each, self.size, self.bins, now // each)
                    self.bins += now // each
                rest += now % each
        if each < LOOSE:
            empty = -(-rest // each)
        else:
            volume = sum(x * left for x, (_, left) in self.classes.items()) - sum(free * n for free, _, n in self.gaps if free >= least)
            empty = max(0, -(-excess // each), -(-volume // self.size))
        if empty:
            self.gaps.append((self.size, self.bins, empty))
            self.bins += empty

    def bundles(self) -> dict[int, int]:
        """How many pieces of a length go together: more than one only where pieces outnumber the gaps that hold them."""
        ascending = sorted(self.gaps)
        sizes, able = [g[0] for g in ascending], np.cumsum([0, *(g[2] for g in reversed(ascending))])[::-1]
        longest = self.size // BUNDLE
        out = {}
        for length, (_, left) in self.classes.items():
            n = int(able[bisect.bisect_left(sizes, length)])
            out[length] = max(1, min(sizes[-1] // length, left // n, longest // length)) if n and left > n else 1
        return out

    def sweep(self) -> None:
        each = self.bundles()
        events = sorted([(e * x, 0, x, 0) for x, e in each.items()] + [(free, 1, first, n) for free, first, n in self.gaps])
        heap: list[list[int]] = []
        self.gaps = []
        for value, is_gap, x, n in events:
            if not is_gap:
                heap.append([x, self.classes[x][1] // each[x]])
                continue
            while n and heap:
                length, waiting = heap[-1]
                now = min(n, waiting)
                if now:
                    self.put(length, each[length], value, x, now)
                x, n, heap[-1][1] = x + now, n - now, waiting - now
                if now == waiting:
                    heap.pop()
            if n:
                self.gaps.append((value, x, n))

    def run(self) -> None:
        self.open()
        self.classes = {x: c for x, c in self.classes.items() if c[1]}
        if self.classes:
            self.sweep()
            self.classes = {x: c for x, c in self.classes.items() if c[1]}


def _round(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        if not rows:
            return
        own = Round({r[1]: [r[2], r[3]] for r in rows if r[0] == _CLASS}, [r[1:4] for r in rows if r[0] == _GAP], max((r[1] for r in rows if r[0] == _BINS), default=0), size)
        own.run()
        out = [(_CLASS, x, *c) for x, c in own.classes.items()] + [(_GAP, *g) for g in own.gaps] + [(_FLOW, *f) for f in own.flows] + [(_BINS, own.bins)]
        columns = zip(*((*r, *[None] * (7 - len(r))) for r in out))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.int32()) for k, c in enumerate(columns)], names=["kind", *"abcdef"])

    return run


def flows(counts: DataFrame, size: int = SIZE) -> DataFrame:
    """counts (length, n) -> length, lo, hi, each, bin, at: ranks lo to hi of a length go into bins from `bin` on, `each` to a bin, from offset `at`."""
    spark = counts.sparkSession
    path, nth = f"{shared_dir(spark)}/pack-rounds-{uuid.uuid4().hex}", 0
    nothing = [F.lit(None).cast("long").alias(c) for c in "def"]
    state = counts.select(F.lit(_CLASS).alias("kind"), F.col("length").alias("a"), F.lit(0).cast("long").alias("b"), F.col("n").cast("long").alias("c"), *nothing)
    while not state.where(F.col("kind") == _CLASS).isEmpty():
        state.where(F.col("kind") != _FLOW).coalesce(1).mapInArrow(_round(size), _STATE).write.parquet(f"{path}/round={nth}")
        state, nth = spark.read.schema(_STATE).parquet(f"{path}/round={nth}"), nth + 1
    whole = spark.read.schema(_STATE).parquet(path) if nth else spark.createDataFrame([], _STATE)
    names = zip("abcdef", ("length", "lo", "hi", "each", "bin", "at"))
    return whole.where(F.col("kind") == _FLOW).select(*(F.col(c).alias(n) for c, n in names))


def place(found: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset."""
    n = parts(found)
    ordered = found.repartitionByRange(n, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ordered = materialize(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "pack-ordered")
    # a row for each length and one more for each partition
    runs = materialize(ordered.groupBy("length", "__part").agg(F.count("*").alias("n"), F.min("__row").alias("first")), "pack-runs")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = runs.select("length", "__part", (earlier - F.col("first")).alias("base"))
    ranked = ordered.join(F.broadcast(base), ["length", "__part"]).withColumn("__rank", F.col("__row") + F.col("base"))
    f = flows(runs.groupBy("length").agg(F.sum("n").alias("n")), size).withColumnRenamed("length", "l")
    met = ranked.join(F.broadcast(f), (F.col("length") == F.col("l")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    nth = F.col("__rank") - F.col("lo")
    return met.select(*found.columns, (F.col("bin") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return place(materialize(pieces(docs, tokenizer, size, ids), "pack-pieces"), size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
