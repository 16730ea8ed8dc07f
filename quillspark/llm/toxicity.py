"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs, and pairs that skip one word;
words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A word longer than STEM bytes
also counts by its first STEM, so the forms of a word share a weight. FTRL-proximal keeps a learning
rate for each coordinate, and L1 leaves most weights at zero, so the model is a short list of
(feature, weight), at most 2**BITS of 12 bytes, which every executor gets.

Fitting learns from a sample with two bounds: at most SAMPLE labelled rows, those with the smallest
hash of doc_id, and of these, in the same order, as many as have MOST_FEATURES features together. The
texts become distinct feature numbers where they lie; one task gets those, 4 bytes each, and learns
them in order. If the second bound ends the sample, fit() warns with the number of rows learnt from.
Scoring reads whole texts of all rows in one pass without a shuffle.

Defined results: null and empty texts score as the intercept says, whatever their number; labels that
are null, or whose doc_id is null or missing from the documents, are not learnt from; a doc_id that
repeats in the documents is a row of the sample for each of its texts, and one that repeats in the
labels is toxic if any of them is; every row is scored by itself; without labels every score is 0; an
empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .shared import shielded, table

BITS = 20
#: The most labelled rows that a model is fitted on.
SAMPLE = 24_000
#: The most features, of 4 bytes, that these rows have together.
MOST_FEATURES = 60_000_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0
#: Bytes of a word's stem.
STEM = 5
#: Of five parts by crc32 of doc_id, the part that is never learnt from.
FOLDS, HELD_OUT = 5, 0

_LEARNT, _BEYOND = -1, -2
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEEDS = (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179))


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, with repeats, and the number of the text that each is in."""
    data, offs = wordhash.text_bytes(column)
    data = wordhash.LOWER[data]
    # every other byte counts as a blank
    starts, ends, first = wordhash.word_spans(np.where(_INSIDE[data], data, np.uint8(32)), offs)
    h = wordhash.hash_spans(data, starts, ends)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    long = ends - starts > STEM
    stems = wordhash.fold([wordhash.hash_spans(data, starts[long], starts[long] + STEM)], STEM)
    found, where = [h, stems], [text, text[long]]
    for gap, seed in zip((1, 2), _SEEDS):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            found.append(wordhash.fold([h[:-gap], h[gap:]], int(seed))[same])
            where.append(text[gap:][same])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(where)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the intercept, which L1 leaves alone."""

    def __init__(self, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.l1 = np.full(len(self.z), l1)
        self.l1[-1] = 0
        self.alpha, self.beta, self.l2 = alpha, beta, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, text, toxic -> place, toxic and the distinct features, ascending, as packed 32-bit numbers."""
    for whole in batches:
        for batch in wordhash.slices(whole, "text"):
            at, text = features(batch.column("text"))
            pairs = np.unique(text << (BITS + 1) | at)
            bounds = np.searchsorted(pairs >> (BITS + 1), np.arange(batch.num_rows + 1))
            flat = (pairs & ((1 << (BITS + 1)) - 1)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), packed], names=["place", "toxic", "features"])


def _fit(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole sample in order of place -> the weights that aren't zero; as features _LEARNT and _BEYOND the numbers of rows."""
        intercept, rows, held, n = 1 << BITS, [], 0, 0
        for batch in batches:
            for own, label in zip(batch.column("features").to_pylist(), batch.column("toxic").to_pylist()):
                held += len(own) // 4
                n += 1
                if held <= most:
                    rows.append((np.r_[np.frombuffer(own, dtype=np.int32), intercept].astype(np.int32), int(label)))
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, label in rows:
                model.learn(at, label)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, _LEARNT, _BEYOND]), pa.array(np.r_[w[at], float(len(rows)), float(n - len(rows))])], names=["feature", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights, from labels outside the held-out part. The sample is bounded, so one task learns it."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT)
    place = F.xxhash64("doc_id", F.lit(3))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", place).orderBy("place", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "text", "toxic")
    rows = rows.select("place", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_featurise, "place long, toxic int, features binary")
    in_order = rows.repartition(1).sortWithinPartitions("place", "features")  # a hash, whatever order rows arrive in
    weights = {r[0]: r[1] for r in in_order.mapInArrow(_fit(most_features), "feature long, weight double").collect()}
    learnt, beyond = (int(weights.pop(f, 0)) for f in (_LEARNT, _BEYOND))
    if beyond:
        warnings.warn(f"learnt from {learnt} labelled rows: {beyond} more rows of the sample are beyond {most_features} features", stacklevel=2)
    return np.array(list(weights), dtype=np.int64), np.array(list(weights.values()))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = model.value
        weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
        weights[at] = w
        used = weights != 0
        for whole in batches:
            for batch in wordhash.slices(whole, "text"):
                found, text = features(batch.column("text"))
                hit = used[found]
                pairs = np.unique(text[hit] << (BITS + 1) | found[hit])  # each feature once a text
                total = np.bincount(pairs >> (BITS + 1), weights=weights[pairs & ((1 << (BITS + 1)) - 1)].astype(np.float64), minlength=batch.num_rows)
                score = 1 / (1 + np.exp(-np.clip(total + weights[-1], -35, 35))) if len(at) else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "__score", "__toxic"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs with __score and __toxic."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType()), T.StructField("__toxic", T.IntegerType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that a model fitted on labels doesn't reject."""
    inner, restore = shielded(docs, ("doc_id", "text"))
    return restore(score(inner, fit(inner, labels)).where("__toxic = 0"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), F.col("__toxic").alias("predicted"))
