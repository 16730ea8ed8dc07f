"""Token counts of whole texts under a unigram model, by dynamic programming shared along a trie.

The pieces of a SentencePiece vocabulary file get log-probabilities by Zipf's law from their rank
(ids are in order of rank, single characters last), as the file has ranks and tokenizers are not
trained here; a byte that no piece covers is a token of its
own at a lower score. A pre-token is a run of characters outside x20 and x09-x0D behind the mark of
a word's beginning. Its tokens are those of the segmentation with the highest score, of equal
scores the one with fewest tokens.

A task takes the distinct pre-tokens of a slice of its texts into a trie, whose nodes are the
distinct beginnings, and computes the best score of each node once from those of the nodes above
it, all nodes of a depth at a time, however deep; the count at the node where a pre-token ends is
kept for later slices. White space between pre-tokens is no token. Documents are then sums over their pre-tokens. There is no shuffle, so no key can be hot,
and memory is bounded by the slice and by CACHE.

Defined results: a null or empty text has 0 words and 0 tokens; rows that repeat a doc_id are rows
of their own; an empty table gives an empty result; other columns pass through counted().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import wordhash
from .shared import table

MARK = "▁".encode()
#: Distinct pre-tokens whose counts a Python worker keeps, 12 bytes each.
CACHE = 2_000_000
#: Depths of the trie with fewer pieces than this are worked off one by one, without numpy's overhead.
NARROW = 24
#: How much less likely than the last piece a bare byte is, as a logarithm.
BYTE_PENALTY = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[bytes, float]:
    """Log-probability of each piece that is plain text: 1 / (rank * H), ranks from 1."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    whole = math.log(math.log(n) + 0.5772156649)
    plain = (i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i).encode(): -math.log(rank) - whole for rank, i in enumerate(plain, 1)}


class TrieCounter:
    """Token counts of pre-tokens."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.byte_score = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.sizes = sorted({len(p) for p in scores})
        self.by_size = {}
        for size in self.sizes:
            own = [p for p in scores if len(p) == size]
            data = np.frombuffer(b"".join(own), dtype=np.uint8)
            at = np.arange(len(own), dtype=np.int64) * size
            hashes = wordhash.hash_spans(data, at, at + size)
            order = np.argsort(hashes)
            self.by_size[size] = hashes[order], np.array([scores[p] for p in own])[order]
        self.clear()

    def clear(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def together(self, words: list[bytes]) -> np.ndarray:
        """The counts of distinct pre-tokens, over the trie of their beginnings."""
        if not words:
            return np.zeros(0, np.int32)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(data))
        depth = at - start + 1
        span = wordhash.SpanHashes(data)
        # nodes are distinct beginnings; `first` is a place where each occurs
        _, first, node = np.unique(span(start, at + 1) + depth.astype(np.uint64), return_index=True, return_inverse=True)
        deep, here = depth[first], first
        found_node, found_from, found_score = [np.arange(len(first))], [here - 1], [np.full(len(first), self.byte_score)]
        for size, (hashes, scores) in self.by_size.items():
            able = np.flatnonzero(deep >= size)
            if not len(able):
                break
            end = here[able] + 1
            h = span(end - size, end)
            where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[where] == h
            found_node.append(able[hit])
            found_from.append(here[able[hit]] - size)
            found_score.append(scores[where[hit]])
        to, before, score = map(np.concatenate, (found_node, found_from, found_score))
        # the node that a piece starts from; the root, before a word's first byte, comes last
        root = len(first)
        source = np.where(before < start[here[to]], root, node[np.maximum(before, 0)])
        best, count = np.full(root + 1, -np.inf), np.zeros(root + 1, dtype=np.int32)
        best[root] = 0.0
        order = np.argsort(deep[to], kind="stable")
        to, source, score = to[order], source[order], score[order]
        bounds = np.searchsorted(deep[to], np.arange(1, int(deep.max()) + 2)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < NARROW:
                for t, u, w in zip(to[a:b].tolist(), source[a:b].tolist(), score[a:b].tolist()):
                    s, n = best[u] + w, count[u] + 1
                    if s > best[t] or (s == best[t] and n < count[t]):
                        best[t], count[t] = s, n
                continue
            t, s = to[a:b], best[source[a:b]] + score[a:b]
            n = count[source[a:b]] + 1
            rank = np.lexsort((n, -s, t))
            t, s, n = t[rank], s[rank], n[rank]
            lead = np.r_[True, t[1:] != t[:-1]]
            best[t[lead]], count[t[lead]] = s[lead], n[lead]
        return count[node[np.cumsum(sizes) - 1]]

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        data, offs = wordhash.text_bytes(column)
        starts, ends, first = wordhash.word_spans(data, offs)
        distinct, at, place = np.unique(wordhash.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self.clear()
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if new.any():
            counts = self.together([MARK + data[starts[i] : ends[i]].tobytes() for i in at[new]])
            hashes = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(hashes)
            self.hashes, self.counts = hashes[order], np.concatenate([self.counts, counts])[order]
        each = self.counts[np.searchsorted(self.hashes, distinct)][place] if len(distinct) else np.zeros(0, np.int32)
        total = np.r_[0, np.cumsum(each.astype(np.int64))]
        return np.diff(first), total[first[1:]] - total[first[:-1]]


_counters: dict[str, TrieCounter] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, TrieCounter(piece_scores(path)))
        for whole in batches:
            for batch in wordhash.slices(whole, "text"):
                words, tokens = counter.count(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*batch.schema.names, "n_words", "n_tokens"])

    return run


def counted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with n_words and n_tokens of the text, which take the place of columns of these names."""
    docs = docs.drop("n_words", "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(_count(vocabulary or default_vocabulary()), schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: A best segmentation is beyond SQL; tests compare with dynamic programming word by word.
SQL: dict = {}
