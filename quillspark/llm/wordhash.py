"""Words of a batch of texts as 64-bit hashes, by numpy over the Arrow buffers; no Python string is made.

A word is a run of bytes outside x20 and x09-x0D after lower-casing A-Z. Its hash is a polynomial
over random 64-bit values of the bytes, finished by a mixer: equal words agree in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_VALUES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 18
#: Bytes of text in a slice of a batch; a longer text is a slice of its own.
SLICE = 2 << 20

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK * 2)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text."""
    if not batch.num_rows:
        return
    _, offs = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each text the number of its first word, with the total at the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = IS_WORD[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span; starts ascend and spans do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        a, b = int(starts[at]), int(ends[to - 1])
        power, inverse = _power_tables(b - a + 1)
        sums = np.empty(b - a + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[data[a:b]] * power[: b - a], out=sums[1:])
        out[at:to] = (sums[ends[at:to] - a] - sums[starts[at:to] - a]) * inverse[starts[at:to] - a]
        at = to
    return mix(out)


class SpanHashes:
    """Hashes of any spans of some bytes, as hash_spans gives them; for data of moderate size."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(_VALUES[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text the number of its first word, with the total at the end."""
    data, offs = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs)
    return hash_spans(data, starts, ends), first


def fold(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash of several, in order."""
    h = np.full(len(parts[0]), seed, dtype=np.uint64)
    for part in parts:
        h = h * _STEP + part
    return mix(h)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; with fewer words, of all of them as one."""
    h, first = words(column)
    n = len(h) - size + 1
    runs = fold([h[k : k + n] for k in range(size)]) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(fold([h[k : k + 1] for k in range(a, b)], seed=b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
