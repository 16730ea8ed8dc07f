"""Exact deduplication by Grace hashing.

1. Each task hashes the lower-cased texts of its rows and puts them in an open-addressing table
   that compares complete content; the table is bounded in bytes and emits its entries when full.
   So a text that a third of all rows hold leaves a task once, not a million times.
2. Entries are partitioned by leading bits of the hash. What every bucket would take in a table is
   measured, texts and entries, and buckets that would not fit are partitioned again by the next
   bits, until each fits or holds one hash only.
3. Records go to their bucket through the shuffle, whose sorted files are the spill files; a task
   reads one bucket after another into an open-addressing table that compares complete content.

Defined results: texts are equal when identical after lower-casing A-Z; null counts as empty. Of
equal texts the row with the largest doc_id stays (null is the smallest); of rows that repeat both,
one stays. Empty tables give empty results. Other columns pass through deduplicate() unread.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .shared import materialize, quoted, shielded, table

#: Bytes of distinct text that a table of the first step and a bucket of the last hold.
TABLE_BYTES = 16 << 20
#: What an entry takes besides its text: its hash, rank, count and place in the table.
ENTRY_BYTES = 600
#: Bits by which an overfull bucket is partitioned again.
BITS = 4


class ContentTable:
    """Open addressing with linear probing; a slot refers to an entry, and equal means equal content."""

    def __init__(self, capacity: int = 1 << 10):
        self.slots = [-1] * capacity
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _place(self, h: int, content) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0 and not (self.hashes[entry] == h and self.contents[entry] == content):
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry's number and whether it is new."""
        at = self._place(h, content)
        if self.slots[at] >= 0:
            return self.slots[at], False
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + ENTRY_BYTES
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for entry, (h, content) in enumerate(zip(self.hashes, self.contents)):
                self.slots[self._place(h, content)] = entry
        return len(self.hashes) - 1, True


def _contents(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    data, offs = wordhash.text_bytes(batch.column(name))
    view = memoryview(wordhash.LOWER[data])
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield view[a:b].tobytes()


def _rank(doc_id, uid: int) -> tuple:
    return doc_id is not None, doc_id if doc_id is not None else 0, -uid


class _Entries:
    """Entries of a table, each with its best row and its sum of rows. Rows are copied out of a batch once it is through."""

    def __init__(self):
        self.table, self.best, self.count = ContentTable(), [], []
        self.place: list[int] = []
        self.taken: list[pa.RecordBatch] = []
        self.n_taken = self.taken_bytes = 0
        self.fresh: dict[int, int] = {}

    def add(self, h: int, content: bytes, rank: tuple, row: int, count: int) -> int:
        entry, new = self.table.add(h, content)
        if new:
            self.best.append(rank)
            self.count.append(count)
            self.place.append(-1)
            self.fresh[entry] = row
        else:
            self.count[entry] += count
            if rank > self.best[entry]:
                self.best[entry] = rank
                self.fresh[entry] = row
        return entry

    def keep(self, batch: pa.RecordBatch) -> None:
        """Take the rows that entries refer to out of their batch."""
        if not self.fresh:
            return
        self.taken.append(batch.take(pa.array(list(self.fresh.values()), pa.int64())))
        for entry in self.fresh:
            self.place[entry] = self.n_taken
            self.n_taken += 1
        self.taken_bytes += self.taken[-1].nbytes
        self.fresh = {}
        if self.n_taken > 2 * len(self.place) + 1000:  # rows that better ones took the place of
            self.rows()

    def rows(self) -> pa.RecordBatch:
        """The rows of all entries, in order."""
        whole = pa.Table.from_batches(self.taken).take(pa.array(self.place, pa.int64())).combine_chunks()
        batch = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns], names=whole.schema.names)
        self.taken, self.place, self.n_taken, self.taken_bytes = [batch], list(range(len(self.place))), len(self.place), batch.nbytes
        return batch

    @property
    def bytes(self) -> int:
        return self.table.bytes + self.taken_bytes


def _local(members: bool, table_bytes: int):
    """First step. Emits entries (a row with __hash, __count, __rep) and, if asked for, members (doc_id with __uid, __rep, __sha)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        held, reps = _Entries(), []

        def entries():
            if not held.count:
                return
            n = len(held.count)
            h = pa.array(np.array(held.table.hashes, dtype=np.uint64).view(np.int64))
            own = pa.array([-r[2] for r in held.best], pa.int64())
            yield pa.RecordBatch.from_arrays([*held.rows().columns, h, pa.array(held.count, pa.int64()), pa.array(reps, pa.int64()), own, pa.nulls(n, pa.string())], names=names)

        for whole in batches:
            names = [*whole.schema.names, "__hash", "__count", "__rep", "__uid", "__sha"]
            for batch in wordhash.slices(whole, "text"):
                ids, rep_of, shas, first = batch.column("doc_id").to_pylist(), [], [], uid
                for i, content in enumerate(_contents(batch, "text")):
                    digest = hashlib.sha256(content)
                    entry = held.add(int.from_bytes(digest.digest()[:8], "big"), content, _rank(ids[i], uid), i, 1)
                    if entry == len(reps):
                        reps.append(uid)
                    if members:
                        rep_of.append(reps[entry])
                        shas.append(digest.hexdigest())
                    uid += 1
                held.keep(batch)
                if members:
                    n = batch.num_rows
                    columns = [batch.column(f.name) if f.name == "doc_id" else pa.nulls(n, f.type) for f in batch.schema]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(rep_of, pa.int64()), pa.array(np.arange(first, uid)), pa.array(shas, pa.string())], names=names)
                if held.bytes > 2 * table_bytes:  # a text is in the table and in its row
                    yield from entries()
                    held, reps = _Entries(), []
        yield from entries()

    return run


def _bucketed(entries: DataFrame, bucket_bytes: int) -> DataFrame:
    """entries with __bucket: leading bits of the hash, as many as it takes for each bucket to fit."""
    sized = entries.select("__hash", (F.coalesce(F.octet_length("text"), F.lit(0)) + ENTRY_BYTES).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / bucket_bytes))))

    def bucket(bits: int):
        prefix = F.shiftrightunsigned("__hash", 64 - bits) if bits else F.lit(0).cast("long")
        return F.concat_ws("/", F.lit(bits), prefix)

    out, over = entries.withColumn("__bucket", bucket(bits)), sized.withColumn("__bucket", bucket(bits))
    while bits < 64:  # with all bits a bucket holds one hash
        full = over.groupBy("__bucket").agg(F.sum("size").alias("bytes"), F.min("__hash").alias("a"), F.max("__hash").alias("b")).where((F.col("bytes") > bucket_bytes) & (F.col("a") != F.col("b"))).select("__bucket", F.lit(True).alias("__over"))
        full = materialize(full, "grace-full")
        if full.isEmpty():
            break
        bits = min(64, bits + BITS)  # only rows of overfull buckets move on
        over = over.join(full, "__bucket").drop("__over").withColumn("__bucket", bucket(bits))
        out = out.join(full, "__bucket", "left").withColumn("__bucket", F.when(F.col("__over"), bucket(bits)).otherwise(F.col("__bucket"))).drop("__over")
    return out


def _compare(keep_rows: bool):
    """Last step, over buckets one after another: the rows that stay, or for each entry what stays of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reps, now = _Entries(), [], None

        def bucket():
            if not held.count:
                return
            if keep_rows:
                yield held.rows()
            else:
                entry = [e for _, e in reps]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in reps], pa.int64()), pa.array([held.best[e][1] if held.best[e][0] else None for e in entry], pa.int64()), pa.array([-held.best[e][2] for e in entry], pa.int64()), pa.array([held.count[e] for e in entry], pa.int64())], names=["__rep", "keep_id", "__keep_uid", "group_size"])

        for whole in batches:
            for batch in wordhash.slices(whole, "text"):
                ids, hashes, counts, rep, uids, buckets = (batch.column(c).to_pylist() for c in ("doc_id", "__hash", "__count", "__rep", "__uid", "__bucket"))
                own = batch.select(batch.schema.names[:-5])
                for i, content in enumerate(_contents(batch, "text")):
                    if buckets[i] != now:
                        if keep_rows:
                            held.keep(own)
                        yield from bucket()
                        held, reps, now = _Entries(), [], buckets[i]
                    entry = held.add(hashes[i] & 0xFFFFFFFFFFFFFFFF, content, _rank(ids[i], uids[i]), i, counts[i])
                    if not keep_rows:
                        reps.append((rep[i], entry))
                if keep_rows:
                    held.keep(own)
        yield from bucket()

    return run


def _stages(docs: DataFrame, members: bool, table_bytes: int) -> DataFrame:
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *(T.StructField(c, T.LongType()) for c in ("__hash", "__count", "__rep", "__uid")), T.StructField("__sha", T.StringType())])
    return materialize(docs.mapInArrow(_local(members, table_bytes), schema), "grace-records")


def _to_buckets(entries: DataFrame, bucket_bytes: int) -> DataFrame:
    placed = _bucketed(entries, bucket_bytes).select(*map(quoted, entries.columns), "__bucket")
    return placed.repartition("__bucket").sortWithinPartitions("__bucket", "__hash")


def deduplicate(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, whole. One shuffle of distinct texts; no join."""
    inner, restore = shielded(docs, ("doc_id", "text"))
    entries = _stages(inner, False, table_bytes).drop("__sha")
    return restore(_to_buckets(entries, table_bytes).mapInArrow(_compare(True), inner.schema))


def duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """For every row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    records = _stages(docs.select("doc_id", "text"), True, table_bytes)
    entries = records.where("__hash IS NOT NULL").drop("__sha")
    kept = _to_buckets(entries, table_bytes).mapInArrow(_compare(False), "__rep long, keep_id long, __keep_uid long, group_size long")
    members = records.where("__hash IS NULL").select("doc_id", "__rep", "__uid", "__sha")
    return members.join(kept, "__rep").select("doc_id", "keep_id", "group_size", (F.col("__uid") == F.col("__keep_uid")).alias("kept"), F.col("__sha").alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(normal) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents)
WINDOW same AS (PARTITION BY normal)
"""
}
