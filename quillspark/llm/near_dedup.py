"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

1. A document's set is its distinct 5-word shingles (64-bit hashes). Equal sets collapse to one
   node, the smallest doc_id. A node has 128 MinHash values.
2. Forest: 16 trees, each the nodes sorted by another run of 8 values. Nodes with the same first
   SHARED values of a tree are a run, and all pairs of a run are compared:
   a. Runs of up to WINDOW + 1 nodes stay in the sort, a range exchange by runs. There a node takes
      its nearest WINDOW on either side with any common prefix, which is its whole run and some nodes
      beyond it. Neighbours in two tasks meet through the first and last WINDOW rows of each task, so
      candidates do not depend on how the sort was partitioned. Pairs whose 4-bit sketches put the
      similarity below LIKELY are no candidates.
   b. Longer runs leave the sort. Their nodes are compared in blocks of bounded size, every block
      with every other, by sketches and then by all values, with LIKELY_BY_ALL as the bound.
3. Families are the connected components of candidates. The full sets of a family are compared in
   blocks of bounded size, every block with every other, so what counts as a link never depends on
   which neighbours the trees gave; a family merely has to be connected by them. A block's size
   follows the root of the family's, so a large family is dealt over many tasks without many copies.
4. Components of confirmed links give the result.

Defined results: a null or wordless text has an empty set and links with nothing. A row without
doc_id takes the component of an equal set that has one, else null, and then stays. Rows that
repeat a doc_id count as texts of one node. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .components import Forest, components, contracting
from .shared import hot_join, hot_keys, materialize, parts, quoted, small_join, table

TREES, DEPTH = 16, 8
#: Values that nodes of a run have in common. A pair at the threshold shares them in no tree with probability (1 - 0.75**3)**16, 0.0002.
SHARED = 3
VALUES = TREES * DEPTH
#: Neighbours on either side in each order.
WINDOW = 4
#: A sketch estimate under this is over four standard deviations below the threshold.
LIKELY = 0.57
#: The same for an estimate by all values, which are more exact.
LIKELY_BY_ALL = 0.58
#: Nodes that a block of a run holds, at least and at most.
FEW_NODES, RUN_NODES = 128, 4096
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Sets (at least and at most), and shingles, that a block of a family holds.
FEW_SETS, BLOCK_SETS, BLOCK_SHINGLES = 64, 2048, 1 << 20

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**64, VALUES, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES values of 64 bits for each set that isn't empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), VALUES), dtype=np.uint64)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], starts)
    return wordhash.mix(out)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in wordhash.slices(whole, "text"):
            sets = wordhash.shingle_sets(batch.column("text"))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            new = {k: i for i, k in enumerate(keys) if k is not None}  # copies within the slice are hashed once
            values: list[bytes | None] = [None] * len(sets)
            if new:
                short = minhash([sets[i] for i in new.values()]).astype(np.uint16)
                made = {k: row.astype(">u2").tobytes() for k, row in zip(new, short)}
                values = [made.get(k) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "n_shingles", "key", "values"])


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("values").to_pylist()), dtype=">u2").astype(np.uint16).reshape(-1, VALUES)


def _sketch(values: np.ndarray) -> np.ndarray:
    """Four bits of each value, two values a byte."""
    four = (values >> 6 & 15).astype(np.uint8).reshape(-1, VALUES // 2, 2)
    return four[:, :, 0] | four[:, :, 1] << 4


def _run(values: np.ndarray, t: int) -> np.ndarray:
    """The number of each node's run in a tree: the tree and its first SHARED values."""
    out = np.full(len(values), t, dtype=np.int64)
    for k in range(t * DEPTH, t * DEPTH + SHARED):
        out = out << 16 | values[:, k]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values = _values(batch)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(_run(values, t)), batch.column("node")], names=["run", "node"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _values(batch)
        sketch = _binary(_sketch(values))
        for t in range(TREES):
            rows = np.ascontiguousarray(values[:, t * DEPTH : (t + 1) * DEPTH].astype(">u2"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(_run(values, t)), _binary(rows.view(np.uint8)), batch.column("node"), sketch], names=["tree", "run", "prefix", "node", "sketch"])


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _similar(a: np.ndarray, b: np.ndarray, axis: int = 1) -> np.ndarray:
    """Whether four-bit sketches (64-bit words along an axis) leave the threshold possible; a sixteenth of unequal values agree by chance."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    unequal = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis)
    return unequal <= (1 - LIKELY) * 15 / 16 * VALUES


_EDGE_OR_BORDER = "a long, b long, part int, tree int, prefix binary, sketch binary"


def _pairs(rows: pa.RecordBatch | pa.Table, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of a tree -> pairs of nodes up to WINDOW places apart that may be similar; across: of two partitions only."""
    tree, node = rows.column("tree").to_numpy(), rows.column("node").to_numpy()
    prefix = np.frombuffer(b"".join(rows.column("prefix").to_pylist()), dtype=">u2").reshape(-1, DEPTH)
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(node), VALUES // 16)
    part = rows.column("part").to_numpy() if across else None
    found = []
    for k in range(1, min(WINDOW, len(node) - 1) + 1):
        near = (tree[k:] == tree[:-k]) & (prefix[k:, 0] == prefix[:-k, 0])
        at = np.flatnonzero(near & (part[k:] != part[:-k]) if across else near)
        at = at[_similar(sketch[at], sketch[at + k])]
        found.append((node[at], node[at + k]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's contracted candidates, then its first and last rows, by which it meets the partitions beside it."""
    forest, part = Forest(), TaskContext.get().partitionId()
    head: list[pa.RecordBatch] = []
    held: pa.Table | None = None
    n_head = seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n_head < WINDOW:
            head.append(batch.slice(0, WINDOW - n_head))
            n_head += head[-1].num_rows
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        for a, b in zip(*(x.tolist() for x in _pairs(rows))):
            forest.join(a, b)
        seen += batch.num_rows
        held = pa.Table.from_batches(rows.slice(max(0, rows.num_rows - WINDOW)).to_batches()).combine_chunks()
    edges = forest.edges()
    nothing = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
    yield pa.RecordBatch.from_arrays([*edges.columns, *nothing(edges.num_rows, pa.int32(), pa.int32(), pa.binary(), pa.binary())], names=["a", "b", "part", "tree", "prefix", "sketch"])
    if held is not None:
        tail = held.slice(max(0, held.num_rows - (seen - n_head)))  # without rows that the head has
        for rows in [*head, *tail.combine_chunks().to_batches()]:
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32)), rows.column("tree"), rows.column("prefix"), rows.column("sketch")], names=["a", "b", "part", "tree", "prefix", "sketch"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last rows of all partitions in order, a few of each -> candidates across their borders."""
    rows = pa.Table.from_batches(list(batches), schema=pa.schema([("node", pa.int64()), ("part", pa.int32()), ("tree", pa.int32()), ("prefix", pa.binary()), ("sketch", pa.binary())])).combine_chunks()
    a, b = _pairs(rows, across=True)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def alike(nodes: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Candidates that span the components of a run's nodes: whatever is reached is compared with what isn't reached yet."""
    out: list[tuple[int, int]] = []
    sketch = np.ascontiguousarray(_sketch(values).view(np.uint64).T)
    left, rest = np.arange(1, len(nodes)), sketch[:, 1:]
    queue = [0]
    while len(left):
        if not queue:
            queue, left, rest = [int(left[0])], left[1:], rest[:, 1:]
        u = queue.pop()
        maybe = np.flatnonzero(_similar(rest, sketch[:, u, None], 0))
        if len(maybe):
            hit = maybe[(values[left[maybe]] == values[u]).sum(1) >= LIKELY_BY_ALL * VALUES]
            if len(hit):
                found = left[hit]
                queue += found.tolist()
                out += [(int(nodes[u]), v) for v in nodes[found].tolist()]
                left, rest = np.delete(left, hit), np.delete(rest, hit, axis=1)
    return out


def _within_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, i, j, node, values) sorted by run, i, j -> candidates."""
    nodes, values, now = [], [], None

    def group():
        pairs = np.array(alike(np.concatenate(nodes), np.concatenate(values)) if nodes else [], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("run", "i", "j")], axis=1)
        node, own = batch.column("node").to_numpy(), _values(batch)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)]):
            if (key := tuple(keys[a].tolist())) != now:
                yield group()
                nodes, values, now = [], [], key
            nodes.append(node[a:b])
            values.append(own[a:b])
    yield group()


def candidates(nodes: DataFrame, n: int) -> DataFrame:
    """nodes (node, values) -> edges a, b that connect whatever shares a run and may be similar."""
    runs = nodes.mapInArrow(_runs, "run long, node long")
    long_runs = runs.groupBy("run").count().where(F.col("count") > WINDOW + 1).select("run", F.ceil(F.col("count") / F.least(F.lit(RUN_NODES), F.greatest(F.lit(FEW_NODES), 6 * F.sqrt("count")))).cast("int").alias("blocks"))
    long_runs = materialize(long_runs, "near-runs")

    trees = nodes.mapInArrow(_trees, "tree int, run long, prefix binary, node long, sketch binary")
    short = small_join(trees, long_runs, "run", "node", "left_anti")
    ordered = short.repartitionByRange(n, "run").sortWithinPartitions("run", "prefix", "node").select("tree", "prefix", "node", "sketch")
    met = materialize(ordered.mapInArrow(_neighbours, _EDGE_OR_BORDER), "near-neighbours")
    borders = met.where("tree IS NOT NULL").select(F.col("a").alias("node"), "part", "tree", "prefix", "sketch")  # at most 2 * WINDOW rows of each task
    run = F.conv(F.hex(F.substring("prefix", 1, 2 * SHARED)), 16, 10).cast("long")
    across = borders.repartition(1).sortWithinPartitions("part", "tree", run, "prefix", "node").mapInArrow(_across, "a long, b long")
    near = met.where("tree IS NULL").select("a", "b").union(across)

    placed = small_join(runs, long_runs, "run", "node").select("run", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    pairs = _block_pairs(placed.join(nodes.select("node", "values"), "node"), "run", "node", "values")
    grouped = pairs.repartition(n, "run", "i", "j").sortWithinPartitions("run", "i", "j")
    return near.union(grouped.mapInArrow(contracting(_within_runs), "a long, b long"))


def _block_pairs(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with key, blocks and block, once for every pair (i, j) of blocks that theirs is in."""
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"))))
    return rows.withColumn("other", other).select(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns)


def linked(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span the components of sets: whatever is reached is compared with what isn't reached yet."""
    out: list[tuple[int, int]] = []
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    own = [codes[a : a + n] for a, n in zip(starts, sizes)]
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int32)
    left = np.arange(len(sets))
    flat, flat_starts = codes, starts
    while len(left):
        queue, left = [int(left[0])], left[1:]
        flat, flat_starts = _flat(own, sizes, left)
        while queue and len(left):
            u = queue.pop()
            mark[own[u]] = 1
            both = np.add.reduceat(mark[flat], flat_starts)
            mark[own[u]] = 0
            hit = 100 * both >= percent * (sizes[u] + sizes[left] - both)
            if hit.any():
                queue += left[hit].tolist()
                out += [(ids[u], ids[v]) for v in left[hit]]
                left = left[~hit]
                flat, flat_starts = _flat(own, sizes, left)
    return out


def _flat(own: list[np.ndarray], sizes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([own[i] for i in left]), np.r_[0, np.cumsum(sizes[left])[:-1]]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, i, j, node, text) sorted by family, i, j -> confirmed links."""
    ids, sets, now = [], [], None

    def group():
        pairs = np.array(linked(ids, sets) if len(ids) > 1 else [], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for whole in batches:
        for batch in wordhash.slices(whole, "text"):
            where = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j"))))
            for g, node, s in zip(where, batch.column("node").to_pylist(), wordhash.shingle_sets(batch.column("text"))):
                if g != now:
                    yield group()
                    ids, sets, now = [], [], g
                if len(s):
                    ids.append(node)
                    sets.append(s)
    yield group()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    sketched = materialize(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, key binary, values binary"), "near-sketches")
    nodes = sketched.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.min("values").alias("values"), F.max("n_shingles").alias("n"))
    nodes = materialize(nodes, "near-nodes")
    n = parts(docs)

    families = components(candidates(nodes.where("node IS NOT NULL"), n))

    # blocks: as many for a family as bound its sets and its shingles
    sized = families.withColumnRenamed("label", "family").join(nodes.select("node", "n"), "node")
    per_block = F.least(F.lit(BLOCK_SETS), F.greatest(F.lit(FEW_SETS), 3 * F.sqrt("sets")))
    large = sized.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).withColumn("blocks", F.ceil(F.greatest(F.col("sets") / per_block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")).where("blocks > 1").select("family", "blocks")
    sized = materialize(sized, "near-sized")
    placed = small_join(sized, materialize(large, "near-large"), "family", "node", "left")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    placed = placed.select("node", "family", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    texts = placed.join(docs.withColumnRenamed("doc_id", "node"), "node")
    pairs = _block_pairs(texts, "family", "node", "text")
    grouped = pairs.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    found = components(grouped.mapInArrow(contracting(_confirm), "a long, b long"))

    by_key = nodes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    rows = sketched.select("doc_id", "n_shingles", "key")
    out = hot_join(rows, by_key, "key", hot_keys(rows, "key"))  # a third of all rows may share a key
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("label"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that a smaller doc_id of their component stands for."""
    gone = near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL: dict = {}
