"""Exact top-k inner products by distributed selection on score histograms.

Vectors are quantised to integers, so scores are exact. Queries are taken in blocks of QUERY_BLOCK
vectors, the only thing sent to every executor; every task scores its vectors against the block:

1. Each round, a task sorts its scores into BINS bins between a query's bounds and reports the bins
   from the top until they hold k scores: at most k rows a query. Spark adds the counts; the bin in
   which a query's k-th score lies becomes its new bounds. Rounds end when all bins have width 1.
   A task's lower bins cannot matter: the global k-th score is no lower than the task's own.
2. Each task emits its scores at or above the k-th score, of equal ones the smallest vec_ids, at
   most k a query; ranking these few rows by score and vec_id gives the result.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows
without vec_id, take no part; quantised components are whole numbers of 64 bits, and those beyond
are the largest there is; products are summed without overflow, and a score beyond 64 bits is the
largest (or smallest) there is; only vectors of the same length have a score; rows with the query's
own vec_id are no candidates; a vec_id that repeats is one query for each of its rows, and as a
candidate each of its rows counts; an empty table gives an empty result. Other columns are not read.

A block of queries costs a pass over the vectors for each round of histograms, usually two, and one
to emit: exact search of n queries is n / QUERY_BLOCK times three passes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, parts, shared_dir, table

K, SCALE, EVERY = 5, 256, 50
BINS = 512
#: Queries in a block: with 64 components 2 MB, where they fit 64 bits.
QUERY_BLOCK = 4096
#: Scores that a task holds at a time.
CELLS = 1 << 21
#: The largest double below 2**63.
_LARGEST = float((1 << 63) - 1024)
_SIGN = 1 << 63


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            if isinstance(column, pa.ExtensionArray):
                column = column.storage
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = (sizes > 0) & (np.bincount(row, weights=~np.isfinite(values), minlength=len(sizes)) == 0) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * scale), -float(1 << 63), _LARGEST).astype(np.int64)
            wide = np.bincount(row, weights=(q != q.astype(np.int32)), minlength=len(sizes)) > 0
            for rows, kind in ((good & ~wide, np.int32), (good & wide, np.int64)):  # 8 bytes a component where 4 do not hold it
                n = sizes[rows]
                offsets = np.r_[0, np.cumsum(np.dtype(kind).itemsize * n)].astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(q[rows[row]].astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(rows)), pa.array(n.astype(np.int32)), packed], names=["vec_id", "dim", "q"])

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, dim and q: the vectors that take part, as integers of 32 bits or, where these are too few, 64."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    return rows.repartition(parts(vectors)).mapInArrow(_quantise(scale), "vec_id long, dim int, q binary")


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(1))


def _exact(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products: in floating point while every partial sum fits its mantissa, beyond 64 bits as Python's integers."""
    bound = _norms(queries).max(initial=0) * _norms(others).max(initial=0) * 1.001  # Cauchy-Schwarz holds for partial sums too
    if bound >= 2**63:
        wide = queries.astype(object) @ others.astype(object).T
        return np.clip(wide, -_SIGN, _SIGN - 1).astype(np.int64)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (queries.astype(kind) @ others.astype(kind).T).astype(np.int64)


def _scores(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of all pairs; a few large vectors do not slow the others down."""
    out = np.empty((len(queries), len(others)), dtype=np.int64)
    classes = [[np.flatnonzero(size == k) for k in np.unique(size)] for size in (np.searchsorted([2.0**26, 2.0**31], _norms(m), side="right") for m in (queries, others))]
    if len(classes[0]) == len(classes[1]) == 1:
        return _exact(queries, others)
    for a in classes[0]:
        for b in classes[1]:
            out[np.ix_(a, b)] = _exact(queries[a], others[b])
    return out


def _unsigned(scores: np.ndarray) -> np.ndarray:
    """Scores as unsigned numbers of the same order."""
    return np.ascontiguousarray(scores).view(np.uint64) ^ np.uint64(_SIGN)


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length and width."""
    flat = b"".join(packed)
    return np.frombuffer(flat, dtype=np.int32 if len(flat) == 4 * dim * len(packed) else np.int64).reshape(len(packed), dim)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The batch's vectors by length and width: length, ids, matrix."""
    if not batch.num_rows:
        return
    dims, ids = batch.column("dim").to_numpy().astype(np.int64), batch.column("vec_id").to_numpy()
    kinds = dims * 16 + pc.binary_length(batch.column("q")).to_numpy() // dims
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        yield kind // 16, ids[at], _matrix(batch.column("q").take(pa.array(at)).to_pylist(), kind // 16)


def _pieces(held: dict, batches: Iterator[pa.RecordBatch]):
    """Pieces of bounded size: length, ids of the piece, scores of the queries with it, which of them count."""
    for batch in batches:
        for dim, ids, matrix in _vectors(batch):
            if dim in held:
                _, own, queries, _, _ = held[dim]
                step = max(1, CELLS // max(1, len(own)))
                for a in range(0, len(ids), step):
                    yield dim, ids[a : a + step], _scores(queries, matrix[a : a + step]), ids[None, a : a + step] != own[:, None]


def _histogram(blocks, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = blocks.value, {}
        for dim, _, s, use in _pieces(held, batches):
            _, own, _, lo, width = held[dim]
            u = _unsigned(s)
            use &= u >= lo[:, None]
            bins = ((u - lo[:, None]) // width[:, None]).astype(np.float64)  # below the bounds: not in use
            cell = np.arange(len(own))[:, None] * (BINS + 1) + np.minimum(bins, BINS).astype(np.int64)  # above the bounds: one bin more
            counts = np.bincount(cell[use], minlength=len(own) * (BINS + 1))
            sums[dim] = sums.get(dim, 0) + counts
        for dim, counts in sums.items():
            counts = counts.reshape(-1, BINS + 1)
            above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(q + held[dim][0]), pa.array(b), pa.array(counts[q, b])], names=["query", "bin", "n"])

    return run


def _best(blocks, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = blocks.value
        for dim, ids, s, use in _pieces(held, batches):
            first, _, _, lo, _ = held[dim]
            q, c = np.nonzero(use & (_unsigned(s) >= lo[:, None]))
            score = s[q, c]
            order = np.lexsort((ids[c], ~score, q))
            q, c, score = q[order], c[order], score[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays([pa.array(q[keep] + first), pa.array(ids[c[keep]]), pa.array(score[keep])], names=["query", "vec_id", "score"])

    return run


def _queries(rows: list) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Collected queries by length: number of the first, ids, matrix."""
    out, first = {}, 0
    for dim in sorted({r["dim"] for r in rows}):
        own = [r for r in rows if r["dim"] == dim]
        matrix = np.array([np.frombuffer(bytes(r["q"]), dtype=np.int32 if len(r["q"]) == 4 * dim else np.int64) for r in own], dtype=np.int64)
        out[dim] = first, np.array([r["vec_id"] for r in own], dtype=np.int64), matrix
        first += len(own)
    return out


def _kth(counts: DataFrame, k: int) -> list:
    """For each query the bin that holds the k-th score, or the lowest one if there are fewer scores."""
    sums = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query").orderBy(F.col("bin").desc())
    above = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1))
    return sums.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < k).groupBy("query").agg(F.min("bin").alias("bin")).collect()


def _block_result(data: DataFrame, rows: list, k: int, largest: dict[int, float]) -> DataFrame:
    spark = data.sparkSession
    found = _queries(rows)
    bounds = {}
    for dim, (_, _, m) in found.items():
        reach = [min(_SIGN, int(n * largest[dim] * 1.0001) + 2) for n in _norms(m).tolist()]
        bounds[dim] = np.array([_SIGN - r for r in reach], dtype=np.uint64), np.array([2 * r // BINS + 1 for r in reach], dtype=np.uint64)

    def sent(lo: dict, width: dict):
        return spark.sparkContext.broadcast({d: (first, ids, m, lo[d], width[d]) for d, (first, ids, m) in found.items()})

    lo = {d: b[0] for d, b in bounds.items()}
    span = {d: b[1] for d, b in bounds.items()}
    while True:
        counts = data.mapInArrow(_histogram(sent(lo, span), k), "query long, bin long, n long")
        for r in _kth(counts, k):  # at most a row for each query of the block
            dim = next(d for d in reversed(list(found)) if found[d][0] <= r["query"])
            lo[dim][r["query"] - found[dim][0]] += np.uint64(r["bin"]) * span[dim][r["query"] - found[dim][0]]
        if all((w == 1).all() for w in span.values()):
            break
        span = {d: (w - np.uint64(1)) // np.uint64(BINS) + np.uint64(1) for d, w in span.items()}
    best = data.mapInArrow(_best(sent(lo, span), k), "query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    names = spark.createDataFrame([(int(first + i), int(x)) for first, ids, _ in found.values() for i, x in enumerate(ids.tolist())], "query long, query_id long")
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = K, scale: int = SCALE, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query. vectors has vec_id and embedding."""
    data = materialize(quantised(vectors, scale=scale), "topk-vectors")
    is_query = is_query if is_query is not None else F.col("vec_id") % EVERY == 0
    largest = {r["dim"]: r["m"] for r in data.mapInArrow(_largest, "dim int, m double").groupBy("dim").agg(F.max("m").alias("m")).collect()}
    numbered = data.where(is_query).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id() % (1 << 33))
    numbered = materialize(numbered, "topk-queries")
    sizes = sorted(numbered.groupBy("__part").count().collect())
    base, starts = 0, []
    for part, n in sizes:
        starts.append((part, base))
        base += n
    place = numbered.join(F.broadcast(vectors.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, base long")), "__part").withColumn("place", F.col("__row") + F.col("base"))
    results = f"{shared_dir(vectors.sparkSession)}/topk-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, vec_id long, score long"
    for a in range(0, base, block):  # results are appended, so their plan does not grow with the blocks
        rows = place.where((F.col("place") >= a) & (F.col("place") < a + block)).select("vec_id", "dim", "q").collect()
        _block_result(data, rows, k, largest).write.mode("append").parquet(results)
    return vectors.sparkSession.read.schema(schema).parquet(results) if base else vectors.sparkSession.createDataFrame([], schema)


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest norm of each length in a batch."""
    for batch in batches:
        found = [(dim, float(_norms(m).max(initial=0))) for dim, _, m in _vectors(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([m for _, m in found], pa.float64())], names=["dim", "m"])


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = {
    "op10_exact_topk": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
}
