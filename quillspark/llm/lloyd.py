"""Centroid clustering of integer vectors: plain Lloyd.

Components become whole numbers, so distances, sums and means are exact and runs agree. The numbers
are written once and read by every pass. In a pass each task gets the centroids, ROUNDS times K rows
at most, takes the squared differences to one centroid after the other in NumPy and the lowest index
of the smallest. A round's tasks each report one row a centroid they met: its number of vectors and
the sums of their components; Spark adds these up, and at most K rows reach the driver, which divides
them. Rows hold one vector each and are dealt out evenly, so neither a crowded cluster nor a repeated
vector makes a task larger.

Defined results: vectors that are null, of another length or hold a null or non-finite component take
no part; a component whose whole number is beyond LARGEST raises an error that names the vec_id, as
squared distances would leave 64 bits; rows without vec_id take part but come last in the order that
picks the first centroids; where that order ties (a vec_id that repeats) the lesser vector comes first,
and each of its rows can be a centroid; with fewer vectors than K there are as many centroids as
vectors; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Whole numbers up to here have squared distances, of 64 components, of 64 bits.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q, an array of whole numbers: the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.coalesce((F.size("e") == dim) & sound, F.lit(False)))
    beyond = F.concat(F.lit("a component is too large in the vector with vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    within = F.forall("e", lambda x: F.abs(x) * scale <= LARGEST)
    return kept.select("vec_id", F.when(within, F.transform("e", lambda x: F.floor(x * scale).cast("int"))).otherwise(F.raise_error(beyond).cast("array<int>")).alias("q"))


def first_centroids(data: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the smallest sha256, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = data.select(order.alias("hash"), "q").orderBy(F.col("hash").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], dtype=np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the lowest index of a nearest centroid, and its squared distance."""
    distances = np.empty((len(centroids), len(vectors)), dtype=np.int64)
    for i, centroid in enumerate(centroids):
        apart = vectors - centroid
        distances[i] = np.einsum("ij,ij->i", apart, apart)
    best = distances.argmin(axis=0)
    return best, distances[best, np.arange(len(vectors))]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def _sums(centroids: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for frame in frames:
            if len(frame):
                vectors = _matrix(frame["q"])
                best, _ = nearest(vectors, centroids)
                counts += np.bincount(best, minlength=len(centroids))
                for i in np.unique(best):
                    sums[i] += vectors[best == i].sum(axis=0)
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": met.astype(np.int32), "n": counts[met], "sums": list(sums[met])})

    return run


def _assign(centroids: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                best, distance = nearest(_matrix(frame["q"]), centroids)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": best.astype(np.int32), "distance": distance})

    return run


def moved(data: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of means, and empty ones where they were."""
    parts = data.select("q").mapInPandas(_sums(centroids), "cluster int, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)  # noqa: E731  # sums of 64-bit sums
    merged = parts.select("cluster", "n", F.posexplode("sums").alias("place", "sum")).groupBy("cluster", "place").agg(exact("n"), exact("sum"))
    after = centroids.copy()
    for row in merged.collect():  # a row a component of a centroid
        after[row["cluster"], row["place"]] = int(row["sum"]) // int(row["n"])
    return after


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that takes part, and the centroids. vectors has vec_id and embedding."""
    data = materialize(quantised(vectors, dim, scale), "lloyd-vectors")
    centroids = first_centroids(data, k, seed)
    if not len(centroids):
        return data.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(data, centroids)
    return materialize(data.mapInPandas(_assign(centroids), "vec_id long, cluster int, distance long"), "lloyd-assigned"), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, q) - 1 AS cluster, q FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v.q, cluster, {apart} AS distance FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS q
  FROM (SELECT cluster, j, sum(q[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, q, unnest(range(1, {DIM + 1})) AS j FROM a{i}) GROUP BY ALL) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, a.cluster::INT AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


SQL = {"op11_centroid_clustering": _oracle()}
