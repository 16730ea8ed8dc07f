"""What the operators share: the folder for intermediate tables, and reading input tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space, as a regular expression class.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


#: Bytes of rows that go to a Python worker at once. Texts can be long, and a worker holds a batch several times over.
BATCH_BYTES = 8 << 20
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Smaller batches than Spark's own, unless the session has set a size."""
    if spark.conf.get(_BATCH).rstrip("b") == _SPARKS_OWN:
        spark.conf.set(_BATCH, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is unset and everything runs on one machine (tests, a laptop) a temporary
    folder takes its place; on a cluster that would be the driver's own disk, so it fails at once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs a re-read."""
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit range partitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored; one of fewer partitions than cores, such as a file with one row group, is dealt out over them."""
    bounded_batches(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def word_count(text) -> F.Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Tables of up to this many short rows are sent to every executor.
BROADCAST_ROWS = 100_000
SALTS = 32


def small_join(rows: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """Equi-join (inner, left or left_anti) with a table of aggregates, which has a key at most once.

    A broadcast while the table is small, else over salted keys, by which a hot key's rows are
    dealt out on `spread`.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


#: A key that more rows than this share can be hot.
HOT_ROWS = 10_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """Keys of more than HOT_ROWS rows and more than one in BROADCAST_ROWS of all, so there are fewer than BROADCAST_ROWS; None if there is none."""
    counts = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).count(), "hot-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") > max(HOT_ROWS, total // BROADCAST_ROWS)).select(key)
    return None if hot.isEmpty() else hot


def hot_join(rows: DataFrame, unique: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Left join with a table that has a key at most once: hot keys' part of it is broadcast, the others' rows meet by a shuffle."""
    if hot is None:
        return rows.join(unique, key, "left")
    found = materialize(unique.join(F.broadcast(hot), key, "left_semi"), "hot-rows")
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(unique, key, "left")
    return rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(found), key, "left").unionByName(cold)


def quoted(name: str) -> F.Column:
    """The column of this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shielded(docs: DataFrame, needed: tuple[str, ...]):
    """docs with all columns but the needed ones under names that no operator uses, and a function that puts a result's names back."""
    bounded_batches(docs.sparkSession)
    inner = [c if c in needed else f"_{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*(quoted(c).alias(n) for c, n in zip(docs.columns, inner))), lambda df: df.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, inner)))
