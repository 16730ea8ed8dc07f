"""Versioned tables: a set of Parquet tables is written to a folder of its own and becomes current as a whole.

A version is complete when its row in the log is written, which happens after all of its tables;
readers take the highest version in the log. So a job that dies, or an executor that is lost, leaves
the current version as it was. A number is claimed before anything is written under it, so two jobs
that publish at once get two versions; a number whose job died is not used again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "version long, id_space int, model string, tables array<string>"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The log of complete versions; empty where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{root}/_versions")


def current(spark: SparkSession, root: str) -> int:
    """The latest version, 0 for none."""
    return versions(spark, root).agg(F.max("version")).first()[0] or 0


def _claimed(spark: SparkSession, root: str, version: int) -> bool:
    """Whether this writer is the first to take a version's number: creating its mark is one step in the file system, so of two writers one fails and moves on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_claims/v{version}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(path)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], id_space: int, model: str, partition_by: dict[str, str] | None = None, dry_run: bool = False, keys: dict[str, list[str]] | None = None) -> int:
    """Write all tables as the next version and make it current; a dry run says which version it would be. keys: what must be unique in a table; if it is not, nothing is written, dry run or not."""
    for name, key in (keys or {}).items():
        twice = tables[name].groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n").head(3)
        if twice:
            raise ValueError(f"{name}: keys that occur more than once, such as {[tuple(r) for r in twice]}")
    version = current(spark, root) + 1
    if dry_run:
        return version
    while not _claimed(spark, root, version):
        version += 1
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        by = (partition_by or {}).get(name)
        (writer.partitionBy(by) if by else writer).parquet(f"{root}/v{version}/{name}")
    spark.createDataFrame([(version, id_space, model, sorted(tables))], LOG).write.mode("append").parquet(f"{root}/_versions")
    return version


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/v{version or current(spark, root)}/{name}")


def merged(old: DataFrame, new: DataFrame, key: list[str], keep_old: bool = False) -> DataFrame:
    """old and new as one; of rows with the same key the new one (or, keep_old, the old one) stays."""
    if keep_old:
        return old.unionByName(new.join(old.select(*key), key, "left_anti"))
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def collisions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys that an append would repeat: it must have none."""
    return new.join(old.select(*key), key, "left_semi").select(*key)


FRAGMENT = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("file", T.StringType()), ("bytes", T.LongType()), ("sha256", T.StringType()), ("sources", T.IntegerType()), ("units", T.IntegerType()), ("chunks", T.IntegerType()))])
COLLECTION = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "kind", "name", "description")] + [T.StructField("fragments", T.ArrayType(T.StringType()))])
MANIFEST = T.StructType([T.StructField("corpusVersion", T.IntegerType()), T.StructField("idSpace", T.IntegerType()), T.StructField("embeddingModel", T.StringType()), T.StructField("fragments", T.ArrayType(FRAGMENT)), T.StructField("collections", T.ArrayType(COLLECTION))])


def manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a manifest file: fragments and the fragments of each collection. A missing idSpace is 1; a file that is no manifest fails."""
    doc = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path, multiLine=True).withColumn("idSpace", F.coalesce("idSpace", F.lit(1)))
    fragments = doc.select("corpusVersion", "idSpace", "embeddingModel", F.explode("fragments").alias("f")).select("f.*", "idSpace", "embeddingModel")
    members = doc.select(F.explode("collections").alias("c")).select(F.col("c.id").alias("collection"), F.explode("c.fragments").alias("fragment"))
    return {"fragments": fragments, "members": members}


def catalogue_json(rows: DataFrame, key: str) -> DataFrame:
    """One line of JSON for each row, for files that other programs read."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


_CONTENTS = "struct<name: string, authors: array<string>, titles: array<string>, tags: map<string, int>, traditions: array<string>>"


def _document(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON file that is one object; one that is not fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def catalogue(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a catalogue file: contents (level, id, kind, value) of packs and fragments, their tags (level, id, slug, n), and core's tags. What is missing in the file is empty."""
    doc = _document(spark, path, f"packs map<string, {_CONTENTS}>, core map<string, int>, fragments map<string, {_CONTENTS}>")
    level = lambda name: doc.select(F.lit(name).alias("level"), F.explode(name).alias("id", "c"))
    held = level("packs").unionByName(level("fragments"))
    of_kind = lambda kind: F.transform(F.coalesce(f"c.{kind}s", F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    named = F.flatten(F.array(*map(of_kind, ("author", "title", "tradition"))))
    return {"contents": held.select("level", "id", F.inline(named)), "tags": held.select("level", "id", F.explode("c.tags").alias("slug", "n")), "core": doc.select(F.explode("core").alias("slug", "n"))}


def withdrawn(spark: SparkSession, path: str) -> DataFrame:
    """id and reason of works that were taken out on purpose."""
    return _document(spark, path, "withdrawn array<struct<id: string, reason: string>>").select(F.inline("withdrawn"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a published build: id_space, and source, min, max, count and hash of each work."""
    doc = _document(spark, path, "idSpace int, sources map<string, struct<min: long, max: long, count: long, hash: string>>")
    return doc.select(F.coalesce("idSpace", F.lit(1)).alias("id_space"), F.explode("sources").alias("source", "r")).select("id_space", "source", "r.*")


def unit_files(spark: SparkSession, path: str) -> DataFrame:
    """Units from JSON files, each an array of objects: file, title, content, and sequence as the place in the file."""
    rows = spark.read.schema("units array<struct<title: string, content: string>>").json(path, multiLine=True)
    return rows.select(F.input_file_name().alias("file"), F.posexplode("units").alias("sequence", "u")).select("file", "sequence", "u.*")
