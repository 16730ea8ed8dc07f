"""A release of a corpus: fragments as folders of files, a manifest with their sizes and digests, and a check of what lies there.

Tables are written first, then read back file by file, then the manifest is written, and the ledger at
the very end: a folder without manifest is no release, and a ledger never speaks of one that is not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a file, so that the digest of each is taken of some hundred MB at most where texts are of usual length.
ROWS_A_FILE = 100_000


def described(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """fragment, sources, units and chunks, of units (fragment, source) and chunks (fragment); works are counted once a work, so a fragment of a third of all units is a row a work."""
    works = units.groupBy("fragment", "source").agg(F.count("*").alias("u"))
    own = works.groupBy("fragment").agg(F.count("*").cast("int").alias("sources"), F.sum("u").cast("int").alias("units"))
    parts = chunks.groupBy("fragment").agg(F.count("*").cast("int").alias("chunks"))
    return own.join(parts, "fragment", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def listed(collections: DataFrame, members: DataFrame, built: DataFrame) -> DataFrame:
    """collections (id, …) with the fragments that were built, in the order of members (collection, nth, fragment), each once; a collection without any is left out."""
    there = members.groupBy("collection", "fragment").agg(F.min("nth").alias("nth")).join(built.select("fragment"), "fragment", "left_semi")
    own = there.groupBy(F.col("collection").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "fragment"))), lambda m: m["fragment"]).alias("fragments"))
    return collections.join(own, "id")


def files(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    """fragment, bytes and sha256 of what lies under root: bytes add up, and so do 60 bits of each file's digest, of which the digest of the fragment is made."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{root}/{t}" for t in tables])
    name = F.url_decode(F.replace(F.regexp_extract("path", r"/fragment=([^/]*)/[^/]*\z", 1), F.lit("+"), F.lit("%2B")))
    table = F.regexp_extract("path", r"/([^/]+)/fragment=[^/]*/[^/]*\z", 1)
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", table, F.sha2("content", 256)), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return raw.select(name.alias("fragment"), "length", bits.alias("bits")).groupBy("fragment").agg(F.sum("length").cast("long").alias("bytes"), F.sha2(F.sum("bits").cast("string"), 256).alias("sha256"))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], collections: DataFrame, members: DataFrame, version: int, id_space: int, model: str, ledger: DataFrame | None = None) -> str:
    """Write a release and return the path of its manifest, which sources.snapshots.manifest reads.

    tables: units (fragment, source, …) and chunks (fragment, …), and any others with a fragment;
    collections: id, kind, name, description. The manifest is one document, so it has a row for each
    fragment and collection in one task; works and units are not in it.
    """
    for name, df in tables.items():
        df.write.mode("errorifexists").option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("fragment").parquet(f"{root}/{name}")
    back = {name: spark.read.schema(df.schema).parquet(f"{root}/{name}") for name, df in tables.items() if name in ("units", "chunks")}
    built = described(back["units"], back["chunks"]).join(files(spark, root, list(tables)), "fragment")
    each = F.struct(F.col("fragment").alias("id"), F.concat(F.lit("fragment="), "fragment").alias("file"), "bytes", "sha256", "sources", "units", "chunks")
    fragments = built.agg(F.array_sort(F.collect_list(each)).alias("fragments"))
    groups = listed(collections, members, built).agg(F.array_sort(F.collect_list(F.struct("id", "kind", "name", "description", "fragments"))).alias("collections"))
    head = (F.lit(version).alias("corpusVersion"), F.lit(id_space).alias("idSpace"), F.lit(model).alias("embeddingModel"))
    fragments.crossJoin(groups).select(*head, "fragments", "collections").coalesce(1).write.mode("errorifexists").json(f"{root}/manifest")
    if ledger is not None:
        ledger.withColumn("id_space", F.lit(id_space)).write.mode("errorifexists").parquet(f"{root}/ledger")
    return f"{root}/manifest"


def damaged(spark: SparkSession, root: str, tables: list[str], fragments: DataFrame) -> DataFrame:
    """id and why of fragments (id, bytes, sha256: those of the manifest) that do not lie under root as they were written."""
    now = files(spark, root, tables).select(F.col("fragment").alias("id"), F.col("bytes").alias("n"), F.col("sha256").alias("digest"))
    why = F.when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("bytes"), "size").when(F.col("digest") != F.col("sha256"), "content")
    return fragments.join(now, "id", "left").select("id", why.alias("why")).where("why IS NOT NULL")
