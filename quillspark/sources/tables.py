"""Input tables, and documents seen as units of works: each document is a unit, its source the work, its language the tradition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores, dealt out: a file with one row group is one task however much work its texts are. Larger tables stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, source, tradition, title (the first line's first 80 characters), content, sequence."""
    docs = spread(table(spark, sf_dir, "documents"))
    content = F.coalesce("text", F.lit(""))
    title = F.substring(F.element_at(F.split(content, "\n"), 1), 1, 80)
    return docs.select(F.col("doc_id").alias("unit_id"), "source", F.col("lang").alias("tradition"), title.alias("title"), content.alias("content"), F.col("doc_id").alias("sequence"))


#: units() for the oracle; a WITH clause goes on after it.
UNITS_SQL = """units AS (
  SELECT doc_id AS unit_id, source, lang AS tradition, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) AS title, coalesce(text, '') AS content, doc_id AS sequence FROM documents
)"""
