"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights by water filling, and every
document is emitted floor(rate) times plus one more time with the probability of the rest.
The draw is a hash of seed and doc_id, so reruns and retried tasks agree.

Defined results: a null text has size 0; a null source is a source of its own and sorts last;
rows that repeat a doc_id draw alike; a source without words has target 0 and its documents
are taken 0 times (they hold no words); an empty table gives an empty result. Columns that a
caller's table has besides doc_id, text and source pass through mix() whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, quoted, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
#: One row of about 60 bytes for each source: up to this many are sent to every executor.
BROADCAST_SOURCES = 100_000


def source_targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size) -> with target, by water filling.

    A source's weight is that of its place by code point. Its target is min(most * size, level *
    weight); sources sorted by most * size / weight reach their limit in this order, so the level
    follows from running sums over the table of sources, which is small beside the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(most))
    ordered = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    reached = weighed.withColumn("level", level).withColumn("place", F.row_number().over(ordered))
    open_ = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct("place", "level"))
    first = F.min(open_).over(everything)  # from this source on nothing reaches its limit
    capped = first.isNull() | (F.col("place") < first["place"])
    target = F.when(capped, F.col("most")).otherwise(first["level"] * F.col("weight"))
    return reached.withColumn("target", target).select("source", "source_size", "weight", "target")


def draw(doc_id, seed: int = SEED):
    """A number in [0, 1) from seed and doc_id: 32 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _with_copies(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """rows with `source`, `size` and doc_id -> with source_size, target and copies. No shuffle of rows while sources are few."""
    rates = targets.select(F.col("source").alias("__source"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"))
    few = targets.count() <= BROADCAST_SOURCES
    if few:
        joined = rows.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("__source")))
    else:  # the hot source is dealt over salts, each of which has its own copy of the rate
        salts = 32
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("__s", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__s") == F.col("__salt"))).drop("__s", "__salt")
    whole = F.floor("__rate")
    extra = (draw(F.col("doc_id"), seed) < F.col("__rate") - whole).cast("long")
    return joined.withColumn("copies", (whole + extra).cast("long")).drop("__source", "__rate")


def mixture(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, share, most), "mix-targets")
    return _with_copies(sized, targets, seed)


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: the columns of docs, each row as often as the mix takes it."""
    sizes = docs.select("source", word_count(F.col("text")).alias("__size"))
    totals = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, share, most), "mix-targets")
    inner = docs.select("doc_id", "source", F.struct(*map(quoted, docs.columns)).alias("__row"))
    taken = _with_copies(inner, targets, seed).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("__row", F.col("copies").cast("int"))).alias("__row")).select("__row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _sql() -> str:
    weight = "[{}][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {} + 1)::INT]".format(", ".join(f"{w}::DOUBLE" for w in WEIGHTS), len(WEIGHTS))
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, {weight} AS weight, source_size * {MOST}::DOUBLE AS most FROM totals
), levels AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source ASC NULLS LAST) AS place, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN first IS NULL OR place < first THEN most ELSE arg_min(level, place) FILTER (WHERE place = first) OVER () * weight END AS target
  FROM (SELECT *, min(place) FILTER (WHERE most >= level * weight) OVER () AS first FROM levels)
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""


SQL = {"op3_mix_sources": _sql()}
