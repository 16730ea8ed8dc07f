"""The catalogue of a corpus: a card for each work, totals, contents of collections, and its export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .excerpts import excerpts
from .library import parse_notes, shelf

# Notes that a card does not repeat, and what stands for a missing field.
NOISE = r"^(?:Ingested from|Rights:|Print basis:|From )"
ANONYMOUS, UNATTRIBUTED, TEXT, CORE = "Anonymous", "Unattributed", "Text", "core"


def _or(column: Column, other: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(other))


def cards(works: DataFrame, units: DataFrame, fragments: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each work, those without units as well.

    works: source, title, author, date_composed, source_url, license, notes, tradition, source_type;
    fragments: source, fragment; members: collection, fragment. Text is read once for sizes and once
    for the first units; what joins has a row for each work.
    """
    within = members.groupBy("fragment").agg(F.array_sort(F.collect_set("collection")).alias("collections"))
    rows = works.join(shelf(units), "source", "left").join(excerpts(units), "source", "left").join(fragments, "source", "left")
    rows = rows.withColumn("fragment", F.coalesce("fragment", F.lit(CORE))).join(within, "fragment", "left").withColumn("note", parse_notes(F.col("notes")))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "source", "title", _or(F.col("author"), ANONYMOUS).alias("author"), blank("date_composed").alias("dates"), _or(F.col("tradition"), UNATTRIBUTED).alias("tradition"),
        _or(F.col("source_type"), TEXT).alias("type"), n("n_units"), n("n_chars"), blank("source_url").alias("url"), "license", "fragment", (F.col("fragment") == CORE).alias("bundled"),
        F.coalesce("collections", F.array().cast("array<string>")).alias("collections"), F.coalesce("excerpt", F.lit("")).alias("excerpt"),
        *(F.col(f"note.{c}").alias(c) for c in ("translator", "edition", "rights", "corroboration")), F.col("note.source").alias("origin"),
        F.filter("note.extra", lambda x: ~x.rlike(NOISE)).alias("notes"),
    )


def totals(shown: DataFrame) -> DataFrame:
    """One row: works, units, characters, distinct authors and traditions of some cards."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return shown.agg(F.count("*").alias("n_sources"), total("n_units"), total("n_chars"), F.countDistinct("author").alias("n_authors"), F.countDistinct("tradition").alias("n_traditions"))


def collection_sizes(shown: DataFrame, collections: DataFrame) -> DataFrame:
    """Every collection (collection, …) with the number of works in it, 0 for an empty one."""
    each = shown.select(F.explode("collections").alias("collection")).groupBy("collection").agg(F.count("*").alias("n_sources"))
    return collections.join(each, "collection", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)).cast("long"))


def contents(shown: DataFrame) -> DataFrame:
    """fragment, kind (author, title, tradition) and value: what a fragment holds, each once."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("author", "title", "tradition")))
    return shown.select("fragment", F.inline(kinds)).where("value IS NOT NULL").distinct()


def merged(parts: DataFrame, tags: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents and tags of collections from those of their fragments: names as the union of sets, tags (fragment, slug, n) as sums. Both stay long, so no collection is one row."""
    own = members.select("collection", "fragment").distinct()
    names = parts.join(own, "fragment").select("collection", "kind", "value").distinct()
    return names, tags.join(own, "fragment").groupBy("collection", "slug").agg(F.sum("n").cast("long").alias("n"))


def export(shown: DataFrame, collections: DataFrame, path: str) -> None:
    """The catalogue as JSON lines: cards in order of author (anonymous last) and title, totals, and collections with their sizes, a folder each."""
    ordered = shown.orderBy((F.col("author") == ANONYMOUS), "author", "title", "source")
    for name, rows in (("sources", ordered), ("totals", totals(shown)), ("collections", collection_sizes(shown, collections))):
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
