"""What a catalogue shows of a work, and which models a device is offered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .library import openings

#: An excerpt's length; the least length of a paragraph, and of a whole unit where no paragraph will do.
LENGTH, PARAGRAPH, WHOLE = 400, 80, 60
#: A sentence end counts from here on.
SENTENCE_FROM = 241
# How front matter begins.
FRONT = r"^(?:BY|By|Translated|Edited|PREFACE|CONTENTS)\b"
APPARATUS = r"^(?:The following are the contents|Contents of|[A-Z][A-Za-z.'\- ]+,\s*(?:D\.D\.|M\.A\.|LL\.D\.|Ph\.D\.|B\.D\.)[,.]?\s)"


def front_matter(text: Column) -> Column:
    """Title pages, bylines and the like, in text whose white space is squeezed: more capitals than other letters, or a beginning that prose does not have."""
    capitals, letters = F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{L}"))
    return (2 * capitals > letters) | (letters == 0) | text.rlike(APPARATUS) | text.rlike("(?i)\\btranscriber") | ((F.length(text) < 120) & text.rlike(FRONT))


def shortened(text: Column) -> Column:
    """At most LENGTH characters: up to the last sentence end if that lies beyond SENTENCE_FROM, else up to the last word and an ellipsis."""
    head = F.left(text, F.lit(LENGTH))
    sentences, words = F.regexp_extract(head, r"(?s)^(.*[.?!]) ", 1), F.regexp_extract(head, "(?s)^(.*) ", 1)
    cut = F.when(F.length(sentences) > SENTENCE_FROM, sentences).otherwise(F.concat(F.regexp_replace(F.when(words == "", head).otherwise(words), "[,;:]+$", ""), F.lit("…")))
    return F.when(F.length(text) <= LENGTH, text).otherwise(cut)


def _first_prose(passages: Column, least: int) -> Column:
    """The first of some passages that is prose, without an editor's label in brackets; null if none is."""
    bare = F.transform(passages, lambda p: F.regexp_replace(T.squeeze(p), r"^\[[^\]]{1,12}\]\s*", ""))
    return F.get(F.filter(bare, lambda p: (F.length(p) >= least) & ~front_matter(p)), F.lit(0))


def excerpts(units: DataFrame, n: int = 3) -> DataFrame:
    """source and excerpt, from the first n units of each work: its first prose paragraph, a short unit counting as one; for
    works in verse, whose lines are too short, the first unit that is prose as a whole; empty if there is none."""
    flat = T.squeeze(F.col("content"))
    passages = F.when(F.length(flat) <= LENGTH, F.array(flat)).otherwise(F.split("content", r"\n\s*\n"))
    found = openings(units, n).select("source", "place", _first_prose(passages, PARAGRAPH).alias("paragraph"), _first_prose(F.array(flat), WHOLE).alias("unit"))
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    return found.groupBy("source").agg(F.coalesce(shortened(earliest("paragraph")), shortened(earliest("unit")), F.lit("")).alias("excerpt"))


def tiers(models: DataFrame, budget: int) -> DataFrame:
    """Models (nth, bytes) that fit, by name of their tier: one alone is recommended, two are small and recommended, of more the first, the last but one and the last."""
    w = Window.orderBy("nth")
    fit = models.where(F.col("bytes") <= budget).withColumn("at", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    tier = F.when(F.col("n") == 1, "recommended").when(F.col("n") == 2, F.when(F.col("at") == 1, "small").otherwise("recommended")).when(F.col("at") == 1, "small").when(F.col("at") == F.col("n") - 1, "recommended").when(F.col("at") == F.col("n"), "large")
    return fit.select("nth", tier.alias("tier")).where("tier IS NOT NULL")
