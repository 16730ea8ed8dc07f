"""Reader state: highlights as intervals, threads, recency lists, toggles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .library import first_seen


def overlapping(a: DataFrame, b: DataFrame, width: int = 1000) -> DataFrame:
    """Pairs of half-open intervals of the same unit that overlap; b's columns get a prefix.

    Intervals meet in stretches of `width`, so a unit with very many is dealt over its length; a pair
    counts in the stretch where the later of the two begins, which both are in.
    """
    stretches = lambda start, end: F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end) - 1) / width)))
    left = a.withColumn("__at", stretches("start", "end"))
    right = b.select(*(F.col(c).alias(c if c == "unit_id" else f"other_{c}") for c in b.columns)).withColumn("__at", stretches("other_start", "other_end"))
    later = F.floor(F.greatest("start", "other_start") / width) == F.col("__at")
    return left.join(right, ["unit_id", "__at"]).where("start < other_end AND other_start < end").where(later).drop("__at")


def written(held: DataFrame, new: DataFrame) -> DataFrame:
    """Highlights after new ones are written: held ones that a new one overlaps go."""
    gone = overlapping(held, new.select("unit_id", "start", "end")).select("id").distinct()
    return held.join(gone, "id", "left_anti").unionByName(new)


def threads(messages: DataFrame, limit: int) -> DataFrame:
    """The threads with the latest last turn: number of messages, first title and last text. Threads without messages are not there."""
    each = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("last_text"), F.min_by("text", "turn").alias("first_text"), (F.max("turn") + 1).alias("next_turn"))
    return each.orderBy(F.col("last_turn").desc(), F.col("conv_id").desc()).limit(limit)


def recent(events: DataFrame, owner: str, key: str, at: str, tie: str, cap: int) -> DataFrame:
    """For each owner the last `cap` distinct keys, newest first; keys differ by more than case."""
    latest = first_seen(events.withColumn("__key", F.lower(F.col(key))), [owner, "__key"], [F.col(at).desc(), F.col(tie).desc()])
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return latest.drop("__key").withColumn("nth", nth).where(F.col("nth") <= cap)


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Which switches are on: those that were pressed an odd number of times."""
    return events.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def bookmarks(events: DataFrame) -> DataFrame:
    """Newest first, each item once, kept where it was first marked."""
    return first_seen(events, ["user_id", "item"], ["ts", "event_id"]).orderBy(F.col("ts").desc(), F.col("event_id").desc())


def collapsed(users: DataFrame, events: DataFrame, traditions: list[str]) -> DataFrame:
    """user_id, arranged, and the traditions whose sections a reader sees closed.

    events: user_id, at, kind (toggle, close_all, open_all), tradition (of a toggle). A shelf starts all
    closed, which is a default and no choice; closing or opening all sets every section, and presses
    since then flip it. A press of a tradition that is not listed counts as arranging only.
    """
    all_ = F.array(*map(F.lit, traditions)).cast("array<string>")
    reset = events.where("kind <> 'toggle'").groupBy("user_id").agg(F.max("at").alias("reset_at"), (F.max_by("kind", "at") == "close_all").alias("closed"))
    presses = events.join(reset, "user_id", "left").where("kind = 'toggle' AND (reset_at IS NULL OR at > reset_at)").groupBy("user_id", "tradition").agg(F.count("*").alias("n"))
    odd = presses.where("n % 2 = 1").groupBy("user_id").agg(F.collect_set("tradition").alias("flipped"))
    touched = events.select("user_id", F.lit(True).alias("arranged")).distinct()
    rows = users.select("user_id").distinct().join(touched, "user_id", "left").join(reset, "user_id", "left").join(odd, "user_id", "left")
    start = F.when(F.coalesce("closed", F.lit(True)), all_).otherwise(F.array().cast("array<string>"))
    flipped = F.array_intersect(F.coalesce("flipped", F.array().cast("array<string>")), all_)
    shut = F.array_union(F.array_except(start, flipped), F.array_except(flipped, start))
    return rows.select("user_id", F.coalesce("arranged", F.lit(False)).alias("arranged"), F.array_sort(shut).alias("collapsed"))
