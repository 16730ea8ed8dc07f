"""From a work's whole text to its units: rights, sections, packing where there are none, witnesses, and why a work is refused.

texts has work, a key of its own for each row, and text. The steps are operators of their own
elsewhere; here they are one chain, so that no text gets past a gate that its collection asks for:

1. The stated right is read. Where the collection asks for one, a work without it gives no units.
2. The text is cut into sections of its form; contents pages are passed over (Form.run).
3. A work of fewer than `min_units` sections is cut into paragraphs, which are packed, or is refused.
4. Where witnesses are given, every unit's words must be known to them.

A null text has no right and no units. A work is one row, so its sections meet in one task and are no
more than its text; works, however many, are dealt by key, and paragraphs are packed over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored
from . import audit, chunks, parsers


@dataclass(frozen=True)
class Collection:
    """How the works of a collection become units. rights: where it must be stated that they are free ("header": in a line of the
    first HEADER characters; "text": anywhere), None where witnesses take its place. least: the characters that a unit must have.
    min_units: fewer sections are packed from paragraphs if there is a `target`, else the work is refused."""

    form: parsers.Form
    rights: str | None = "header"
    least: int = 60
    min_units: int = 3
    target: int | None = None


# How much of an export is its header, and what share of a unit's words witnesses must know.
HEADER, KNOWN = 1500, 0.8


def stated_right(text: Column) -> Column:
    """What the header's line on rights says, null without one."""
    return F.nullif(F.trim(F.regexp_extract(F.substring(text, 1, HEADER), r"Rights:[ \t]*([^\n]+)", 1)), F.lit(""))


def is_free(text: Column, rights: str | None) -> Column:
    """Whether the text may be used by what is stated in it."""
    if rights is None:
        return text.isNotNull()
    said = stated_right(text) if rights == "header" else text
    return F.coalesce(F.contains(F.lower(said), F.lit("public domain")), F.lit(False))


def paragraph_units(texts: DataFrame, target: int) -> DataFrame:
    """work, nth, number, title and body: paragraphs in order, a unit ends with the one by which it reaches the target."""
    pieces = texts.select("work", F.posexplode(F.split("text", r"\n\s*\n")).alias("at", "raw")).select("work", "at", T.squeeze(F.col("raw")).alias("raw"))
    pieces = stored(pieces.withColumn("size", F.length("raw")).where("size >= 2"), "paragraphs")
    placed = chunks.packed(pieces, "work", ["at"], "size", target).join(pieces, ["work", "at"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda p: p["raw"]), "\n\n")
    nth = (F.col("part") + 1).cast("int")
    return placed.groupBy("work", "part").agg(body.alias("body")).select("work", nth.alias("nth"), nth.alias("number"), F.concat(F.lit("part "), nth).alias("title"), "body")


def carve(texts: DataFrame, plan: Collection) -> DataFrame:
    """work, nth, number, title, body and how ("sections" or "paragraphs") of all units of works that may be used."""
    free = texts.select("work", "text").where(is_free(F.col("text"), plan.rights))
    found = stored(parsers.sections(free, plan.form).where(F.length("body") >= plan.least).select("work", "nth", "number", "title", "body"), "sections")
    enough = found.groupBy("work").agg(F.count("*").alias("n")).where(F.col("n") >= plan.min_units).select("work")
    nth = F.row_number().over(Window.partitionBy("work").orderBy("nth"))
    units = found.join(enough, "work", "left_semi").withColumn("nth", nth).withColumn("how", F.lit("sections"))
    if plan.target is None:
        return units
    return units.unionByName(paragraph_units(free.join(enough, "work", "left_anti"), plan.target).withColumn("how", F.lit("paragraphs")))


def backed(units: DataFrame, witnesses: DataFrame, least: float = KNOWN) -> DataFrame:
    """work, lowest (the smallest share of a unit's distinct words that any witness uses) and ok. A unit without words is not backed."""
    key = F.struct("work", "nth")
    shares = audit.vocabulary_share(units.select(key.alias("unit_id"), F.col("body").alias("content")), witnesses)
    scores = units.select(key.alias("unit_id")).join(shares, "unit_id", "left").select("unit_id.work", F.coalesce(F.col("known") / F.col("words"), F.lit(0.0)).alias("share"))
    return scores.groupBy("work").agg(F.min("share").alias("lowest")).withColumn("ok", F.col("lowest") >= least)


def verdicts(texts: DataFrame, plan: Collection, units: DataFrame, witnessed: DataFrame | None = None) -> DataFrame:
    """work, units, chars, how and why it is refused (null: kept) for every work. units: carve()'s; witnessed: work and ok, as backed() gives."""
    each = units.groupBy("work").agg(F.count("*").alias("units"), F.sum(F.length("body").cast("long")).alias("chars"), F.first("how").alias("how"))
    right = F.concat(F.lit("rights: "), F.coalesce(stated_right(F.col("text")), F.lit("absent")) if plan.rights == "header" else F.lit("not stated")) if plan.rights else F.lit("no text")
    works = texts.select("work", is_free(F.col("text"), plan.rights).alias("free"), right.alias("right")).join(each, "work", "left")
    if witnessed is not None:
        works = works.join(witnessed.select("work", F.col("ok").alias("backed")), "work", "left")
    unbacked = ~F.coalesce("backed", F.lit(False)) if witnessed is not None else F.lit(False)
    why = F.when(~F.col("free"), F.col("right")).when(F.col("units").isNull(), "too few units").when(unbacked, "not known to witnesses")
    return works.select("work", F.coalesce("units", F.lit(0)).cast("long").alias("units"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), "how", why.alias("why"))
