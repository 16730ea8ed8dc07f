"""Confessions printed with endnotes: articles, the notes that their marks point at, and gates on both.

A page is a table of its paragraphs (work, at, html). An anchor with a number is a mark, one with a
bracketed number begins a note; a paragraph that is nothing but a numeral begins an article, which goes
on up to the next one. Marks and notes are joined by number, and every note must have one mark, every
mark one note. Numerals are compared with the sequence and with the misprints that the print is known
for, not counted by place, so a page whose headings changed is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored
from . import scans

HEADING = r"^([IVXL]+)\.?(?:\s*\[sic\])?$"
MARK, NOTE = r"<a[^>]*>(\d+)</a>", r"<a[^>]*>\[(\d+)\]</a>"
# What the print of 1644 has, and its own errors.
ARTICLES, NOTES, MISPRINTS, LEAST = 53, 149, {36: "XXVI", 53: "LII"}, 80


def page_paragraphs(pages: DataFrame, work: str = "work", html: str = "html") -> DataFrame:
    """work, at and html of the paragraphs of class main_body."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)<p[^>]*class="main_body"[^>]*>(.*?)</p>'), F.lit(1))
    return pages.select(F.col(work).alias("work"), F.posexplode(found).alias("at", "html"))


def plain(html: Column) -> Column:
    """A paragraph without anchors and tags."""
    return T.squeeze(F.regexp_replace(F.regexp_replace(html, r"(?s)<a[^>]*>.*?</a>", " "), r"<[^>]+>", " "))


def _placed(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with their plain text, whether they hold notes, and the article (by place) that they are in."""
    text = paragraphs.withColumn("plain", plain(F.col("html")))
    numeral = F.regexp_extract("plain", HEADING, 1)
    value = T.roman_to_int(F.nullif(numeral, F.lit("")))
    proper = F.coalesce(T.int_to_roman(value) == numeral, F.lit(False))
    rows = text.withColumn("printed", F.when(proper, numeral)).withColumn("notes", F.substring("plain", 1, 8).contains("NOTES"))
    return stored(scans.running(stored(rows, "paragraphs"), ["work"], ["at"], {"nth": F.col("printed").isNotNull().cast("int")}), "placed-paragraphs")


def marks(placed: DataFrame) -> DataFrame:
    """work, nth, at, place and number of the marks in articles."""
    inside = placed.where("nth > 0 AND printed IS NULL AND NOT notes")
    return inside.select("work", "nth", "at", F.posexplode(F.regexp_extract_all("html", F.lit(MARK), F.lit(1))).alias("place", "number")).withColumn("number", F.col("number").try_cast("int"))


def notes(placed: DataFrame) -> DataFrame:
    """work, at, place, number and note of the notes, which reach to the next note's number."""
    pieces = placed.where("notes").select("work", "at", F.posexplode(F.split("html", f"(?={NOTE})")).alias("place", "raw")).where(F.col("raw").rlike(rf"\A{NOTE}"))
    return pieces.select("work", "at", "place", F.regexp_extract("raw", NOTE, 1).try_cast("int").alias("number"), plain(F.regexp_replace("raw", rf"\A{NOTE}", "")).alias("note"))


def articles(paragraphs: DataFrame) -> DataFrame:
    """work, nth, printed (the heading's numeral), text and proofs: the notes of an article's marks in order. A mark without a note has no proof."""
    return _articles(_placed(paragraphs))


def _articles(placed: DataFrame) -> DataFrame:
    heads = placed.where("printed IS NOT NULL").select("work", "nth", "printed")
    inside = placed.where("nth > 0 AND printed IS NULL AND NOT notes AND plain <> ''")
    bodies = inside.groupBy("work", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "plain"))), lambda p: p["plain"]), " ").alias("text"))
    last = notes(placed).groupBy("work", "number").agg(F.max_by("note", F.struct("at", "place")).alias("note"))
    proven = marks(placed).join(last, ["work", "number"]).groupBy("work", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "place", "note"))), lambda p: p["note"]), "; ").alias("proofs"))
    out = heads.join(bodies, ["work", "nth"], "left").join(proven, ["work", "nth"], "left")
    return out.select("work", F.col("nth").cast("int").alias("nth"), "printed", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("proofs", F.lit("")).alias("proofs"))


def report(paragraphs: DataFrame, works: DataFrame, articles_: int = ARTICLES, notes_: int = NOTES, misprints: dict[int, str] = MISPRINTS, least: int = LEAST) -> DataFrame:
    """work, check, expected, actual, odd (what is wrong, in order) and ok: a row for each thing that must hold of every work (works: work)."""
    placed = _placed(paragraphs)
    found = _articles(placed)
    known = F.create_map(*(F.lit(x) for kv in misprints.items() for x in kv)) if misprints else F.create_map().cast("map<int,string>")
    proper = F.coalesce(F.try_element_at(known, F.col("nth")), T.int_to_roman(F.col("nth")))
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("nth"))))
    shape = found.groupBy("work").agg(F.count("*").alias("n"), listed(F.col("printed") != proper).alias("odd_numerals"), listed(F.length("text") < least).alias("odd_texts"))
    met = marks(placed).groupBy("work", "number").agg(F.count("*").alias("marks")).join(notes(placed).groupBy("work", "number").agg(F.count("*").alias("notes")), ["work", "number"], "full")
    ordered = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("number"))))
    pairs = met.groupBy("work").agg(F.count_if(F.col("notes") > 0).alias("numbers"), ordered(F.col("marks").isNull()).alias("unmarked"), ordered(F.col("notes").isNull()).alias("unfounded"), ordered((F.col("marks") > 1) | (F.col("notes") > 1)).alias("twice"))
    each = works.select("work").join(shape, "work", "left").join(pairs, "work", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")

    def check(name: str, expected: int, actual: Column, odd: Column | None, ok: Column) -> Column:
        told = F.array_join(F.coalesce(odd, F.array().cast("array<int>")), ", ") if odd is not None else F.lit("")
        return F.struct(F.lit(name).alias("check"), F.lit(expected).cast("long").alias("expected"), n(actual).alias("actual"), told.alias("odd"), F.coalesce(ok, F.lit(False)).alias("ok"))

    none_of = lambda name, c: check(name, 0, F.when(F.col(c).isNotNull(), F.size(c)), F.col(c), F.size(c) == 0)
    checks = [
        check("articles", articles_, F.col("n"), None, F.col("n") == articles_), check("notes", notes_, F.col("numbers"), None, F.col("numbers") == notes_),
        none_of("numerals in sequence", "odd_numerals"), none_of("no article without a text", "odd_texts"),
        none_of("every note has a mark", "unmarked"), none_of("every mark has a note", "unfounded"), none_of("no number twice", "twice"),
    ]
    return each.select("work", F.inline(F.array(*checks)))
