"""Works of a known shape into numbered sections, and gates on what must come out.

A form is data: how a section begins, how its number is written, and what a work of this form must
hold. All forms go through the same expressions, so a new one is a line in FORMS.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as T


@dataclass(frozen=True)
class Form:
    """anchor: a pattern, multi-line, whose group 1 is the number and group 2, if any, the title. roman: how numbers are written.
    by_place: the place counts as the number; the printed one must then be the place's, but for `misprints` (place: numeral)
    that the print is known for. first: only the first anchor of each number from 1 to `sections` begins a section, in the
    order of the print, which then need not be that of the numbers. rising: an anchor whose number is not above all before it
    belongs to the section it stands in, as do later anchors of a number under `first`. sections, missing, least: how many
    there must be, numbers known to be absent, and the characters that each must have. unanswered: the numbers of a catechism
    that are known to have no answer; None for other texts. gap, run: `run` or more anchors in a row, each less than `gap` characters
    behind the one before, are a page of contents, where no section begins; 0 where there is none to pass over."""

    anchor: str
    roman: bool = False
    by_place: bool = False
    misprints: tuple[tuple[int, str], ...] = ()
    first: bool = False
    rising: bool = False
    sections: int | None = None
    missing: tuple[int, ...] = ()
    least: int = 1
    unanswered: tuple[int, ...] | None = None
    gap: int = 0
    run: int = 0


# How the sections of each kind of text begin, and how many there are.
FORMS = {
    "verses": Form(r"(?<![\d:])\d+:(\d+)\s+"),
    "catechism": Form(r"^[ \t]*(?:Q|Question\s*)(\d+)\s*[:.]"),
    "numbered_catechism": Form(r"^(\d{1,3})[.)]\s*", rising=True),
    "articles": Form(r"^([IVXL]+)\.[ \t]+_((?s:.+?))_\.", roman=True, sections=39),
    "westminster": Form(r"(?is)\{\{c\|\{\{larger\|\{\{sc\|Chap\.\s*([ivxl]+)\.\s*(.*?)\}\}\}\}\}\}", roman=True, sections=33),
    "baptist": Form(r"^==\s*Chapter\s+(\d+)\s*:\s*(.+?)\s*==[ \t]*$", sections=32),
    "numbered_paragraphs": Form(r"^(\d+)\.\s+"),
    "first_baptist": Form(r"^([IVXL]+)\.?(?:[ \t]*\[sic\])?[ \t]*$", roman=True, by_place=True, misprints=((36, "XXVI"), (53, "LII")), sections=53, least=80),
    "scots": Form(r"^={2,3}\s*Chapter\s+(\d+):\s*(.*?)\s*={2,3}[ \t]*$", sections=25),
    "sermons": Form(r"^[ \t]*Sermon[ \t]+(\d+)\b[ \t]*(.*)$", sections=141),
    "roman_chapters": Form(r"^[ \t]*([IVXLCDM]+)\.", roman=True, first=True, sections=108),
    "needs": Form(r"^_Chapter\s+([IVXLC]+)\._[ \t]*$", roman=True, sections=28),
    "longer_catechism": Form(r"^(\d{1,3})[.)]\s*", rising=True, sections=610, missing=(288,), unanswered=(126, 150)),
    "psalms": Form(r"^Psalm\s+(\d+)[ \t]*$", rising=True, sections=150),
    "questions": Form(r"^Question\s+(\d+)\.[ \t]*(.*)$"),
    "summa_articles": Form(r"^Article\s+(\d+)\.[ \t]*(.*)$"),
}
ANSWER = r"(?m)^\s*(?:A|Answer)\s*\d*\s*[:.]"
# What a work must have to be kept as one.
LEAST_SECTIONS, LEAST_SHARE = 3, 0.6
LEAST_UNITS, LEAST_CHARS, PLACEHOLDERS_PER_1K = 3, 20_000, 1.0
#: A parsed unit shorter than this, by kind of text, is page furniture.
FLOORS = {"work": 500, "part": 80, "answer": 60, "commentary": 200, "volume": 20_000}


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def sections(texts: DataFrame, form: Form, keys: tuple[str, ...] = ("work",), text: str = "text") -> DataFrame:
    """The keys, nth, number, printed (the number as it stands), title and body of each section; what stands before the first anchor is no section.

    Sections of sections come by calling it again with `number` renamed among the keys. A null text has none.
    Where only some anchors begin a section, they are picked within the text's row, each text by itself; nothing is shuffled for it.
    """
    starts = rf"(?m)\A(?:{form.anchor})"
    value = lambda printed: (T.roman_to_int(printed) if form.roman else printed.try_cast("int")).cast("int")
    cut = F.split(text, f"(?m)(?={form.anchor})")
    if form.run or form.rising or form.first:
        rows = _picked(texts.select(*keys, cut.alias("pieces")), form, list(keys), starts, value)
    else:
        rows = texts.select(*keys, F.posexplode(cut).alias("at", "raw")).where(F.col("raw").rlike(starts)).withColumn("printed", F.regexp_extract("raw", starts, 1))
        rows = rows.withColumn("number", value(F.col("printed"))).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("at")))
    titled = form.anchor.replace("(?", "").replace(r"\(", "").count("(") > 1
    title = T.squeeze(F.regexp_extract("raw", starts, 2)) if titled else F.lit("")
    body = _trimmed(F.regexp_replace("raw", starts, ""))
    return rows.select(*keys, "nth", (F.col("nth") if form.by_place else F.col("number")).alias("number"), "printed", title.alias("title"), body.alias("body"))


def _picked(rows: DataFrame, form: Form, keys: list[str], starts: str, value: Callable[[Column], Column]) -> DataFrame:
    """The pieces that begin a section, each with the text of those up to the next such. Only their numbers and lengths go to Python."""
    rows = rows.select(*keys, F.filter("pieces", lambda p: p.rlike(starts)).alias("pieces"))
    printed = lambda p: F.regexp_extract(p, starts, 1)
    numbers = F.transform("pieces", lambda p: value(printed(p)))
    lengths = F.transform("pieces", F.length) if form.run else numbers
    rows = rows.withColumn("numbers", numbers).withColumn("begin", _beginnings(form)("numbers", lengths))

    def section(begin: Column, k: Column) -> Column:
        size = F.coalesce(F.get("begin", k + 1), F.size("pieces")) - begin
        return F.struct((k + 1).alias("nth"), F.get("numbers", begin).alias("number"), printed(F.get("pieces", begin)).alias("printed"), F.array_join(F.slice("pieces", begin + 1, size), "").alias("raw"))

    return rows.select(*keys, F.inline(F.transform("begin", section)))


def _beginnings(form: Form):
    """Of each text's pieces those that begin a section, by place from 0: not those in a run of contents; of the others those whose
    number is above all before it (rising); of these the first of each number from 1 to `sections` (first)."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def begin(numbers: pa.Array, lengths: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(numbers), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        text, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = numbers.flatten()
        known = found.is_valid().to_numpy(zero_copy_only=False)
        number = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        kept = np.arange(len(number))
        if form.run:
            length = lengths.flatten().to_numpy(zero_copy_only=False)
            close = np.zeros(len(number), bool)
            close[1:] = (place[1:] > 0) & (length[:-1] < form.gap)
            run = np.cumsum(~close) - 1
            kept = kept[np.bincount(run, minlength=1)[run] < form.run]
        if form.rising:
            least = -(1 << 40)  # below every int; texts lie so far apart that the highest so far is never one of the text before
            reach = np.maximum.accumulate(np.where(known, number, least)[kept] + (text[kept] << 42))
            high = np.full(len(kept), least)
            same = text[kept][1:] == text[kept][:-1]
            high[1:][same] = (reach[:-1] - (text[kept][:-1] << 42))[same]
            kept = kept[known[kept] & (number[kept] > np.where(high == least, 0, high))]
        if form.first:
            kept = kept[known[kept] & (number[kept] >= 1) & (number[kept] <= form.sections)]
            kept = np.sort(kept[np.unique((text[kept] << 32) + number[kept], return_index=True)[1]])
        ends = np.concatenate([[0], np.cumsum(np.bincount(text[kept], minlength=len(sizes)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[kept], pa.int32()))

    return begin


def asked(body: Column) -> Column:
    """Question and answer of a section: cut at the answer's mark if there is one, else behind the first question mark."""
    marked = body.rlike(ANSWER)
    question = F.when(marked, F.regexp_extract(body, rf"(?s)\A(.*?){ANSWER}", 1)).when(body.contains("?"), F.regexp_extract(body, r"(?s)\A([^?]*\?)", 1)).otherwise(body)
    answer = F.when(marked, F.regexp_extract(body, rf"(?s)\A.*?{ANSWER}(.*)\z", 1)).when(body.contains("?"), F.regexp_extract(body, r"(?s)\A[^?]*\?(.*)\z", 1)).otherwise("")
    return F.struct(T.squeeze(question).alias("question"), _trimmed(answer).alias("answer"))


def report(found: DataFrame, form: Form, works: DataFrame) -> DataFrame:
    """work, check, expected, actual and ok: a row for each thing that every work (works: work) must fulfil. A work without sections fails, it is not left out."""
    spare = F.size(F.array_except(F.array(*map(F.lit, form.missing)).cast("array<int>"), F.collect_set("number")))
    misprints = F.create_map(*(F.lit(x) for kv in form.misprints for x in kv)) if form.misprints else F.create_map().cast("map<int,string>")
    proper = F.coalesce(F.try_element_at(misprints, F.col("number")), T.int_to_roman(F.col("number")) if form.roman else F.col("number").cast("string"))
    silent = F.array_sort(F.collect_set(F.when(asked(F.col("body"))["answer"] == "", F.col("number"))))
    each = found.groupBy("work").agg(
        F.count("*").alias("n"), F.countDistinct("number").alias("numbers"), F.max("number").alias("last"), F.count_if(F.length("body") < form.least).alias("short"), spare.alias("spare"),
        F.count_if(F.col("printed") != proper).alias("misprinted"), silent.alias("silent"),
    )
    each = works.select("work").join(each, "work", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    check = lambda name, expected, actual, ok: F.struct(F.lit(name).alias("check"), n(expected).alias("expected"), n(actual).alias("actual"), F.coalesce(ok, F.lit(False)).alias("ok"))
    unbroken = F.col("last") - F.col("spare")
    checks = [
        check("numbers run without a gap", unbroken, F.col("numbers"), F.col("numbers") == unbroken),
        check("no number twice", F.col("n"), F.col("numbers"), F.col("n") == F.col("numbers")),
        check("no section too short", F.lit(0), F.col("short"), F.col("short") == 0),
    ]
    if form.sections is not None:
        checks.append(check("sections", F.lit(form.sections), F.col("n"), F.col("n") == form.sections))
    if form.by_place:
        checks.append(check("printed numbers in sequence", F.lit(0), F.col("misprinted"), F.col("misprinted") == 0))
    if form.unanswered is not None:
        checks.append(check("unanswered", F.lit(len(form.unanswered)), F.size("silent"), F.col("silent") == F.array(*map(F.lit, form.unanswered)).cast("array<int>")))
    return each.select("work", F.inline(F.array(*checks)))


def hubs(links: DataFrame) -> DataFrame:
    """Pages (page, link) that only lead to their parts: two or more different links below their own address."""
    own = F.regexp_replace(F.col("page"), r"\.html?$", "")
    child = F.startswith(F.col("link"), own) & (F.col("link") != F.col("page"))
    return links.where(child).groupBy("page").agg(F.countDistinct("link").alias("parts")).where("parts >= 2")


def divisible(texts: DataFrame, found: DataFrame) -> DataFrame:
    """work and whether its sections divide it: at least three that hold 60 % of its text. Others are packed by paragraphs (chunks.packed)."""
    each = found.groupBy("work").agg(F.count("*").alias("n"), F.sum(F.length("body").cast("long")).alias("chars"))
    ok = (F.col("n") >= LEAST_SECTIONS) & (F.col("chars") >= LEAST_SHARE * F.length("text"))
    return texts.join(each, "work", "left").select("work", F.coalesce(ok, F.lit(False)).alias("by_sections"))


def substantial(units: DataFrame, placeholder: str = r"\[Illustration\]|\[page image\]") -> DataFrame:
    """source, units, chars and why a work is refused: too few units, too little text, or page images in place of text; null for one to keep."""
    each = units.groupBy("source").agg(F.count("*").alias("units"), F.sum(F.length("content").cast("long")).alias("chars"), F.sum(F.regexp_count("content", F.lit(placeholder)).cast("long")).alias("images"))
    why = F.when(F.col("units") < LEAST_UNITS, "too few units").when(F.col("chars") < LEAST_CHARS, "too short").when(F.col("images") * 1000.0 / F.col("chars") > PLACEHOLDERS_PER_1K, "page images")
    return each.select("source", "units", "chars", why.alias("why"))


def long_enough(content: Column, kind: str) -> Column:
    """Whether a parsed text reaches the floor of its kind."""
    return F.coalesce(F.length(content) >= FLOORS[kind], F.lit(False))
