"""Works of several levels (book, chapter, verse) into numbered sections, and gates that count them up the levels.

A form is data: for each level how a section begins and how its numbers are written, and how many
sections there must be, in all and below each one. A text is split once, at the anchors of all levels;
each piece has the numbers of its own level, and those of the levels above are carried down to it, over
tasks if a work is long (scans.carried). The report is a row for each thing that must hold of a work or
of one of its sections, so a chapter that lost a paragraph is named with the paragraph.

A null text, or one without anchors, has no sections; what stands before the first anchor is none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored
from . import scans


@dataclass(frozen=True)
class Level:
    """names: the numbers that the anchor's groups give, from the outside in; the next group, if titled, is the title.
    anchor: a multi-line pattern. numerals: for each name decimal, roman, spelled (TWENTY-SECOND) or listed, which counts the
    place in `listed`. implied: text between the level above and the first anchor is number 1. subtitles: listed names
    that are no heading where they follow another heading with no text, or only `between`, in between."""

    names: tuple[str, ...]
    anchor: str
    numerals: tuple[str, ...] = ("decimal",)
    titled: bool = False
    implied: bool = False
    listed: tuple[str, ...] = ()
    subtitles: tuple[str, ...] = ()
    between: str = ""


@dataclass(frozen=True)
class Nested:
    """levels: from the outside in. totals: how many sections of a name a work has. children: how many sections are right below one, by its numbers.
    least: characters of each innermost section. needs: patterns that the text must hold. until: where the last section ends.
    keep: the outermost numbers to keep, though all anchors bound sections. squeeze: blanks in a row count as one before anchors are looked for."""

    levels: tuple[Level, ...]
    totals: dict[str, int] = field(default_factory=dict)
    children: dict[tuple[int, ...], int] = field(default_factory=dict)
    least: int = 1
    needs: tuple[str, ...] = ()
    until: str = ""
    keep: tuple[int, ...] = ()
    squeeze: bool = False

    @property
    def names(self) -> list[str]:
        return [n for level in self.levels for n in level.names]


_WESTMINSTER = r"(?is:\{\{c\|\{\{larger\|\{\{sc\|Chap\.\s*([ivxl]+)\.\s*(.*?)\}\}\}\}\}\})"
# How the levels of each kind of text begin, and how many sections there are.
FORMS = {
    "verses": Nested((Level(("chapter", "verse"), r"(?<![\d:])(\d+):(\d+)\s+", ("decimal", "decimal")),)),
    "westminster": Nested(
        (Level(("chapter",), _WESTMINSTER, ("roman",), titled=True), Level(("paragraph",), r"^[ \t]*(?:''')?\s*?(\d+)[ \t]*(?:''')?[ \t]*$", implied=True)),
        totals={"chapter": 33},
        children={(i,): n for i, n in enumerate((10, 3, 8, 2, 7, 6, 6, 8, 5, 4, 6, 1, 3, 3, 6, 7, 3, 4, 7, 4, 8, 7, 4, 6, 6, 3, 5, 7, 8, 4, 5, 3, 3), 1)},
        least=40, needs=(r"\{\{PD-UKGov\}\}",), until=r"\{\{PD-|\[\[Category:",
    ),
    "baptist": Nested((Level(("chapter",), r"^==[ \t]*Chapter[ \t]+(\d+)[ \t]*:[ \t]*(.+?)[ \t]*==[ \t]*$", titled=True), Level(("paragraph",), r"^(\d+)\.\s+")), totals={"chapter": 32}),
    "decrees_and_questions": Nested((Level(("kind", "number"), r"^(Decree|Question)[ \t]+(\d+)[ \t]*$", ("listed", "decimal"), listed=("Decree", "Question")),), totals={"kind": 2}, children={(1,): 18, (2,): 4}, least=80),
    "sessions": Nested((Level(("session",), r"^ ?SESSION THE ([A-Z]+(?:-[A-Z]+)?)[,.]?[ \t]*$", ("spelled",)),), keep=(4, 5, 6, 7, 13, 14, 22, 23, 24, 25), least=200, squeeze=True),
}


def scripture(headings: dict[str, str], subtitles: tuple[str, ...] = (), between: str = "") -> Nested:
    """The form of a volume of books, whose heading lines and short names are given in order; its totals are those of the King James version."""
    lines = "|".join(sorted((r"\Q" + h + r"\E" for h in headings), key=len, reverse=True))
    book = Level(("book",), rf"^[ \t]*({lines})[ \t]*$", ("listed",), listed=tuple(headings), subtitles=subtitles, between=between)
    return Nested((book, *FORMS["verses"].levels), totals={"book": 66, "chapter": 1189, "verse": 31102})


def _number(printed: Column, kind: str, level: Level) -> Column:
    if kind == "roman":
        return T.roman_to_int(printed).cast("int")
    if kind == "spelled":
        return T.spelled_ordinal(printed)
    if kind == "listed":
        return F.nullif(F.array_position(F.array(*map(F.lit, level.listed)), printed).cast("int"), F.lit(0))
    return printed.try_cast("int")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def sections(texts: DataFrame, form: Nested, key: str = "work", text: str = "text") -> DataFrame:
    """key, at, level, a number for each name (null below the section's level), printed, title and body of each section, in order of `at`."""
    anchors = "|".join(f"(?:{level.anchor})" for level in form.levels)
    whole = F.regexp_replace(text, r"[ \t]+", " ") if form.squeeze else F.col(text)
    pieces = texts.select(key, F.split(whole, f"(?m)(?={anchors})").alias("p"))
    if any(level.subtitles for level in form.levels):  # the piece before tells whether a heading is a subtitle
        rows = pieces.select(key, F.size("p").alias("of"), F.posexplode(F.transform("p", lambda x, i: F.struct(x.alias("raw"), F.when(i > 0, F.col("p")[i - 1]).alias("before")))).alias("at", "x")).select(key, "of", "at", "x.raw", "x.before")
    else:
        rows = pieces.select(key, F.size("p").alias("of"), F.posexplode("p").alias("at", "raw"))

    starts = [rf"(?m)\A(?:{level.anchor})" for level in form.levels]
    depth = F.lit(None).cast("int")
    for n, level in reversed(list(enumerate(form.levels))):
        is_one = F.col("raw").rlike(starts[n])
        if level.subtitles:
            alone = F.col("before").rlike(rf"(?m)\A(?:{level.anchor})\s*(?:{level.between})?\s*\z")
            is_one &= ~(F.regexp_extract("raw", starts[n], 1).isin(*level.subtitles) & F.coalesce(alone, F.lit(False)))
        depth = F.when(is_one, n).otherwise(depth)
    rows = rows.withColumn("depth", depth)
    labels, printed, title, body = {}, F.lit(None).cast("string"), F.lit(""), F.col("raw")
    for n, level in enumerate(form.levels):
        here = F.col("depth") == n
        for k, name in enumerate(level.names):
            number = _number(F.regexp_extract("raw", starts[n], k + 1), level.numerals[k], level)
            labels[name] = F.when(here, F.struct(number.alias("n"))).when(F.col("depth") < n, F.struct(F.lit(None).cast("int").alias("n")))
        printed = F.when(here, F.regexp_extract("raw", starts[n], len(level.names))).otherwise(printed)
        if level.titled:
            title = F.when(here, T.squeeze(F.regexp_extract("raw", starts[n], len(level.names) + 1))).otherwise(title)
        body = F.when(here, F.regexp_replace("raw", starts[n], "")).otherwise(body)
    if form.until:
        body = F.when(F.col("at") == F.col("of") - 1, F.split(body, form.until, 2)[0]).otherwise(body)
    # stored, as dealing rows out by ranges reads them twice
    own = stored(rows.select(key, "at", "depth", printed.alias("printed"), title.alias("title"), _trimmed(body).alias("body"), *(c.alias(f"n_{n}") for n, c in labels.items())), "nested-pieces")
    found = scans.carried(own, [key], ["at"], {n: F.col(f"n_{n}") for n in labels})
    # a subtitle is no section, and neither is an inner anchor before the first outer one
    found = found.where(F.col("depth").isNotNull() & F.col(form.names[0]).isNotNull()).select(key, "at", "depth", *(F.col(n)["n"].alias(n) for n in labels), "printed", "title", "body")
    for n, level in enumerate(form.levels):
        if level.implied and n:
            first = [F.lit(1) if name in level.names else F.col(name) for name in form.names]
            opens = (F.col("depth") == n - 1) & (F.col("body") != "")
            own = F.struct(F.col("depth"), *(F.col(name) for name in form.names), "printed", "title", F.when(opens, "").otherwise(F.col("body")).alias("body"))
            more = F.struct(F.lit(n).alias("depth"), *(c.alias(name) for c, name in zip(first, form.names)), F.lit(None).cast("string").alias("printed"), F.lit("").alias("title"), F.col("body"))
            found = found.select(key, "at", F.explode(F.when(opens, F.array(own, more)).otherwise(F.array(own))).alias("s")).select(key, "at", "s.*")
    if form.keep:
        found = found.where(F.col(form.names[0]).isin(*form.keep))
    level = F.array(*(F.lit(level.names[-1]) for level in form.levels))[F.col("depth")]
    return found.select(key, "at", level.alias("level"), *form.names, "printed", "title", "body")


def _gaps(numbers: Column) -> Column:
    """What is missing of 1 to the last of some distinct numbers, in order: 3, 5–7."""
    before = F.concat(F.array(F.lit(0)), numbers)
    gap = F.transform(numbers, lambda n, i: F.when(n - before[i] == 2, (n - 1).cast("string")).when(n - before[i] > 2, F.concat_ws("–", before[i] + 1, n - 1)))
    return F.array_join(gap, ", ")  # leaves out nulls


def report(found: DataFrame, form: Nested, texts: DataFrame, key: str = "work", text: str = "text") -> DataFrame:
    """key, check, section, expected, actual, missing and ok: a row for each thing that must hold of every work of texts, or of one of its sections."""
    names, inner = form.names, form.levels[-1].names[-1]
    row = lambda check, section, expected, actual, missing, ok: F.struct(F.lit(check).alias("check"), section.alias("section"), expected.cast("long").alias("expected"), actual.cast("long").alias("actual"), missing.alias("missing"), F.coalesce(ok, F.lit(False)).alias("ok"))
    # what all checks need is computed once: of the sections their numbers and lengths, of the texts whether they hold what they must
    found = stored(found.select(key, "level", *names, "printed", F.length("body").alias("size")), "nested-sections")
    texts = stored(texts.select(key, *(F.coalesce(F.col(text).rlike(pattern), F.lit(False)).alias(f"__has_{n}") for n, pattern in enumerate(form.needs))), "nested-works")
    none, works = F.lit(""), texts.select(key)
    out = []

    def add(rows: DataFrame, *checks: Column) -> None:
        out.append(rows.select(key, F.inline(F.array(*checks))))

    leaves = found.where(F.col("level") == inner)
    for n, name in enumerate(names):
        have = found.where(F.col(name).isNotNull()).select(key, *names[: n + 1]).distinct()
        if name in form.totals:
            each = works.join(have.groupBy(key).agg(F.count("*").alias("n")), key, "left")
            actual = F.coalesce("n", F.lit(0))
            add(each, row(f"{name}s in all", none, F.lit(form.totals[name]), actual, none, actual == form.totals[name]))
        section = F.concat_ws(".", *names[:n]) if n else none
        below = have.groupBy(key, *names[:n]).agg(F.array_sort(F.collect_set(name)).alias("numbers")).select(key, section.alias("section"), "numbers")
        if not (n == 0 and form.keep):
            last = F.element_at("numbers", -1)
            add(below, row(f"{name}s run without a gap", F.col("section"), last, F.size("numbers"), _gaps(F.col("numbers")), last == F.size("numbers")))
        wanted = {".".join(map(str, path)): count for path, count in form.children.items() if len(path) == n}
        if wanted:
            tree = works.select(key, F.explode(F.array(*(F.struct(F.lit(p).alias("section"), F.lit(c).alias("wanted")) for p, c in wanted.items()))).alias("w")).select(key, "w.*")
            actual = F.coalesce(F.size("numbers"), F.lit(0))
            add(tree.join(below, [key, "section"], "left"), row(f"{name}s of the section", F.col("section"), F.col("wanted"), actual, none, actual == F.col("wanted")))
    if form.keep:
        each = works.join(found.groupBy(key).agg(F.collect_set(names[0]).alias("numbers")), key, "left")
        gone = F.array_except(F.array(*map(F.lit, form.keep)), F.coalesce("numbers", F.array().cast("array<int>")))
        add(each, row(f"{names[0]}s to keep", none, F.lit(len(form.keep)), F.lit(len(form.keep)) - F.size(gone), F.array_join(gone, ", "), F.size(gone) == 0))
    own = F.coalesce(*(F.when(F.col("level") == level.names[-1], F.coalesce(*(F.when(F.col(n).isNull(), True) for n in level.names), F.lit(False))) for level in form.levels))
    nameless = found.where(own).groupBy(key).agg(F.array_sort(F.collect_list("printed")).alias("printed"))
    each = works.join(nameless, key, "left").withColumn("printed", F.coalesce("printed", F.array().cast("array<string>")))
    add(each, row("every section has a number", none, F.lit(0), F.size("printed"), F.array_join("printed", ", "), F.size("printed") == 0))
    path = F.concat_ws(".", *names)
    counts = leaves.groupBy(key, path.alias("section")).agg(F.count("*").alias("n"), F.min("size").alias("short"))
    odd = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("section")))).alias("twice"), F.array_sort(F.collect_list(F.when(F.col("short") < form.least, F.col("section")))).alias("short"))
    each = works.join(odd, key, "left")
    for check, c in ((f"no {inner} twice", "twice"), (f"no {inner} too short", "short")):
        add(each, row(check, none, F.lit(0), F.size(F.coalesce(c, F.array().cast("array<string>"))), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", "), F.size(c) == 0))
    for n, pattern in enumerate(form.needs):
        has = F.col(f"__has_{n}")
        add(texts, row("the text says", F.lit(pattern), F.lit(1), has.cast("int"), none, has))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole
