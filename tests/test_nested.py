"""Texts of several levels: what is carried down, what gates refuse."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import nested as N


def run(spark, form, *texts):
    df = spark.createDataFrame([(f"w{i}", t) for i, t in enumerate(texts)], "work string, text string")
    found = N.sections(df, form)
    return found, N.report(found, form, df)


def failing(report, work="w0"):
    return {(r.check, r.section): (r.expected, r.actual, r.missing) for r in report.where("NOT ok").collect() if r.work == work}


def test_the_chapter_survives(spark):
    found, report = run(spark, N.FORMS["verses"], "Title 1:1 In it. 1:2 And so 2:1 Then. 2:3 Last 12:3:4 odd", None, "nothing")
    assert [(r.chapter, r.verse, r.body) for r in found.orderBy("at").collect()] == [(1, 1, "In it."), (1, 2, "And so"), (2, 1, "Then."), (2, 3, "Last 12:3:4 odd")]
    assert failing(report) == {("verses run without a gap", "2"): (3, 2, "2")}
    assert ("no verse twice", "") in failing(report, "w1") and ("no verse twice", "") in failing(report, "w2")


HEAD = "{{c|{{larger|{{sc|Chap. %s. Of It}}}}}}\n"
LONG = "Words enough to be a paragraph that is longer than forty characters."


def westminster(drop=()):
    romans = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx xxi xxii xxiii xxiv xxv xxvi xxvii xxviii xxix xxx xxxi xxxii xxxiii".split()
    out = "The Act.\n5\n"
    for (chapter,), count in N.FORMS["westminster"].children.items():
        out += HEAD % romans[chapter - 1]
        for p in range(1, count + 1):
            if (chapter, p) not in drop:
                mark = "" if p == 1 and chapter % 2 else f"'''{p}'''\n" if p % 3 else f"{p}\n"
                out += f"{mark}{chapter}.{p} {LONG}\n\n"
    return out + "{{PD-UKGov}} [[Category:Acts]] tail"


def test_westminster_and_what_it_lacks(spark):
    found, report = run(spark, N.FORMS["westminster"], westminster(), westminster({(7, 4)}), westminster().replace("{{PD-UKGov}}", ""), westminster({(12, 1)}))
    rows = found.where("work = 'w0' AND level = 'paragraph'").orderBy("at").collect()
    assert len(rows) == sum(N.FORMS["westminster"].children.values()) and all(r.body == f"{r.chapter}.{r.paragraph} {LONG}" for r in rows)
    assert failing(report) == {}
    assert failing(report, "w1") == {("paragraphs run without a gap", "7"): (6, 5, "4"), ("paragraphs of the section", "7"): (6, 5, "")}
    assert failing(report, "w2") == {("the text says", r"\{\{PD-UKGov\}\}"): (1, 0, "")}
    assert failing(report, "w3") == {("paragraphs of the section", "12"): (1, 0, "")}


def test_a_number_twice_and_a_short_one(spark):
    text = HEAD % "i" + f"{LONG}\n1\n{LONG}\n2\nshort\n"
    bad = failing(run(spark, N.FORMS["westminster"], text)[1])
    assert bad["no paragraph twice", ""] == (0, 1, "1.1") and bad["no paragraph too short", ""] == (0, 1, "1.2") and bad["chapters in all", ""] == (33, 1, "")


def test_books_and_subtitles(spark):
    form = N.scripture({"The Book of Ruth": "Ruth", "The First Book of Samuel": "1 Samuel", "The First Book of the Kings": "1 Kings"}, ("The First Book of the Kings",), "Otherwise Called:")
    text = "The First Book of Samuel\n\nOtherwise Called:\nThe First Book of the Kings\n1:1 Now there was 1:2 a man.\nThe First Book of the Kings\n1:1 Now king 2:1 David."
    found, report = run(spark, form, text)
    assert [(r.book, r.chapter, r.verse, r.body) for r in found.where("level = 'verse'").orderBy("at").collect()] == [(2, 1, 1, "Now there was"), (2, 1, 2, "a man."), (3, 1, 1, "Now king"), (3, 2, 1, "David.")]
    bad = failing(report)
    assert bad["books in all", ""] == (66, 2, "") and bad["chapters in all", ""] == (1189, 3, "") and bad["verses in all", ""] == (31102, 4, "") and bad["books run without a gap", ""] == (3, 2, "1")


def test_kinds_with_numbers_of_their_own(spark):
    text = "".join(f"{kind} {n}\n{LONG} {LONG}\n" for kind, most in (("Decree", 18), ("Question", 4)) for n in range(1, most + 1))
    found, report = run(spark, N.FORMS["decrees_and_questions"], text, text.replace("Decree 18\n", ""))
    assert failing(report) == {} and found.where("work = 'w0'").count() == 22
    assert failing(report, "w1") == {("numbers of the section", "1"): (18, 17, "")}


def test_spelled_sessions(spark):
    words = {4: "FOURTH", 5: "FIFTH", 6: "SIXTH", 7: "SEVENTH", 8: "EIGHTH", 13: "THIRTEENTH", 14: "FOURTEENTH", 22: "TWENTY-SECOND", 23: "TWENTY-THIRD", 24: "TWENTY-FOURTH", 25: "TWENTY-FIFTH"}
    text = "preface, see SESSION THE FIRST\n" + "".join(f"SESSION  THE  {w},\n{n} {LONG * 4}\n" for n, w in words.items())
    found, report = run(spark, N.FORMS["sessions"], text, text.replace("TWENTY-THIRD", "TWENTY-THlRD"))
    assert [(r.session, r.body.split()[0]) for r in found.where("work = 'w0'").orderBy("at").collect()] == [(n, str(n)) for n in words if n != 8]
    assert failing(report) == {} and failing(report, "w1") == {("sessions to keep", ""): (10, 9, "23")}


def test_a_numeral_that_is_none(spark):
    text = f"SESSION THE FIRST\n{LONG}\nSESSION THE ELEVENTY\n{LONG}"
    found, report = run(spark, N.Nested((N.FORMS["sessions"].levels[0],)), text)
    assert [(r.session, r.printed) for r in found.orderBy("at").collect()] == [(1, "FIRST"), (None, "ELEVENTY")]
    assert failing(report) == {("every section has a number", ""): (0, 1, "ELEVENTY")}


@pytest.mark.parametrize("word, n", [("FIRST", 1), ("nineteenth", 19), ("TWENTIETH", 20), (" Twenty-Second ", 22), ("NINETY-NINTH", 99), ("FORTIETH", 40), ("ELEVENTY", None), ("", None), (None, None)])
def test_ordinals(spark, word, n):
    assert spark.createDataFrame([(word,)], "w string").select(T.spelled_ordinal(F.col("w"))).first()[0] == n


def test_no_texts(spark):
    found, report = run(spark, N.FORMS["westminster"])
    assert found.count() == report.count() == 0
