"""From texts to units: every gate refuses what it should, and says why."""

import pytest

from quillspark.operators import carving as C
from quillspark.operators import parsers as R

FORM = R.Form(r"^Chapter (\d+)\.[ \t]*([^\n]*)", gap=40, run=3)
BODY = "of the matter, told at some length so that it is a section and no line of contents"
CONTENTS = "Chapter 1. A\nChapter 2. B\nChapter 3. C\nand a preface that is longer than forty characters\n\n"


def work(chapters, right="Rights: Public Domain", contents=CONTENTS):
    return f"A title\n{right}\n\n{contents}" + "".join(f"Chapter {n}. T{n}\n{BODY} {n}\n\n" for n in chapters)


TEXTS = {
    1: work([1, 2, 3]), 2: work([1, 2, 3], "Rights: Copyright 1999"), 3: work([1, 2, 3], ""), 4: work([1, 2]), 5: None, 6: "", 7: work([1, 2, 3], contents=""),
    8: "x" * 1600 + "\nRights: Public Domain\n" + work([1, 2, 3], ""), 9: "Rights: public domain",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t, "extra") for k, t in TEXTS.items()], "work long, text string, body string")


def units(texts, plan):
    rows = C.carve(texts, plan).orderBy("work", "nth").collect()
    return {k: [(r.nth, r.number, r.title, r.body, r.how) for r in rows if r.work == k] for k in {r.work for r in rows}}


def why(texts, plan, witnessed=None):
    return {r.work: r.why for r in C.verdicts(texts, plan, C.carve(texts, plan), witnessed).collect()}


def test_contents_are_passed_over_and_sections_kept(texts):
    got = units(texts, C.Collection(FORM))
    whole = [(n, n, f"T{n}", f"{BODY} {n}", "sections") for n in (1, 2, 3)]
    assert got == {1: whole, 7: whole}


def test_why_works_are_refused(texts):
    refused = {2: "rights: Copyright 1999", 3: "rights: absent", 4: "too few units", 5: "rights: absent", 6: "rights: absent", 8: "rights: absent", 9: "too few units"}
    assert why(texts, C.Collection(FORM)) == {1: None, 7: None} | refused
    assert why(texts, C.Collection(FORM, rights="text"))[8] is None
    assert why(texts, C.Collection(FORM, rights=None)) == {k: None for k in (1, 2, 3, 7, 8)} | {4: "too few units", 5: "no text", 6: "too few units", 9: "too few units"}


def test_paragraphs_take_the_place_of_sections(texts):
    got = units(texts, C.Collection(FORM, target=120))
    assert [n for n, *_ in got[4]] == [1, 2] and {u[-1] for u in got[4]} == {"paragraphs"} and got[1][0][-1] == "sections"
    assert "\n\n".join(u[3] for u in got[4]).split() == TEXTS[4].split()
    assert why(texts, C.Collection(FORM, target=120))[9] is None


def test_witnesses_must_know_the_words(spark, texts):
    plan = C.Collection(FORM, rights=None)
    found = C.carve(texts, plan)
    known = spark.createDataFrame([(BODY,), (None,)], "text string")
    foreign = spark.createDataFrame([("quite other words",)], "text string")
    assert {r.work: r.ok for r in C.backed(found, known).collect()} == {k: True for k in (1, 2, 3, 7, 8)}
    assert why(texts, plan, C.backed(found, foreign))[1] == "not known to witnesses"


def test_empty_table(spark):
    none = spark.createDataFrame([], "work long, text string")
    plan = C.Collection(FORM, target=100)
    assert C.carve(none, plan).count() == 0 == C.verdicts(none, plan, C.carve(none, plan)).count()


def test_a_run_of_two_is_no_contents_page(spark):
    df = spark.createDataFrame([(1, "Chapter 1. A\nChapter 2. B\n" + BODY)], "work long, text string")
    assert [(r.number, r.body) for r in R.sections(df, FORM).orderBy("nth").collect()] == [(1, ""), (2, BODY)]
