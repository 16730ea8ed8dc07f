"""Forms of texts, gates, the catalogue's readers and versions, on invented material."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import audit as A
from quillspark.operators import catalogue as C
from quillspark.operators import library as L
from quillspark.operators import parsers as P
from quillspark.operators import state as S
from quillspark.sources import snapshots
from quillspark.streaming.tokens import until_cancelled


def found(spark, form, text):
    rows = P.sections(spark.createDataFrame([("w", text)], "work string, text string"), P.FORMS[form])
    return [(r.number, r.title, r.body) for r in rows.orderBy("nth").collect()]


@pytest.mark.parametrize(
    "form, text, want",
    [
        ("verses", "1:1 In it. 1:2 And it was 12:3 so.", [(1, "", "In it."), (2, "", "And it was"), (3, "", "so.")]),
        ("catechism", "Intro\nQ1. What?\nA. That.\nQuestion 2: Who?\nA2: One.", [(1, "", "What?\nA. That."), (2, "", "Who?\nA2: One.")]),
        ("articles", "I. _Of Faith\nin One_. Text.\nXXXIX. _Of Oaths_. Last.", [(1, "Of Faith in One", "Text."), (39, "Of Oaths", "Last.")]),
        ("westminster", "{{c|{{larger|{{sc|Chap. I. Of Scripture}}}}}}\nText.\n{{c|{{larger|{{sc|Chap. II.\nOf God}}}}}}\nMore.", [(1, "Of Scripture", "Text."), (2, "Of God", "More.")]),
        ("baptist", "== Chapter 1: Of Things ==\n1. One.\n== Notes ==\nx", [(1, "Of Things", "1. One.\n== Notes ==\nx")]),
        ("first_baptist", "I.\nOne.\nIII [sic]\nTwo.\nIII\nThree.", [(1, "", "One."), (2, "", "Two."), (3, "", "Three.")]),
        ("scots", "===The Preface===\np\n===Chapter 1: Of God===\nText.", [(1, "Of God", "Text.")]),
        ("sermons", "Sermon 1 On Faith\nA Sermon 9 within.\n  Sermon 2\nB", [(1, "On Faith", "A Sermon 9 within."), (2, "", "B")]),
        ("needs", "_Chapter IV._\nText.", [(4, "", "Text.")]),
        ("psalms", "Psalm 1\nText of Psalm 2 here.\nPsalm 1\non.\nPsalm 2\nMore.", [(1, "", "Text of Psalm 2 here.\nPsalm 1\non."), (2, "", "More.")]),
        ("questions", "Question 1. Of it\nText.", [(1, "Of it", "Text.")]),
        ("numbered_catechism", "1. What? So.\n1) a point\n4. Who? He.\n2. stray\n5. End?", [(1, "", "What? So.\n1) a point"), (4, "", "Who? He.\n2. stray"), (5, "", "End?")]),
        ("sermons", "", []),
        ("sermons", None, []),
    ],
)
def test_forms(spark, form, text, want):
    assert found(spark, form, text) == want


def test_sections_of_sections(spark):
    chapters = P.sections(spark.createDataFrame([("w", "== Chapter 1: A ==\n1. One.\n2. Two.\n== Chapter 2: B ==\n1. Three.")], "work string, text string"), P.FORMS["baptist"])
    inner = P.sections(chapters.withColumnRenamed("number", "chapter"), P.FORMS["numbered_paragraphs"], ("work", "chapter"), "body")
    assert sorted((r.chapter, r.number, r.body) for r in inner.collect()) == [(1, 1, "One."), (1, 2, "Two."), (2, 1, "Three.")]


def test_report_knows_missing_numbers_and_empty_works(spark):
    texts = spark.createDataFrame([("whole", "1. a?\n2. b?\n4. c?"), ("none", "nothing")], "work string, text string")
    form = P.Form(P.FORMS["numbered_catechism"].anchor, rising=True, sections=3, missing=(3,), least=2)
    got = {(r.work, r["check"]): (r.expected, r.actual, r.ok) for r in P.report(P.sections(texts, form), form, texts).collect()}
    assert all(ok for (work, _), (*_, ok) in got.items() if work == "whole") and not any(ok for (work, _), (*_, ok) in got.items() if work == "none")
    assert got["whole", "numbers run without a gap"] == (3, 3, True) and got["none", "sections"] == (3, 0, False)


def gates(spark, form, text):
    texts = spark.createDataFrame([("w", text)], "work string, text string")
    return {r["check"]: r.ok for r in P.report(P.sections(texts, P.FORMS[form]), P.FORMS[form], texts).collect()}


ROMAN = [a + b for a in ("", "X", "XX", "XXX", "XL", "L") for b in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")][1:54]
BODY = "The text of an article that is long enough to be one, and then a little longer still than that."


def test_places_are_compared_with_what_is_printed(spark):
    known = {36: "XXVI", 53: "LII"}
    text = lambda numerals: "".join(f"{n}.\n{BODY}\n" for n in numerals)
    genuine = [known.get(i, n) for i, n in enumerate(ROMAN, 1)]
    assert all(gates(spark, "first_baptist", text(genuine)).values())
    for wrong in (["IX"] * 53, ROMAN):
        assert [c for c, ok in gates(spark, "first_baptist", text(wrong)).items() if not ok] == ["printed numbers in sequence"]


def test_the_genuine_longer_catechism_passes(spark):
    text = lambda missing, silent: "".join(f"{n}. What of {n}? " + ("" if n in silent else f"That.\n1. point\n") + "\n" for n in range(1, 612) if n not in missing)
    assert all(gates(spark, "longer_catechism", text({288}, {126, 150})).values())
    bad = lambda *a: {c for c, ok in gates(spark, "longer_catechism", text(*a)).items() if not ok}
    assert bad({288}, {126}) == {"unanswered"} and bad(set(), {126, 150}) >= {"sections"} and bad({288, 300}, {126, 150}) >= {"sections", "numbers run without a gap"}


def test_first_anchors_in_the_order_of_the_print(spark):
    rows = P.sections(spark.createDataFrame([("w", "I. a\nII. b\nIV. c\nII. seen above\nIII. d\nCIX. no chapter\n")], "work string, text string"), P.FORMS["roman_chapters"])
    assert [(r.number, r.printed, r.body) for r in rows.orderBy("nth").collect()] == [(1, "I", "a"), (2, "II", "b"), (4, "IV", "c\nII. seen above"), (3, "III", "d\nCIX. no chapter")]


def test_questions_and_answers(spark):
    rows = spark.createDataFrame([("What is it?\nA. It is\nthis.",), ("469. Who? They.",), ("No question",)], "body string").select(P.asked(F.col("body")).alias("a")).collect()
    assert [tuple(r.a) for r in rows] == [("What is it?", "It is\nthis."), ("469. Who?", "They."), ("No question", "")]


def test_gates_of_collections(spark):
    scores = spark.createDataFrame([("a", 0.9, 0.9), ("a", 0.5, 0.92), ("b", 0.9, 0.9), ("b", 0.5, 0.5), ("c", 0.72, 0.0), ("c", 0.86, 0.0), ("c", 0.9, 0.0)], "work string, containment double, whole double")
    passed = lambda kind: {r.work: r.ok for r in A.corroborated(scores, "work", kind).collect()}
    assert passed("edition") == {"a": True, "b": False, "c": False}
    assert passed("commentary") == {"a": False, "b": False, "c": True}
    assert passed("catechism") == {"a": False, "b": False, "c": True}
    held = lambda rows: A.control_holds(spark.createDataFrame(rows, "containment double"), "edition").first().ok
    assert held([(0.59,)]) and not held([(0.6,)]) and not held([])


def test_hubs_and_short_works(spark):
    links = spark.createDataFrame([("x/a.html", "x/a/1"), ("x/a.html", "x/a/2"), ("x/a.html", "x/a.html"), ("x/b.html", "x/b1.html"), ("x/b.html", "y")], "page string, link string")
    assert [tuple(r) for r in P.hubs(links).collect()] == [("x/a.html", 2)]
    hubs = spark.createDataFrame([("s", 5), ("t", 5), ("u", 5), ("v", 1), ("w", 5)], "source string, parts int")
    units = spark.createDataFrame([("s",)] * 3 + [("t",)] * 2 + [("v",), ("w",)], "source string")
    got = A.unexpanded(hubs, units, spark.createDataFrame([("w",)], "source string"))
    assert sorted(tuple(r) for r in got.collect()) == [("t", 5, 2, "short"), ("u", 5, 0, "absent"), ("w", 5, 1, "withheld")]


def test_shelf_starts_closed_and_opens(spark):
    e = [("toggle", 1, "b"), ("open_all", 2, None), ("toggle", 3, "a"), ("toggle", 4, "z")]
    events = spark.createDataFrame([("u", at, k, t) for k, at, t in e] + [("v", 1, "toggle", "a")], "user_id string, at long, kind string, tradition string")
    users = spark.createDataFrame([("u",), ("v",), ("w",)], "user_id string")
    got = {r.user_id: (r.arranged, r.collapsed) for r in S.collapsed(users, events, ["a", "b"]).collect()}
    assert got == {"u": (True, ["a"]), "v": (True, ["b"]), "w": (False, ["a", "b"])}


def test_reading_resumes_and_is_clamped(spark):
    units = spark.createDataFrame([(10, "s", 1), (11, "s", 2), (12, "s", 3), (20, "t", 1)], "unit_id long, source string, sequence int")
    asked = [(1, "s", 11, 0, 2), (2, "s", 20, None, 2), (3, "s", None, 99, 0), (4, "t", None, -5, None), (5, "s", None, None, None), (6, "none", None, 0, 0)]
    got = L.opened(units, spark.createDataFrame(asked, "request int, source string, wanted long, at int, resume int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 11, 10, 12), (2, 2, 12, 11, -1), (3, 2, 12, 11, -1), (4, 0, 20, -1, -1), (5, 0, 10, -1, 11)]


def test_cancelled_stream_keeps_what_came_before(spark):
    shown = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("c", 3, "w")], "stream_id string, seq long, text string")
    got = until_cancelled(shown, spark.createDataFrame([("a", 1), ("a", 5), ("c", 0), ("d", 1)], "stream_id string, seq long"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "x", True), ("b", "z", False), ("c", "", True)]


def test_release_manifest(spark):
    good = {"kind": "download", "url": "https://x.org/a", "bytes": 3, "sha256": "A" * 64}
    docs = [
        {"version": "1.2", "notes": " n ", "platforms": {"a": good, "b": good | {"bytes": 0}, "c": good | {"url": "http://x.org/a"}, "d": good | {"sha256": "zz"}, "e": {"kind": "store", "url": "https://y.org", "version": "3.0"}, "f": {"kind": "mail", "url": "https://y.org"}}},
        {"version": "x", "platforms": {"a": good}}, {"version": "1.2", "platforms": {}}, {"version": "1.2"}, [],
    ]
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs] + [(None,)], "j string").select(dates.release(F.col("j")).alias("r")).collect()
    assert [r.r is None for r in rows] == [False, True, True, True, True, True]
    r = rows[0].r
    assert r.notes == "n" and {k: (p.version, p.sha256) for k, p in r.platforms.items()} == {"a": ("1.2", "a" * 64), "e": ("3.0", None)}


def test_json_files(spark, tmp_path):
    files = {
        "catalogue": {"packs": {"p": {"name": "P", "authors": ["A"], "titles": ["T", "U"], "tags": {"x": 2}, "traditions": []}}, "fragments": {"f": {"name": "F", "authors": ["A"]}}},
        "withdrawn": {"withdrawn": [{"id": "w", "reason": "r"}]},
        "ledger": {"maxUnitId": 9, "sources": {"u": {"min": 1, "max": 9, "count": 9, "hash": "h"}}},
        "units": {"units": [{"title": "a", "content": "b"}, {"title": "c", "content": None}]},
    }
    for name, doc in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    at = lambda name: f"file://{tmp_path}/{name}.json"
    c = snapshots.catalogue(spark, at("catalogue"))
    assert sorted(tuple(r) for r in c["contents"].collect()) == [("fragments", "f", "author", "A"), ("packs", "p", "author", "A"), ("packs", "p", "title", "T"), ("packs", "p", "title", "U")]
    assert [tuple(r) for r in c["tags"].collect()] == [("packs", "p", "x", 2)] and c["core"].count() == 0
    assert [tuple(r) for r in snapshots.withdrawn(spark, at("withdrawn")).collect()] == [("w", "r")]
    assert [tuple(r) for r in snapshots.ledger(spark, at("ledger")).collect()] == [(1, "u", 1, 9, 9, "h")]
    assert [tuple(r)[1:] for r in snapshots.unit_files(spark, at("units")).collect()] == [(0, "a", "b"), (1, "c", None)]


def test_two_writers_get_two_versions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert snapshots._claimed(spark, root, 1)  # another job is writing version 1
    assert snapshots.publish(spark, root, {"t": spark.range(3)}, 1, "m") == 2 and snapshots.current(spark, root) == 2
    assert snapshots.publish(spark, root, {"t": spark.range(4)}, 1, "m") == 3 and snapshots.read(spark, root, "t").count() == 4


def test_export(spark, tmp_path):
    shown = spark.createDataFrame([("s", "T", "Anonymous", "x", 2, 30, ["c"]), ("t", "U", "B", "x", 1, 5, [])], "source string, title string, author string, tradition string, n_units long, n_chars long, collections array<string>")
    C.export(shown, spark.createDataFrame([("c", "C"), ("d", "D")], "collection string, name string"), f"file://{tmp_path}/out")
    read = lambda name: [json.loads(x) for f in sorted((tmp_path / "out" / name).glob("part-*")) for x in f.read_text().splitlines()]
    assert [r["source"] for r in read("sources")] == ["t", "s"]
    assert read("totals") == [{"n_sources": 2, "n_units": 3, "n_chars": 35, "n_authors": 2, "n_traditions": 1}]
    assert sorted((r["collection"], r["n_sources"]) for r in read("collections")) == [("c", 1), ("d", 0)]


def test_overlaps_across_stretches(spark):
    spans = [(1, 0, 5000), (2, 999, 1000), (3, 1000, 1000), (4, 4999, 9000), (5, 5000, 5001), (6, 7, 3), (7, None, 4)]
    a = spark.createDataFrame([(i, 1, s, e) for i, s, e in spans], "id int, unit_id int, start int, end int")
    got = sorted((r.id, r.other_id) for r in S.overlapping(a, a).collect())
    assert got == sorted((i, j) for i, s, e in spans for j, t, f in spans if None not in (s, t) and s < f and t < e)
