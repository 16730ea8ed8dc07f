import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import chunks as C
from quillspark.operators import reader as R
from quillspark.operators import segments as S


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n😀", max_size=6000))
def test_chunks_cover_text(text):
    spans = C.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= C.OVERLAP and b - a <= C.MOST


@pytest.mark.parametrize("text, n", [("", 1), ("x", 1), ("x" * 1800, 1), ("x" * 1801, 2), ("\n" * 4000, 3)])
def test_chunk_edges(text, n):
    assert len(C.spans(text)) == n


def test_chunk_prefers_paragraph_then_sentence():
    text = "a" * 1190 + "\n\n" + "b" * 1000
    assert C.spans(text)[0] == (0, 1192)
    assert C.spans("c" * 1100 + ". " + "d" * 1500)[0] == (0, 1102)


def test_unit_of_many_chunks_has_ids_of_its_own(spark):
    df = spark.createDataFrame([(1, "x" * 1_700_000), (2, None), (3, "")], "unit_id long, content string")
    rows = C.chunk(df).groupBy("unit_id").agg({"chunk_id": "count", "seq": "count"}).collect()
    got = {r.unit_id: (r["count(chunk_id)"], r["count(seq)"]) for r in rows}
    assert got[1][0] == got[1][1] > 1000 and got[2] == (1, 1) == got[3]


def test_packing_starts_anew(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([3, 3, 3, 9, 1, 1])], "g string, i int, size long")
    assert [r.part for r in C.packed(df, "g", ["i"], "size", 6).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2]


def test_verses():
    got = S.segments("Head\n1. One\n2. Two words \n3. Three")
    assert [(k, n) for k, _, _, n in got] == [("verse", None), ("verse", 1), ("verse", 2), ("verse", 3)]
    text = "1. One\n2. Two"
    assert [text[a:b] for _, a, b, _ in S.segments(text)] == ["1. One", "2. Two"]


def test_one_number_is_no_verse():
    assert {k for k, *_ in S.segments("1. Only\nmore")} == {"paragraph"}


def test_long_paragraph_becomes_sentences():
    text = " ".join(f"Sentence number {i} goes on for a while, as they do in dense prose." for i in range(12))
    got = S.segments(text)
    assert len(got) == 12 and got[0][0] == "sentence"
    assert S.segments('He said "Stop." ' + "X" + "y" * 800)[0][2] == 15


def test_blank_text_has_no_segments():
    assert S.segments(" \n\t ") == [] == S.segments("")


def test_numbers_without_words_are_no_verses():
    assert S.segments("1. \n2. ")[0][0] == "paragraph"
    assert S.segments("Head\n1. \n2. Two") == [("verse", 0, 4, None), ("verse", 9, 15, 2)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\")\n\t1", max_size=200), st.sampled_from([1, 900]))
def test_segments_hold_all_ink_once_and_in_order(text, times):
    found = S.segments(text * times)
    places = [p for _, a, b, _ in found for p in range(a, b)]
    assert places == sorted(set(places)) and not any((text * times)[p].isspace() for _, a, b, _ in found for p in (a, b - 1) if found[0][0] != "verse")
    if not found or found[0][0] != "verse":
        assert {i for i, c in enumerate(text * times) if not c.isspace()} <= set(places)


def test_references(spark):
    df = spark.createDataFrame([("a", n) for n in (4, 5, 6)] + [("b", n) for n in (4, 5)] + [("c", n) for n in (9, 5, 4, 4)] + [("d", None)], "k string, n int")
    assert {r.k: r.reference for r in R.ranges(df, "k", "n").collect()} == {"a": "4–6", "b": "4, 5", "c": "4, 5, 9"}


def test_quotes(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 4, "z")], "k string, idx int, text string")
    assert R.quotes(df, "k", " ").first().quote == "x y … z"


def test_heading_runs_go(spark):
    df = spark.createDataFrame([("w", a) for a in (0, 10, 20, 1000, 1010, 5000)], "w string, at int")
    assert sorted(r.at for r in R.without_runs(df, "w", "at", 600, 3).collect()) == [1000, 1010, 5000]
