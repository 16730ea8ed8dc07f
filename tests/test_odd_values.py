"""Values that once ended a job or gave a wrong row."""

from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import answering, ingest


def test_versions_of_64_bits(spark):
    given = {
        "1.2+20260712001": ([1, 2], 20260712001), "2026.07.12345678901": ([2026, 7, 12345678901], 0), "99999999999999999999": None, "1.2+99999999999999999999": ([1, 2], 0),
        "1.2+3+4": ([1, 2], 0), "1.2+x": ([1, 2], 0), "1..2": None, "1.-2": None, "+3": None, "": None, None: None, "0.0": ([0], 0), " V1 . 2 + 7 ": ([1, 2], 7),
    }
    rows = spark.createDataFrame([(v,) for v in given], "v string").select("v", dates.version_key(F.col("v")).alias("k")).collect()
    assert {r.v: r.k and (r.k.parts, r.k.build) for r in rows} == given


def test_usfm_marks_without_number(spark):
    text = r"\c 1 \v 1 In the \v 2 And \v x bad \v3 tight \c \v 1 lost \c 99999999999 \v 4 far \c 2 \p \v 1-2 both"
    books = spark.createDataFrame([("g", text), ("e", ""), ("n", None)], "book string, text string")
    assert sorted(tuple(r) for r in ingest.usfm_verses(books).collect()) == [("g", 1, 1, "In the"), ("g", 1, 2, "And"), ("g", 1, 3, "tight"), ("g", 2, 1, "both")]
    assert sorted((r.text, r.chapter, r.verse) for r in ingest.usfm_unnumbered(books).collect()) == [("far", None, 4), ("lost", None, 1), ("x bad", 1, None)]


def test_passage_of_a_question_without_terms(spark):
    text = "It is so. " * 560
    units = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "unit_id long, content string")
    chosen = spark.createDataFrame([(q, u, q) for q in (1, 2) for u in (1, 2, 3)], "qid int, unit_id long, place int")
    asked = spark.createDataFrame([(1, "is it so"), (2, "what is there")], "qid int, text string")
    got = {(r.qid, r.unit_id): (r.chunk_seq, r.passage) for r in answering.best_passage(chosen, units, asked).collect()}
    assert got[1, 1] == (None, text) and got[1, 2] == (None, "short") and got[1, 3] == (None, "")
    assert got[2, 1][0] == 0 and len(got[2, 1][1]) < 1800 and got[2, 2] == (0, "short") and got[2, 3] == (0, "")
