"""Scans that go over many tasks against plain loops, with a group that is most of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunks, reader, scans

SCHEMA = "g string, i int, label string, n int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    groups = [("hot", i) for i in range(3000)] + [(g, i) for g in ("a", "b", None) for i in range(40)] + [("one", 5)]
    rows = [(g, i, rng.choice([None] * 30 + ["x", "y", "z"]), rng.randrange(0, 400)) for g, i in groups]
    rng.shuffle(rows)
    return rows


def by_group(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3])):
        out.setdefault(r[0], []).append(r)
    return out


def test_carried_both_ways(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for back in (False, True):
        want = set()
        for g, own in by_group(rows).items():
            last = None
            for r in reversed(own) if back else own:
                last = r[2] if r[2] is not None else last
                want.add((g, r[1], last))
        got = {(r.g, r.i, r.c) for r in scans.carried(df, ["g"], ["i"], {"c": F.col("label")}, back).collect()}
        assert got == want


def test_two_labels_at_once(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.g, r.i): (r.a, r.b) for r in scans.carried(df, ["g"], ["i"], {"a": F.col("label"), "b": F.when(F.col("n") > 390, F.col("n"))}).collect()}
    for g, own in by_group(rows).items():
        a = b = None
        for r in own:
            a, b = r[2] if r[2] is not None else a, r[3] if r[3] > 390 else b
            assert got[g, r[1]] == (a, b)


def test_rising_following_running(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    rising = {(r.g, r.i) for r in reader.rising(df, "g", ["i"], "n").collect()}
    left_out = {(r.g, r.i, r.above) for r in reader.skipped(df, "g", ["i"], "n").collect()}
    ends = {(r.g, r.i): r.span_end for r in reader.span_ends(df, "g", "i", F.lit(-1)).collect()}
    sums = {(r.g, r.i): r.s for r in scans.running(df, ["g"], ["i"], {"s": F.col("n")}).collect()}
    for g, own in by_group(rows).items():
        high, total = None, 0
        for k, r in enumerate(own):
            assert ((g, r[1]) in rising) == (high is None or r[3] > high)
            assert ((g, r[1], high) in left_out) == (high is not None and r[3] <= high)
            high, total = max(r[3], high or 0), total + r[3]
            assert ends[g, r[1]] == (own[k + 1][1] if k + 1 < len(own) else -1) and sums[g, r[1]] == total


def test_packing_is_the_loop(spark, rows):
    more = rows + [("same", 1, None, 7)] * 9 + [("zero", i, None, 0) for i in range(5)] + [("void", 1, None, None), ("void", 2, None, 5)]
    for target in (1, 1000):
        want = []
        for g, own in by_group([(g, i, x, -1 if n is None else n) for g, i, x, n in more]).items():
            part = held = 0
            for r in own:
                want.append((str(g), r[1], part))
                held += max(r[3], 0)
                if held >= target:
                    part, held = part + 1, 0
        got = [(str(r.g), r.i, r.part) for r in chunks.packed(spark.createDataFrame(more, SCHEMA), "g", ["i"], "n", target).collect()]
        assert sorted(got) == sorted(want)


def test_a_hot_group_is_many_slices(spark, rows):
    counts = [r["count"] for r in scans.sliced(spark.createDataFrame(rows, SCHEMA), ["g"], ["i"]).groupBy("__slice").count().collect()]
    assert len(counts) == 4 and max(counts) < 2 * sorted(counts)[2]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scans.carried(none, ["g"], ["i"], {"c": F.col("label")}).count() == chunks.packed(none, "g", ["i"], "n", 5).count() == 0


def test_groups_within_a_slice_are_packed_in_one_pass(spark, monkeypatch):
    rows, far = [(f"{g:04}", i, None, (g * 7 + i * 13) % 50) for g in range(900) for i in range(1 + g % 9)], []
    own = scans._far_parts
    monkeypatch.setattr(scans, "_far_parts", lambda df, *more: own(far.append(df.count()) or df, *more))
    got = sorted((r.g, r.i, r.part) for r in chunks.packed(spark.createDataFrame(rows, SCHEMA), "g", ["i"], "n", 60).collect())
    want, part, held = [], 0, 0
    for g, i, _, n in sorted(rows):
        part, held = (part, held) if i else (0, 0)
        want.append((g, i, part))
        part, held = (part + 1, 0) if held + n >= 60 else (part, held + n)
    assert got == want and far[0] <= 2 * 4 * 9  # only the first and the last group of each of four slices go by jumps


def test_packing_by_a_key_that_is_null_or_no_number(spark):
    rows = [(k, i, 4) for k in (None, float("nan"), -0.0, 1.5) for i in range(5)]
    df = spark.createDataFrame(rows, "g double, i int, n int").repartition(2)
    got = sorted((str(r.g), r.i, r.part) for r in chunks.packed(df, "g", ["i"], "n", 8).collect())
    assert got == sorted((str(k), i, i // 2) for k in (None, float("nan"), got[0][0], 1.5) for i in range(5)) and got[0][0] in ("-0.0", "0.0")
