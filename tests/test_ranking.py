import random

import pandas as pd
from pyspark.sql import functions as F

from quillspark.operators import semantic as M


def ranked(spark, *lists):
    return [spark.createDataFrame([(1, u, r) for r, u in enumerate(ids, 1)], "qid int, unit_id long, rank int") for ids in lists]


def ids(df):
    return [r["unit_id"] for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    lex, sem = ranked(spark, [1, 7, 3], [9, 7, 4])
    assert ids(M.fuse([(lex, 1.0), (sem, 1.0)], 10))[0] == 7
    a, b = ranked(spark, [5, 3], [3, 5])
    assert ids(M.fuse([(a, 1.0), (b, 1.0)], 10)) == [3, 5]
    a, b = ranked(spark, [1], [2])
    assert ids(M.fuse([(a, 2.0), (b, 1.0)], 10)) == [1, 2]
    a, b = ranked(spark, [1, 2], [])
    assert ids(M.fuse([(a, 1.0), (b, 1.0)], 10)) == [1, 2]
    a, b = ranked(spark, [1, 2, 3, 4, 5], [6, 7, 8])
    assert len(ids(M.fuse([(a, 1.0), (b, 1.0)], 3))) == 3


def test_appended_lists_keep_counting(spark):
    a, b = ranked(spark, [4, 5], [5, 6])
    assert sorted((r.unit_id, r["rank"]) for r in M.appended(a, b).collect()) == [(4, 1), (5, 2), (5, 3), (6, 4)]


def plain(rows, limit, of_source, of_tradition):
    """Quotas as a plain loop over (source, tradition)."""
    s, t, taken, left = {}, {}, [], []
    for i, (a, b) in enumerate(rows):
        if len(taken) < limit and s.get(a, 0) < of_source and t.get(b, 0) < of_tradition:
            taken.append(i)
            s[a], t[b] = s.get(a, 0) + 1, t.get(b, 0) + 1
        else:
            left.append(i)
    return (taken + left)[:limit]


def test_quotas(spark):
    rng = random.Random(3)
    cases = [[(rng.choice("abc"), rng.choice("xy")) for _ in range(rng.randint(1, 24))] for _ in range(12)]
    cases += [[("s", "t")] * 6, [(f"s{i}", "m") for i in range(10)] + [("z", "minor")]]
    rows = [(q, i, a, b, i + 1) for q, case in enumerate(cases) for i, (a, b) in enumerate(case)]
    df = spark.createDataFrame(rows, "qid int, unit_id long, source string, tradition string, rank int")
    got = M.diversify(df, 6).toPandas()
    for q, case in enumerate(cases):
        mine = got[got.qid == q].sort_values("place").unit_id.tolist()
        assert mine == plain(case, 6, 2, 3)


def test_null_source_is_one_bucket(spark):
    df = spark.createDataFrame([(1, i, None, "t", i + 1) for i in range(3)] + [(1, 9, "s", "u", 4)], "qid int, unit_id long, source string, tradition string, rank int")
    assert M.diversify(df, 3).orderBy("place").toPandas().unit_id.tolist() == [0, 1, 9]


def test_named_tradition_gets_a_voice(spark):
    chosen = spark.createDataFrame([(1, i, f"s{i}", "a", i + 1) for i in range(3)], "qid int, unit_id long, source string, tradition string, place int")
    scored = spark.createDataFrame([(1, 50, "z", "b", 1.0), (1, 51, "z", "b", 2.0)], "qid int, unit_id long, source string, tradition string, score double")
    named = spark.createDataFrame([(1, "a"), (1, "b")], "qid int, tradition string")
    assert M.with_named_traditions(chosen, scored, named, 3).orderBy("place").toPandas().unit_id.tolist() == [0, 1, 51]
    assert M.with_named_traditions(chosen, scored, named.limit(1), 3).orderBy("place").toPandas().unit_id.tolist() == [0, 1, 2]


def test_best_chunk(spark):
    rows = pd.DataFrame([(1, 1, 100, 0.9), (1, 2, 100, 0.7), (1, 3, 100, 0.5), (1, 4, 200, 0.6)], columns=["qid", "chunk_id", "unit_id", "score"])
    got = M.best_per_unit(spark.createDataFrame(rows)).orderBy("unit_id").collect()
    assert [(r.unit_id, r.chunk_id) for r in got] == [(100, 1), (200, 4)]


def test_too_many_queries_are_refused(spark):
    v = spark.range(1).select(F.col("id").alias("unit_id"), F.array(F.lit(1.0)).alias("vector"))
    q = spark.range(M.MOST_QUERIES + 1).select(F.col("id").alias("qid"), F.array(F.lit(1.0)).alias("query"))
    try:
        M.nearest(v, q, 1)
    except ValueError:
        return
    raise AssertionError
