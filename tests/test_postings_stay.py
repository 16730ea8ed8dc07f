"""Upkeep of postings: units leave without the others' postings being shuffled, and none carries what only the kept index needs."""

from quillspark.operators import lexical as X

TEXTS = [(1, "b a b", "T"), (2, "c c", ""), (3, None, "a"), (4, "", ""), (None, "a z", "")]


def test_units_leave_without_a_shuffle_of_the_others(spark, monkeypatch):
    units = spark.createDataFrame(TEXTS, "unit_id long, content string, title string")
    gone = spark.createDataFrame([(2,), (2,), (7,), (None,)], "unit_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = X.postings(units)
        assert index.columns == ["token", "unit_id", "tf"] and "shared" not in index._jdf.queryExecution().optimizedPlan().toString()
        left = X.without_units(index, gone).select(index.columns)
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
        want = {("a", 1, 1), ("b", 1, 2), ("t", 1, 1), ("a", 3, 1), ("a", None, 1), ("z", None, 1)}
        assert {tuple(r) for r in left.collect()} == want and left.count() == len(want)
        monkeypatch.setattr(X, "FEW_UNITS", 1)
        assert {tuple(r) for r in X.without_units(index, gone).select(index.columns).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
