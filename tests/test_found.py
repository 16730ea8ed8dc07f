"""Queries against their SQL on inputs that the given tables lack."""

import duckdb
import pytest
from conftest import rows_of

from quillspark.plans import registry


@pytest.fixture()
def on(spark, tmp_path):
    """Checks a query against its SQL over tables made of rows."""
    def check(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.SQL[name])
        rows = rows_of(got.columns, got.collect())
        assert rows == rows_of(want.columns, want.fetchall())
        return rows

    return check


CUT = "<title>A &amp; B &amp</title><h1>A &amp;lt; &copy B &amp</h1><p>One &lt;two&gt; &nbsp &amp;</p><p>&#39;x&#39; &#38 &quot</p>"
PAGES = "page_id long, url string, html string"


def test_a_reference_that_was_cut_stays_html_clean(on):
    assert len(on("html_clean", pages=([(1, "u", CUT), (2, "u", "plain"), (3, "u", "")], PAGES))) == 3


def test_a_reference_that_was_cut_stays_html_paragraphs(on):
    assert len(on("html_paragraphs", pages=([(1, "u", CUT), (2, "u", "plain"), (3, "u", "")], PAGES))) == 2


ORDERS = "o_orderkey long, o_custkey long, o_orderpriority string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"


def test_a_book_without_any_head_has_no_report(on):
    """Customer 2 has one order, whose one page has a page number and no head."""
    orders = [(1, 1, "LOW"), (2, 2, "LOW"), (3, 1, "HIGH")]
    lines = [(1, 5, 1, 1, 9.0), (1, 6, 1, 2, 9.0), (2, 6, 1, 2, 9.0), (3, 7, 4, 2, 9.0)]
    assert len(on("running_heads_report", orders=(orders, ORDERS), lineitem=(lines, LINES))) == 4


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_no_call_of_pandas_for_each_stream(spark):
    """Streams are parted within batches, also where a batch ends within a stream or holds many."""
    from quillspark.streaming import answers, tokens

    rows = [(f"s{s}", i, c, i == 3) for s in range(40) for i, c in enumerate([f"<think>{s}", "no</thi", f"nk>yes{s}", "\n"])]
    chunks = spark.createDataFrame(rows, "stream_id string, seq long, chunk string, is_last boolean").repartition(7)
    events = answers.events(chunks, spark.createDataFrame([("s5", 3), ("s41", 0)], "stream_id string, seq long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        shown, kept = tokens.batch(chunks, "reasoning"), answers.batch(events)
        assert "FlatMapGroupsInPandas" not in _plan(shown) + _plan(kept)
        assert sorted((r.stream_id, r.seq, r.text) for r in shown.collect()) == sorted(x for s in range(40) for x in ((f"s{s}", 2, f"yes{s}"), (f"s{s}", 3, "\n")))
        ended = {r.stream_id: r.event for r in kept.collect() if r.event != "text"}
        assert ended == {f"s{s}": "end" for s in range(40)} | {"s5": "cancelled", "s41": "cancelled"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_are_counted_in_batches(spark):
    from quillspark.operators.audit import most_repeated

    texts = ["a b c A B C a, b; c", "a b c d a b c d", "a b", "", None, "x " * 50, "It's so. It's so. it's SO"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = df.select("i", most_repeated(df.t).alias("n"))
    assert "lambdafunction" not in _plan(found)
    assert [r.n for r in found.orderBy("i").collect()] == [3, 2, 0, 0, None, 48, 2]


def test_a_report_does_not_cut_texts_again(spark):
    from quillspark.operators import nested as N

    texts = spark.createDataFrame([("w", "1:1 In it. 1:2 And so 2:1 Then.")], "work string, text string")
    report = N.report(N.sections(texts, N.FORMS["verses"]), N.FORMS["verses"], texts)
    assert "Window" not in _plan(report) and report.count() > 0
