"""Releases, footers of pages, and counts of groups of any size."""

from collections import Counter

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import joins, release
from quillspark.sources import snapshots


def test_release_is_read_back_and_damage_is_found(spark, tmp_path):
    root = f"file://{tmp_path}/r1"
    units = spark.createDataFrame([("a b:c", "s1", 1, "x"), ("a b:c", "s1", 2, "y"), ("a b:c", "s2", 3, "z"), ("core", "s3", 4, "w")], "fragment string, source string, unit_id int, content string")
    chunks = units.where("unit_id < 3").select("fragment", F.col("unit_id").alias("chunk_id"))
    collections = spark.createDataFrame([("c1", "k", "One", "d"), ("c2", "k", "Two", "d"), ("c3", "k", "None", "d")], "id string, kind string, name string, description string")
    members = spark.createDataFrame([("c1", 2, "a b:c"), ("c1", 1, "core"), ("c1", 3, "core"), ("c2", 1, "not built"), ("c2", 2, "core"), ("c3", 1, "not built")], "collection string, nth int, fragment string")
    path = release.publish(spark, root, {"units": units, "chunks": chunks}, collections, members, 15, 2, "m", units.groupBy("source").count())
    read = snapshots.manifest(spark, path)
    rows = {r.id: r for r in read["fragments"].collect()}
    assert {(r.id, r.sources, r.units, r.chunks, r.idSpace, r.embeddingModel) for r in rows.values()} == {("a b:c", 2, 3, 2, 2, "m"), ("core", 1, 1, 0, 2, "m")}
    assert all(r.bytes > 0 and len(r.sha256) == 64 for r in rows.values())
    assert sorted((r.collection, r.fragment) for r in read["members"].collect()) == [("c1", "a b:c"), ("c1", "core"), ("c2", "core")]
    assert release.damaged(spark, root, ["units", "chunks"], read["fragments"]).count() == 0
    part = next((tmp_path / "r1/units/fragment=core").glob("*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    next(part.parent.glob(".*.crc")).unlink()
    assert [tuple(r) for r in release.damaged(spark, root, ["units", "chunks"], read["fragments"]).collect()] == [("core", "content")]
    part.write_bytes(whole + b"x")
    assert [tuple(r) for r in release.damaged(spark, root, ["units", "chunks"], read["fragments"]).collect()] == [("core", "size")]
    part.unlink()
    assert [tuple(r) for r in release.damaged(spark, root, ["units", "chunks"], read["fragments"]).collect()] == [("core", "missing")]


def test_page_footer(spark):
    long = "<p>About this page</p><p>Source. Translated by S.D.F. Salmond. From <i>Fathers</i>, Vol. 9. Edited by P. S. (Buffalo, 1899.) " + "z" * 600 + "</p>"
    pages = {"<p>text</p>": None, "About this page. No origin.": None, long: "Translated by S.D.F. Salmond. From Fathers"}
    df = spark.createDataFrame([(k,) for k in pages] + [(None,)], "h string")
    got = {r.h: r.f for r in df.select("h", T.page_footer(df.h).alias("f")).collect()}
    assert got["<p>text</p>"] is None and got["About this page. No origin."] is None and got[None] is None
    f = got[long]
    assert len(f.citation) == 400 and f.citation.startswith("Translated by S.D.F. Salmond. From Fathers") and (f.translator, f.edition, f.year) == ("S.D.F. Salmond", "Fathers , Vol. 9", 1899)


def test_counts_of_large_small_and_null_groups(spark, monkeypatch):
    monkeypatch.setattr(joins, "LARGEST", 2)
    keys = ["hot"] * 50 + [None] * 7 + ["warm"] * 5 + ["two"] * 2 + ["one"]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    want = Counter(keys)
    assert {(r.i, r.n) for r in joins.with_counts(rows, ["k"], "n").collect()} == {(i, want[k] if want[k] > 1 else None) for i, k in enumerate(keys)}
    some = {(r.i, r.n) for r in joins.with_counts(rows, ["k"], "n", 1, F.col("i") % 2 == 0).collect()}
    even = Counter(k for i, k in enumerate(keys) if i % 2 == 0)
    assert some == {(i, even[k] or None) for i, k in enumerate(keys)}
    assert joins.with_counts(rows.where("false"), ["k"], "n").count() == 0
