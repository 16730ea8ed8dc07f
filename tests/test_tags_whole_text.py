"""Tags of search_rag come from whole texts; the queries whose SQL cuts texts keep that cut."""

import re

from conftest import SF
from quillspark.operators import tagging as G
from quillspark.plans import search as P
from quillspark.sources.tables import units

#: A keyword behind the first 4,000 characters, across that place, and as the last word of a long text.
LATE = [(10, "x " * 2500 + "nicht x"), (11, "x " * 1998 + "nicht x"), (12, "x " * 100_000 + "Nicht"), (13, "x " * 2500 + "nichtig")]


def test_tags_of_whole_texts(spark):
    rows = units(spark, SF).collect()
    want = {(r.unit_id, slug) for r in rows for k, slug in P.KEYWORDS.items() if re.search(G._whole(k), f"{r.title} {r.content}", re.ASCII)}
    of = lambda *scan: [(r.unit_id, r.slug) for r in G.unit_tags(units(spark, SF), P.KEYWORDS, *scan).collect()]
    whole, cut = of(), of(G.SCAN)
    assert sorted(whole) == sorted(want) and set(cut) < want


def test_search_rag_finds_a_late_keyword(spark, tmp_path):
    """Nothing but its tag leads to a unit here: question 3 has the topic nicht-tag."""
    docs = [(1, "Ungen keiter"), (2, "worthless"), *LATE]
    spark.createDataFrame([(n, text, "de", f"src{n}", len(text)) for n, text in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [1.0, n / 10], 0) for n in (3, 5, 7)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.unit_id for r in P.search_rag(spark, str(tmp_path)).where("qid = 3").collect()}
    assert found >= {1, 10, 11, 12} and 13 not in found
    tagged = {r.unit_id for r in P.keyword_tags(spark, str(tmp_path)).collect()}
    assert tagged == {2}
