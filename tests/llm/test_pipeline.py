"""The pipeline's stages one after another, against plain versions of each."""

import re
from collections import Counter

from conftest import SF
from test_operators import WORD, low, plain_near

import corpus_pipeline
from quillspark.llm import mixing, toxicity
from quillspark.llm.shared import materialize, table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mix", "pack"]
    before = docs
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, SF, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs.select("doc_id", "text"), model).where("__toxic = 1").collect()}
    after = materialize(stages["toxicity"](spark, before, SF), "t")
    texts = {r.doc_id: r.text for r in before.collect()}
    assert after.columns == columns and {r.doc_id for r in after.collect()} == set(texts) - bad

    texts = {r.doc_id: r.text for r in after.collect()}
    before, after = after, materialize(stages["exact_dedup"](spark, after, SF), "t")
    largest = {}
    for i, t in texts.items():
        largest[low(t)] = max(i, largest.get(low(t), i))
    assert after.columns == columns and sorted(r.doc_id for r in after.collect()) == sorted(largest.values())

    texts = {r.doc_id: r.text for r in after.collect()}
    before, after = after, materialize(stages["near_dedup"](spark, after, SF), "t")
    want = plain_near(texts)
    assert after.columns == columns and sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in want.items() if i == c)

    copies = {r.doc_id: r.copies for r in mixing.mixture(after).collect()}
    before, after = after, materialize(stages["mix"](spark, after, SF), "t")
    got = Counter(r.doc_id for r in after.collect())
    assert after.columns == columns and all(got[i] == n for i, n in copies.items())

    packed = stages["pack"](spark, after, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == got
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert len(re.findall(WORD, "a b")) == 2


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
