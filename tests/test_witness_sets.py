"""Containment by sets of witnesses against counting pair by pair."""

import random
import re

from quillspark.operators import audit


def _pairs(text):
    words = re.findall("[a-z]{2,}", (text or "").lower())
    return set(zip(words, words[1:]))


def test_sets_over_blocks_with_a_pair_in_every_text(spark):
    rng = random.Random(5)
    words = ["of", "the", "lord", "grace", "faith", "work", "book", "law"]
    text = lambda: "of the " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    witnesses = [(i, text()) for i in (0, 1, 2, audit.BLOCK - 1, audit.BLOCK, 3 * audit.BLOCK + 5)] + [(9, None), (10, "x"), (-3, text())]
    units = [(i, text()) for i in range(60)] + [(60, None), (61, ""), (62, "nothing shared")]
    got = audit.containment(spark.createDataFrame(units, "unit_id long, content string"), spark.createDataFrame(witnesses, "witness_id long, text string"))
    want = {}
    for u, own in units:
        for w, other in witnesses:
            shared = _pairs(own) & _pairs(other)
            if shared:
                want[u, w] = (len(shared), len(shared) / len(_pairs(other)))
    assert {(r.unit_id, r.witness_id): (r.shared, r.containment) for r in got.collect()} == want
    grams, members = audit.witness_sets(spark.createDataFrame(witnesses, "witness_id long, text string"))
    assert grams.where("gram = 'of the'").count() == 4 and members.groupBy("set").count().agg({"count": "max"}).first()[0] <= audit.BLOCK
