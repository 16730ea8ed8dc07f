"""The kept index against a plain BM25 over all texts, through additions, removals and compaction."""

import math
import random
import re
import tempfile
from collections import Counter

import pytest
from conftest import SF

from quillspark.operators import kept_index as K
from quillspark.operators import lexical as X
from quillspark.plans import search as P
from quillspark.sources.tables import units

SCHEMA = "unit_id long, source string, tradition string, title string, content string"
QUESTIONS = [(1, "alpha beta"), (2, "alp"), (3, "the what"), (4, "zzzz"), (5, ""), (6, "x" * 40 + " gamma"), (7, "under_score delta"), (8, "hot rare alpha beta gamma delta")]


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["alpha", "alphabet", "alps", "beta", "betas", "gamma", "delta", "x" * 33, "x" * 50, "the", "of", "a1", "hot"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, [3, 2, 1, 4, 1, 2, 1, 0.1, 0.1, 9, 9, 2, 0], k=rng.randrange(60))) + (" hot" if i % 3 == 0 else "") + (" rare" if i == 77 else "")
        rows.append((i * 37, rng.choice(["s1", "s2", None]), rng.choice(["t1", None, ""]), rng.choice(["Alpha Title", None, ""]), None if i % 50 == 3 else text))
    return rows + [(10**12, "s1", "t1", "", ""), (-5, "s2", "t1", "beta", "beta"), (-6, "s2", "t1", "beta", "beta")]


def plain(rows, questions, k, scope=None):
    tokens = {r[0]: Counter(re.findall("[a-z0-9]+", " ".join(x for x in (r[4], r[3]) if x is not None).lower())) for r in rows}
    length = {u: sum(t.values()) for u, t in tokens.items()}
    mean = sum(length.values()) / max(len(rows), 1) or 1
    out = set()
    for qid, text in questions:
        score = Counter()
        for term in X.query_terms(text):
            tf = {u: c for u, t in tokens.items() if (c := sum(n for w, n in t.items() if w.startswith(term)))}
            idf = math.log(max(1.000001, (len(rows) - len(tf) + 0.5) / (len(tf) + 0.5)))
            for u, c in tf.items():
                score[u] += idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length[u] / mean))
        if scope:
            score = {u: s for u, s in score.items() if any(r[0] == u and (r[1] in scope[qid][0] or r[2] in scope[qid][1]) for r in rows)}
        best = sorted(score, key=lambda u: (-round(score[u], 9), u))[:k]
        out |= {(qid, u, n, round(score[u], 6)) for n, u in enumerate(best, 1)}
    return out


def asked(spark, root, k=7, **more):
    return {(r["ask"], r["unit_id"], r["rank"], round(r["score"], 6)) for r in K.top(spark, root, K.asks(QUESTIONS, k), **more).rows.collect()}


@pytest.fixture()
def root():
    return f"file://{tempfile.mkdtemp(prefix='spark-')}/index"


def test_index_is_bm25(spark, root):
    rows = corpus(1)
    K.add(spark.createDataFrame(rows, SCHEMA).repartition(3), root)
    for k in (1, 7, 1000):
        assert asked(spark, root, k) == plain(rows, QUESTIONS, k)


def test_index_through_its_life(spark, root):
    rows = {r[0]: r for r in corpus(2)}
    K.add(spark.createDataFrame(list(rows.values()), SCHEMA), root)
    drop = [u for i, u in enumerate(sorted(rows)) if i % 4 == 0]
    K.remove(spark, root, spark.createDataFrame([(u,) for u in [*drop, 123_456]], "unit_id long"))
    rows = {u: r for u, r in rows.items() if u not in drop}
    assert asked(spark, root) == plain(rows.values(), QUESTIONS, 7)
    again = [(u, "s9", "t9", "back", "alpha rare hot " + "gamma " * (u % 7)) for u in drop[:20]] + [(u, s, t, "new", "delta alphabetical") for u, s, t, *_ in list(rows.values())[:30]]
    K.add(spark.createDataFrame(again, SCHEMA), root)
    rows |= {r[0]: r for r in again}
    assert asked(spark, root) == plain(rows.values(), QUESTIONS, 7)
    K.compacted(spark, root, f"{root}-2")
    assert asked(spark, f"{root}-2") == plain(rows.values(), QUESTIONS, 7)
    K.remove(spark, root, spark.createDataFrame([(u,) for u in rows], "unit_id long"))
    assert asked(spark, root) == set()


def test_scopes(spark, root):
    rows = corpus(3)
    K.add(spark.createDataFrame(rows, SCHEMA), root)
    scope = {q: (["s1"], []) if q % 2 else (["s2"], ["t1"]) for q, _ in QUESTIONS}
    given = spark.createDataFrame([(q, s, None) for q, (ss, _) in scope.items() for s in ss] + [(q, None, t) for q, (_, ts) in scope.items() for t in ts], "ask int, source string, tradition string")
    wanted = [K.Ask(a.ask, a.terms, 7, True) for a in K.asks(QUESTIONS, 7)]
    got = {(r["ask"], r["unit_id"], r["rank"], round(r["score"], 6)) for r in K.top(spark, root, wanted, given).rows.collect()}
    assert got == plain(rows, QUESTIONS, 7, scope)


@pytest.mark.parametrize("bounds", [("MOST_TERMS", 2), ("MOST_LITERALS", 1), ("MOST_CHOSEN", 3), ("MOST_FILES", 0), ("PREFIXES", 4)])
def test_beyond_each_bound_results_are_the_same(spark, root, monkeypatch, bounds):
    rows = corpus(4, 120)
    monkeypatch.setattr(K, *bounds)
    K.add(spark.createDataFrame(rows, SCHEMA), root)
    assert asked(spark, root, first=2) == plain(rows, QUESTIONS, 7)


def test_nothing_and_what_is_refused(spark, root):
    assert asked(spark, root) == set()
    K.add(spark.createDataFrame([], SCHEMA), root)
    assert asked(spark, root) == set() and K.top(spark, root, []).rows.count() == 0
    for bad in ([(1, "s", "t", "", "a b c")] * 2, [(None, "s", "t", "", "x")]):
        with pytest.raises(ValueError, match="unit_id"):
            K.add(spark.createDataFrame(bad, SCHEMA), root)
    with pytest.raises(ValueError, match="questions"):
        K.top(spark, root, K.asks([(i, "x") for i in range(K.MOST_ASKS + 1)], 1))


def test_an_unfinished_segment_is_not_seen(spark, root):
    rows = corpus(5, 60)
    K.add(spark.createDataFrame(rows, SCHEMA), root)
    K._write_postings(spark.createDataFrame([("alpha", 1, "s", "t", 0, 1, 50, 50)], "token string, shelf long, source string, tradition string, block long, unit_id long, tf int, dl int"), root, 2)
    assert asked(spark, root) == plain(rows, QUESTIONS, 7)


def test_a_small_part_of_the_postings_is_read(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    root = P.kept(spark, sf)
    found = K.top(spark, root, K.asks(P.QUESTIONS, P.LIMIT))
    assert found.postings_read < 0.1 * K.Reader(spark, root).postings
    want = {(r.qid, r.unit_id, r["rank"], round(r.score, 6)) for r in X.top(X.bm25(units(spark, sf), P.QUESTIONS), P.LIMIT).collect()}
    assert {(r["ask"], r["unit_id"], r["rank"], round(r["score"], 6)) for r in found.rows.collect()} == want


def test_document_frequencies_without_pairs_of_unit_and_prefix(spark, root):
    """Counts of tokens by what they share with the one before tell how many units hold a prefix, through a removal; nothing is kept by prefix or twice by block."""
    rows = corpus(6)
    K.add(spark.createDataFrame(rows, SCHEMA), root)
    K.remove(spark, root, spark.createDataFrame([(r[0],) for r in rows[::3]], "unit_id long"))
    left = [set(re.findall("[a-z0-9]+", " ".join(x for x in (r[4], r[3]) if x).lower())) for i, r in enumerate(rows) if i % 3]
    terms = ["alp", "alpha", "alphabet", "bet", "betas", "gam", "x" * 32, "x" * 33, "zzz"]
    want = {t: n for t in terms if (n := sum(any(w.startswith(t) for w in own) for own in left))}
    assert K._document_frequencies(K.Reader(spark, root), terms) == want
    index = K.Reader(spark, root)
    held = spark.read.parquet(f"{root}/tokens").where("segment = 1")
    assert held.count() <= 4 * len({w for r in rows for w in re.findall("[a-z0-9]+", " ".join(x for x in (r[4], r[3]) if x).lower())})
    assert index.table("blocks").agg({"n": "sum"}).first()[0] == index.postings
