"""Filter audit, centroid clustering and secret scan against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import filter_audit, lloyd, queries, secret_scan
from test_operators import TEXTS, prose

# --- centroid clustering ---


def plain_lloyd(rows, k=lloyd.K, rounds=lloyd.ROUNDS):
    """vec_id, cluster, distance of all rows, and the centroids, with Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for i, own in groups.items():
            centroids[i] = [sum(column) // len(own) for column in zip(*own)]
    return sorted((repr(i), near(v)[1], near(v)[0]) for i, v in kept), centroids


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "q") for i, v in rows], "vec_id long, embedding array<float>, cluster string, q string").repartition(3)


def test_clusters(spark):
    rng = np.random.default_rng(5)
    vec = lambda: [float(np.float32(x)) for x in rng.normal(0, 1, 64)]
    hot = vec()
    rows = [(i, vec()) for i in range(60)] + [(i, hot) for i in range(60, 120)] + [(7, vec()), (7, hot), (None, vec()), (None, hot)]
    rows += [(200, None), (201, []), (202, hot[:63]), (203, hot + [0.0]), (204, [None] + hot[1:]), (205, [math.nan] + hot[1:]), (206, [math.inf] + hot[1:]), (207, [0.0] * 64), (208, [-0.001] * 64)]
    got, centroids = lloyd.cluster(vectors_of(spark, rows))
    want, plain = plain_lloyd(rows)
    assert centroids.tolist() == plain
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"]) for r in got.collect()) == want


def test_fewer_vectors_than_centroids(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)] + [(9, [1.0] * 64)]
    got, centroids = lloyd.cluster(vectors_of(spark, rows))
    want, plain = plain_lloyd(rows)
    assert centroids.tolist() == plain and len(plain) == 4
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"]) for r in got.collect()) == want


def test_ties_go_to_the_lower_centroid():
    assert lloyd.nearest(np.array([[0, 0]]), np.array([[1, 0], [0, 1], [-1, 0]]))[0].tolist() == [0]


def test_clusters_of_nothing(spark):
    got, centroids = lloyd.cluster(vectors_of(spark, []))
    assert got.count() == 0 and len(centroids) == 0


def test_components_beyond_64_bits_name_their_vector(spark):
    with pytest.raises(Exception, match="vec_id 31"):
        lloyd.cluster(vectors_of(spark, [(31, [3e37] * 64), (1, [0.0] * 64)]))[0].collect()


# --- filter audit ---


def plain_audit(rows, labels):
    first, good, toxic = {}, set(), set()
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, q, t in labels:
        good |= {doc_id} if q == 1 and doc_id is not None else set()
        toxic |= {doc_id} if t == 1 and doc_id is not None else set()
    failing = []
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ("A" if len(w) < 100 else "") + ("B" if 100 * len(set(w)) < 80 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else "")
        f += ("D" if re.search("[#$%&*|]", t) else "") + ("E" if doc_id is not None and doc_id > first[t] else "")
        failing.append((lang or "", f, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failing}:
        own = [x[1:] for x in failing if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone, kept = [x for x in left if letter in x[0]], [x for x in left if letter not in x[0]]
                fails = [x for x in own if letter in x[0]]
                out[part, order, step] = [len(kept), len(gone), len(fails) - len(gone), sum(x[0] == letter for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shapley[part, letter] += len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run_audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, lang string, part string, n long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    out = {tuple(r[:3]): tuple(r[3:]) for r in got}
    assert len(out) == len(got)
    return out


def test_audit(spark):
    rng = random.Random(3)
    langs = ["en", "de", None, ""]
    texts = TEXTS + ["# " + prose(150), "ABC " * 120, "a|b", "TITLE", " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i}" for i in range(100)), " ".join([*map(str, range(80)), *["x"] * 20])]
    rows = [(i, t, langs[i % 4]) for i, t in enumerate(texts)] + [(i + 500, rng.choice(texts), rng.choice(langs)) for i in range(60)]
    rows += [rows[5], rows[5], (rows[9][0], rows[9][1], "de"), (None, "one", "en"), (None, prose(150), "en"), (None, "one", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 500, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10_000, 1, 1)]
    assert run_audit(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert run_audit(spark, [], []) == {}


def test_many_distinct_words_are_no_square(spark):
    text = " ".join(f"w{i:x}" for i in range(300_000))
    assert run_audit(spark, [(1, text, "en")], []) == plain_audit([(1, text, "en")], [])


# --- secrets ---

PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def plain_spans(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, (p, ok)) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if ok(m)]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def odd_texts():
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return [
        None, "", "token=", 'token = "' + hexes(40) + '" x', "é😀 TOKEN: '" + hexes(40), "password: token:abcdefghijk", "api_key=api-key=abcdefgh", "ApiKey = 12345678", "secret:1234567", "toKen=abcdefgh", "ſecret=abcdefgh1",
        "AKIA" + "A1" * 6, "AKIA" + "A1" * 5, "xAKIAAKIA" + "B2" * 9, hexes(31), hexes(32), "g" + hexes(33) + "g", hexes(500), "passwd  =  \"" + "A1b2" * 5000 + "\"", "x" * 70_000 + " token=" + hexes(20),
        "퟿é token='" + hexes(8), "secret=" + hexes(64) + "\nsecret=" + hexes(64), "token\n=abcdefgh", "token: abcdefgh",
    ]


def test_base_spans(spark):
    texts = odd_texts() + TEXTS[:12]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[3], "s")], "doc_id long, text string, spans string").repartition(3)
    got = secret_scan.find(docs, None).collect()
    want = [(i, plain_spans(t)) for i, t in enumerate(texts)] + [(0, plain_spans(texts[3]))]
    assert sorted((r["doc_id"], [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in got) == sorted(want)
    assert all(s["text"] == (texts[r["doc_id"]] or "")[s["start"] : s["end"]] for r in got for s in r["spans"] if r["doc_id"])


def plain_forward(net, codes, inside):
    """The network for one window, one place and one filter at a time."""
    w = net.weights
    inner, outer = [0.0] * secret_scan.FILTERS, [0.0] * secret_scan.FILTERS
    for p in range(len(codes)):
        x = []
        for q in range(p - 2, p + 3):
            x += [*w["embed"][codes[q]].tolist(), float(inside[q])] if 0 <= q < len(codes) else [0.0] * (secret_scan.EMBED + 1)
        for f in range(secret_scan.FILTERS):
            h = sum(a * float(b) for a, b in zip(x, w["conv"][:, f])) + float(w["conv0"][f])
            if inside[p]:
                inner[f] = max(inner[f], h)
            elif codes[p]:
                outer[f] = max(outer[f], h)
    d = [max(0.0, sum(a * float(b) for a, b in zip(inner + outer, w["dense"][:, k])) + float(w["dense0"][k])) for k in range(secret_scan.HIDDEN)]
    return sum(a * float(b) for a, b in zip(d, w["out"][:, 0])) + float(w["out0"][0])


def some_windows(texts):
    s = secret_scan.take_apart(pa.array(texts))
    return next(iter(secret_scan.windows(s, np.arange(len(s.starts)))))


def test_network_is_a_convolution():
    net = secret_scan.Network(3)
    _, codes, inside = some_windows(["token=ab12cd34 é x", "see a1b2c3d4e5"])
    assert net.forward(codes, inside) == pytest.approx([plain_forward(net, c, i) for c, i in zip(codes.tolist(), inside.tolist())], rel=1e-4)


def test_gradients():
    net = secret_scan.Network(4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    _, codes, inside = some_windows(["token=ab12cd34 é x", "see a1b2c3d4e5", "id " + "9f" * 40])
    held, slope = {}, np.array([0.3, -0.7, 0.2, 0.4])[: len(codes)]
    net.forward(codes, inside, held)
    for name, g in net.backward(held, slope).items():
        for at in list(zip(*np.nonzero(np.abs(g) > 1e-4)))[:8]:
            old, sums = net.weights[name][at], []
            for step in (1e-5, -1e-5):
                net.weights[name][at] = old + step
                sums.append(float(net.forward(codes, inside) @ slope))
            net.weights[name][at] = old
            assert (sums[0] - sums[1]) / 2e-5 == pytest.approx(g[at], rel=0.02, abs=2e-3)


def test_threshold_keeps_recall():
    scores, labels = np.array([0.1, 0.2, 0.6, 0.7, 0.8, 0.9]), np.array([0, 0, 1, 0, 1, 1])
    assert secret_scan.threshold(scores, labels, 1.0) == pytest.approx(0.4)  # all three secrets, one false alarm either way
    assert secret_scan.threshold(scores, labels, 0.6) == pytest.approx(0.75)
    rng = np.random.default_rng(1)
    for _ in range(50):
        s, y = rng.random(60), (rng.random(60) < 0.4).astype(int)
        t = secret_scan.threshold(s, y, 0.9)
        assert (s[y == 1] >= t).mean() >= 0.9


def test_platt_is_calibrated():
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 3, 20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * logits - 1)))).astype(int)
    assert secret_scan.platt(logits, labels) == pytest.approx((0.5, -1), abs=0.05)


def corpus(rng):
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for _ in range(240):
        rows.append(f"{prose(rng.randrange(8, 30), rng)} token = \"{hexes(40)}\" {prose(9, rng)}")
        rows.append(f"{prose(6, rng)} {prose(1, rng)}.{rng.randrange(10, 99)}x@mail{rng.randrange(9)}.example.com {prose(9, rng)}")
        rows.append(f"{prose(6, rng)} release-{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(30)} {prose(9, rng)}")
    return rows


def test_model_finds_what_rules_miss(spark):
    rng = random.Random(21)
    docs = spark.createDataFrame(list(enumerate(corpus(rng))), "doc_id long, text string").repartition(4)
    judge = secret_scan.fit(docs)
    hexes = lambda n: "".join(rng.choice("0123456789ABCDEF") for _ in range(n))
    planted = [f"{prose(12, rng)} auth value {hexes(40)} {prose(5, rng)}" for _ in range(50)]
    clean = [f"{prose(9, rng)} {prose(1, rng)}.{rng.randrange(10, 99)}y@mail{rng.randrange(9)}.example.com release-{rng.randrange(9)}.{rng.randrange(99)}.0 {prose(30, rng)}" for _ in range(50)]
    texts = planted + clean + odd_texts()
    got = {r["doc_id"]: r["spans"] for r in secret_scan.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), judge).collect()}
    added = {i: [s for s in spans if s["kind"] == secret_scan.MODEL] for i, spans in got.items()}
    assert sum(bool(added[i]) for i in range(50)) >= 45
    assert sum(bool(added[i]) for i in range(50, 100)) <= 2
    # the same spans and scores as one candidate at a time by the plain network
    for i in (0, 50, *range(100, len(texts))):
        s = secret_scan.take_apart(pa.array([texts[i]], pa.string()))
        want = []
        for k in range(len(s.starts)):
            parts = [(c, m) for _, codes, inside in secret_scan.windows(s, np.array([k])) for c, m in zip(codes, inside)]
            if not s.base_touched[k] and len(parts) < 5:
                score = max(1 / (1 + math.exp(-(judge.a * plain_forward(judge.network, c.tolist(), m.tolist()) + judge.b))) for c, m in parts)
                value = bytes(s.signs[s.starts[k] : s.ends[k]]).decode()
                if score >= judge.thresholds[0 if re.fullmatch("[0-9a-fA-F]+", value) else 1]:
                    want.append((int(s.starts[k]), int(s.ends[k]), value))
        assert [(x["start"], x["end"], x["text"]) for x in added[i] if x["end"] - x["start"] < 200] == want
        assert [(x["start"], x["end"], x["kind"]) for x in got[i] if x["kind"] != secret_scan.MODEL] == plain_spans(texts[i])
    for i, spans in added.items():
        assert all(s["end"] <= b["start"] or b["end"] <= s["start"] for s in spans for b in got[i] if b["kind"] != secret_scan.MODEL)


def test_too_few_findings_make_no_model(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh12"), (2, None)], "doc_id long, text string")
    assert secret_scan.fit(docs) is None
    assert secret_scan.find(docs.limit(0), None).count() == 0


def test_secret_query(spark):
    rows = queries.QUERIES["op12_secret_scan"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[2] == k for x in base) for k in PLAIN]
