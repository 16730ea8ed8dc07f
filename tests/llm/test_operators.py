"""The ten operators against plain versions, on small fixtures that hold every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, exact_dedup, exact_topk, language, licenses, mixing, near_dedup, packing, pii, queries, secret_scan, token_counts, toxicity

RNG = random.Random(11)
VOCAB = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lo", "mi", "nu", "ra", "st")]
WORD = r"[^\x20\x09-\x0D]+"


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def changed(text, n, rng=RNG):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


BASE_TEXTS = [prose(n) for n in (3, 8, 60, 120, 300)]
HOT = prose(150)
TEXTS = (
    [None, "", " \t\n", "one", "A  b\tC", "a b c", "LONG " + prose(40_000), "x" * 70_000, "😀 " + prose(20)]
    + BASE_TEXTS
    + [t.upper() for t in BASE_TEXTS]
    + [changed(BASE_TEXTS[3], k) for k in (1, 2, 3, 12)]
    + [changed(BASE_TEXTS[4], k) for k in (1, 4, 8, 9, 60)]
    + [HOT] * 40
    + [changed(HOT, k % 5) for k in range(40)]
    + [prose(RNG.randint(1, 400)) for _ in range(40)]
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies string, __hash string, n_tokens int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["hot", "hot", "b", None, ""][i % 5], len(t or ""), 1, "c", "h", 7, 0.5) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "hot", 3, 1, "c", "h", 7, 0.5), (5, "a b c", "en", "hot", 5, 1, "c", "h", 7, 0.5)]  # rows that repeat
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# --- SQL ---


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_no_rows_from_no_rows(name, spark, empty, monkeypatch):
    tables = {
        "documents": empty,
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([], "page_id long, url string, html string"),
    }
    for m in (pii, toxicity, language, licenses, packing, token_counts, near_dedup, secret_scan):
        monkeypatch.setattr(m, "table", lambda s, d, n: tables[n])
    assert queries.QUERIES[name](spark, "").collect() == []


# --- 1 PII ---

PII_TEXTS = [
    "a@b.co-x%y@d.e", "a@b@c.d a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.4", "😀 x@y.zz 😀 +1 (911) 555-1477, 4111 1111 1111 1111", "4111111111111111 4111111111111112",
    None, "", "9" * 30_000, "a" * 50_000 + "@", "x@y.z " * 3000, "Dr. Anna Smith called; tel (212) 555-1234 ssn 123-45-6789", "+" * 10 + "1234567890", "1 " * 20_000,
    "+1 23-45", "1-2-3 4", "0.0.0.256", "+49 (0)30.1234567 x", "card 4111-1111-1111-1111-", "é@ü.de a@é.de a@b.é",
]
PII_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = []
    for nth, (kind, pattern) in enumerate(PII_PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0
            good = {"email": True, "ip": all(int(p) < 256 for p in m.group().split(".") if kind == "ip"), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), nth, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_pii(spark, monkeypatch):
    rng = random.Random(2)
    noise = ["".join(rng.choice("a1.@+- ()9") for _ in range(60)) for _ in range(150)]
    texts = PII_TEXTS + noise
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pii, "table", lambda *a: df)
    got = {r.doc_id: r for r in pii.op1_pii(spark, "").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = plain_pii(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in PII_PLAIN]
        assert set(want) <= set(got[i].spans.split(",") if got[i].spans else [])
    assert "name:0:14" in got[10].spans and "ssn:46:57" in got[10].spans
    assert got[4].spans == ""  # one match of 32 digits


def test_em_finds_the_bad_labeler():
    rng = random.Random(4)
    n = Counter()
    for _ in range(20_000):
        truth = rng.random() < 0.4
        votes = tuple(int((rng.random() < a) == truth) for a in (0.95, 0.9, 0.6))
        n[votes] += 1
    prior, rates = pii.reliabilities([("k", v, c) for v, c in n.items()])
    assert abs(prior["k"] - 0.4) < 0.03
    assert rates[0][0] > 0.92 and rates[1][0] > 0.87 and 0.55 < rates[2][0] < 0.65


# --- 2 toxicity ---


def test_toxicity_on_held_out(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng.randint(10, 80), rng) + (" vile scum" if i % 3 == 0 else ""), i % 3 == 0) for i in range(900)] + [(10_000, None, False), (10_001, "", True)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 2] + [(None, 1), (77_777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), labels)
    assert 0 < len(model[0]) < 2000
    got = {r.doc_id: r.__getitem__("__toxic") for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    held = [i for i, _, _ in rows if i < 10_000 and zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = sum(got[i] != int(i % 3 == 0) for i in held)
    assert len(held) > 100 and wrong <= 2
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and 590 <= kept.count() <= 610


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs.select("doc_id", "text"), model).agg(F.max("__score"), F.count("*")).first()
    assert tuple(got) == (0.0, docs.count())


def test_skip_grams_are_features():
    import pyarrow as pa

    at, text = toxicity.features(pa.array(["a b c", "a x c", "", None]))
    a, b = (set(at[text == k].tolist()) for k in (0, 1))
    assert len(a) == 6 == len(b) and len(a & b) == 3  # a, c, and a_c over the gap


# --- 3 mixing ---


def test_mixing(spark, docs):
    got = [r.asDict() for r in mixing.mixture(docs).collect()]
    again = [r.asDict() for r in mixing.mixture(docs.repartition(7)).collect()]
    key = lambda r: tuple(map(repr, r.values()))
    assert sorted(got, key=key) == sorted(again, key=key)
    sizes = defaultdict(int)
    for r, t in ((r, r["size"]) for r in got):
        sizes[r["source"]] += t
    assert all(r["source_size"] == sizes[r["source"]] and r["copies"] <= 2 for r in got)
    targets = {r["source"]: r["target"] for r in got}
    assert math.isclose(sum(targets.values()), min(1.5 * sum(sizes.values()), 2 * sum(sizes.values())), rel_tol=1e-9)
    assert all(t <= 2 * sizes[s] + 1e-6 for s, t in targets.items())
    order = sorted((s for s in targets if s is not None)) + [None]
    free = [(targets[s], w) for s, w in zip(order, (5, 2, 1, 5)) if targets[s] < 2 * sizes[s] - 1e-6]
    assert len({round(t / w, 6) for t, w in free}) <= 1
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_mixing_comes_near_targets(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 30 + 1).cast("int")).alias("text"))
    rows = mixing.mixture(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert len(rows) == 9 and all(abs(r.taken - r.target) < 0.12 * r.target for r in rows)


# --- 4 language ---


def test_language(spark):
    rng = random.Random(8)
    words = {"aa": ["thing", "with", "the"], "bb": ["über", "schon", "nicht"], "cc": ["pour", "dans", "être"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    train = spark.createDataFrame([(i, text(lang, 30), lang) for i, lang in enumerate(list(words) * 40)] + [(999, None, "aa"), (1000, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model[0] == ["aa", "bb", "cc"]
    pages = [(i, f"http://h{i % 5}.example.{lang}/x", f'<html lang="{lang}"><p>{text(lang, 12)}</p></html>', lang) for i, lang in enumerate(list(words) * 40)]
    pages += [(500, "http://only.bb/1", "<html><p>nicht schon</p>", "bb"), (501, "http://h0.example.cc/q", "<html></html>", None), (502, None, None, None), (503, "::bad::", "", None), (504, "http://h1.example.aa/", '<html lang="bb"><p>' + text("aa", 40), "aa"), (504, "http://h1.example.aa/", '<html lang="bb"><p>' + text("aa", 40), "aa")]
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h, _ in pages], "page_id long, url string, html string, lang string, n int")
    rows = language.identify(df, model).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r for r in rows}
    assert all(got[i].lang == lang for i, _, _, lang in pages if lang)
    assert got[501].lang == "cc" or got[501].confidence < 0.9  # the address is all there is
    assert all(0 < r.confidence <= 1.0 + 1e-9 for r in rows)
    assert [r.lang for r in language.identify(df, ([], model[1][:0])).limit(2).collect()] == [None, None]


def test_visible_text():
    assert language.visible_text("<script>a</script><p>b &amp; c<!-- d --><b>e</b>") == "b & c e"


# --- 5 licenses ---


def plain_lis(values):
    best = 0
    for mask in range(1 << len(values)):
        own = [v for i, v in enumerate(values) if mask >> i & 1]
        if all(a < b for a, b in zip(own, own[1:])):
            best = max(best, len(own))
    return best


def test_increasing():
    rng = random.Random(3)
    for _ in range(60):
        v = rng.sample(range(20), rng.randint(0, 9))
        at = licenses.increasing(v)
        assert at == sorted(at) and all(v[a] < v[b] for a, b in zip(at, at[1:])) and len(at) == plain_lis(v)


def test_alignment():
    assert licenses.align(list("abcd"), list("abcd")) == [(i, i) for i in range(4)]
    assert licenses.align(list("xaybzc"), list("abc")) == [(1, 0), (3, 1), (5, 2)]
    assert licenses.align([], list("ab")) == [] == licenses.align(list("aa"), list("bb"))


def test_license_scan(spark):
    texts = {0: None, 1: "", 2: "é😀 Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0.", 3: "Released under the MIT License. " * 5, 4: prose(30) + " " + licenses.TEMPLATES[1][1] + " " + prose(9) + licenses.TEMPLATES[12][1], 5: "the license under the version of the work " * 3000, 6: "released under a mit license", 7: licenses.TEMPLATES[6][1].replace("redistribute", "copy")}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, license string")
    rows = licenses.find(df).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        found[r.doc_id].append((r.license, texts[r.doc_id][r.start : r.end]))
    assert found[2] == [("Apache-2.0", "Licensed under the Apache License, Version 2.0")] * 2
    assert found[3] == [("MIT", "Released under the MIT License")] * 5
    assert [k for k, _ in found[4]] == ["MIT", "BSD-3-Clause"] and [k for k, _ in found[7]] == ["GPL-3.0-or-later"]
    assert set(found) == {2, 3, 4, 7}


NOTICES = {
    "All rights reserved.": "proprietary", "(c) 2021 K. Miller & Co. ALL RIGHTS RESERVED": "proprietary", "Alle Rechte vorbehalten": "proprietary", "All rights reserved. No part may be copied.": "proprietary",
    "Licensed under the Apache License 2.0": "Apache-2.0", "licensed under Apache License, version 2.0; see 2 and 0": "Apache-2.0", "Available under the Apache License, Version 2.0": "Apache-2.0",
    "This project is licensed under the MIT license": "MIT", "// SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "This book is licensed under the GNU Public License, version 3": "GPL-3.0", "Licensed under GPLv2": "GPL-2.0", "Licensed under the GPLv2": "GPL-2.0", "licensed under the GNU General Public License v3.0 or the MIT one": "GPL-3.0",
    "available under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Licensed under CC BY 3.0": None,
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License": "CC-BY-NC-4.0",
    "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSD-3-Clause",
    "all seats and rights were reserved": None, "licensed under the Apache License, Version 1.1": None, "This work is licensed under the GNU General Public License, version 1": None,
}


def test_license_notices_in_other_words(spark):
    df = spark.createDataFrame([(i, f"{prose(20)} {t} {prose(20)}") for i, t in enumerate(NOTICES)], "doc_id long, text string")
    found = defaultdict(list)
    for r in licenses.find(df).collect():
        found[r.doc_id].append(r.license)
    assert {t: found[i] for i, t in enumerate(NOTICES)} == {t: [k] if k else [] for t, k in NOTICES.items()}


def test_license_bound_skips_nothing(spark):
    """Notices planted among the words of other notices are found wherever they stand."""
    rng = random.Random(12)
    scanner = licenses.Scanner(coverage=0.75)
    import pyarrow as pa

    words = "licensed released under the mit apache license version cc by nc 4 0 2 gnu".split()
    for _ in range(40):
        tokens = [rng.choice(words) for _ in range(40)]
        k = rng.randrange(30)
        tokens[k : k + 5] = "released under the mit license".split() if rng.random() < 0.7 else tokens[k : k + 5]
        got = {t for _, t, *_ in scanner.scan(pa.array([" ".join(tokens)]))}
        h = licenses._words(pa.array([" ".join(tokens)]))[4].tolist()
        for t, own in enumerate(scanner.words[:4]):
            exact = any(h[a : a + len(own)] == own for a in range(len(h)))
            assert not exact or t in got or any(len(scanner.words[x]) >= len(own) for x in got)


# --- 6 packing ---


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, ids=True).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    texts = dict(enumerate(TEXTS))
    for i, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        rows = sorted({(r.piece, r.start, r.length, tuple(r.ids), r.ids_crc32) for r in by_doc[i]})
        assert [x for r in rows for x in r[3]] == ids and [r[0] for r in rows] == list(range(len(rows)))
        assert all(r[1] == 2048 * r[0] and r[2] == len(r[3]) and r[4] == zlib.crc32(np.array(r[3], "<u4").tobytes()) for r in rows)
    assert len(by_doc[3]) == 2
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= 1.25 * math.ceil(total / 2048) + 1


def best_fit_decreasing(counts, size):
    """Sequences that best-fit decreasing takes, piece by piece."""
    gaps: list[int] = []
    for n in sorted(counts.elements(), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(size - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def rounds(counts, size):
    """Bins, and how many rounds they took; checks that every rank has its place and nothing overlaps."""
    own, n = packing.Round({x: [0, c] for x, c in counts.items()}, [], 0, size), 0
    while own.classes:
        own.run()
        n += 1
    spans = defaultdict(list)
    ranks = defaultdict(list)
    for length, lo, hi, each, first, at in own.flows:
        for k in range(lo, hi):
            ranks[length].append(k)
            spans[first + (k - lo) // each].append((at + (k - lo) % each * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(c)) for x, c in counts.items()}
    for own_spans in spans.values():
        end = 0
        for at, length in sorted(own_spans):
            assert at == end
            end += length
        assert end <= size
    assert set(spans) == set(range(own.bins))
    return own.bins, n


def test_rounds_pack_as_well_as_best_fit_decreasing():
    rng = random.Random(9)
    for size in (7, 20, 64, 2048):
        for low, high in ((1, size), (1, size // 4 + 1), (size // 3, size // 2 + 2)):
            counts = Counter(rng.randint(max(1, low), high) for _ in range(600))
            bins, n = rounds(counts, size)
            assert bins <= 1.01 * best_fit_decreasing(counts, size) + 1 and n <= 90
    assert rounds(Counter({5: 20_000}), 2048)[0] == 49 and rounds(Counter({2048: 3}), 2048)[0] == 3


def test_rounds_on_spark(spark):
    rng = random.Random(10)
    counts = Counter(rng.randint(1, 300) for _ in range(500))
    rows = packing.flows(spark.createDataFrame(list(counts.items()), "length long, n long"), 300).collect()
    assert max(r.bin + -(-(r.hi - r.lo) // r.each) for r in rows) == rounds(counts, 300)[0]


def test_other_tokenizers_are_refused(tmp_path):
    import json

    rules = json.load(open(packing.default_tokenizer()))
    rules["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    (tmp_path / "t.json").write_text(json.dumps(rules))
    with pytest.raises(ValueError, match="not the ids of the text"):
        packing.PieceEncoder(str(tmp_path / "t.json"))


# --- 7 token counts ---


def test_token_counts(spark, docs):
    scores = token_counts.piece_scores(token_counts.default_vocabulary())
    floor = min(scores.values()) - token_counts.BYTE_PENALTY
    longest = max(map(len, scores))

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[end - 1][0] + floor, -(1 - best[end - 1][1]))]
            for a in range(max(0, end - longest), end):
                if (s := scores.get(word[a:end])) is not None:
                    options.append((best[a][0] + s, best[a][1] - 1))
            best.append(max(options))
        return -best[-1][1]

    memo: dict = {}
    texts = dict(enumerate(TEXTS))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.counted(docs).collect()}
    for i, text in texts.items():
        words = [token_counts.MARK + w.encode() for w in re.findall(WORD, text or "")]
        assert got[i] == (len(words), sum(memo.setdefault(w, None) or memo.__setitem__(w, plain(w)) or memo[w] for w in words))
    assert got[7][0] == 1 and got[7][1] > 1000
    assert token_counts.counted(docs).columns == [c for c in docs.columns if c != "n_tokens"] + ["n_words", "n_tokens"]


# --- 8 near duplicates ---


def shingles(text):
    w = re.findall(WORD, low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_near(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, docs):
    want = plain_near(dict(enumerate(TEXTS)))
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A family of more sets than a block holds."""
    rng = random.Random(5)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 8)
    base = prose(80, rng)
    texts = {i: changed(base, rng.randint(0, 4), rng) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_near(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("block", [4096, 8])
def test_near_duplicates_in_a_crowded_run(spark, monkeypatch, block):
    """Pairs that only one tree brings together, in a run of 40 equal prefixes, are all linked."""
    rng, numbers = random.Random(8), np.random.default_rng(8)
    texts = [t for text in (prose(60, rng) for _ in range(20)) for t in (text, changed(text, 1, rng))]
    of_pair = numbers.integers(0, 1 << 16, (20, 16, 8))
    made = {}
    for i, text in enumerate(texts):
        values = of_pair[i // 2].copy()
        values[0], values[1:, 0] = 7, 1000 * i + np.arange(15)
        made[text] = values.reshape(-1).astype(">u2").tobytes()

    def sketches(batches):
        import pyarrow as pa

        for b in batches:
            own = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([56] * len(own)), pa.array([hashlib.md5(t.encode()).digest() for t in own]), pa.array([made[t] for t in own])], names=["doc_id", "n_shingles", "key", "values"])

    monkeypatch.setattr(near_dedup, "_sketches", sketches)
    monkeypatch.setattr(near_dedup, "RUN_NODES", block, raising=False)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = sum(got[i] == got[i + 1] for i in range(0, 40, 2))
    assert (linked, len(set(got.values()))) == (20, 20)


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "zz yy"), (4, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(None, 4, False), (None, None, True), (4, 4, True), (9, 9, True)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(25)]
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert all(got.get(x, x) == c for x, c in up.items())


# --- 9 exact duplicates ---


@pytest.mark.parametrize("table_bytes", [exact_dedup.TABLE_BYTES, 5000])
def test_exact_duplicates(spark, docs, table_bytes):
    group = defaultdict(list)
    for i, t in [*enumerate(TEXTS), (3, "one"), (5, "a b c")]:
        group[low(t)].append(i)
    rows = exact_dedup.duplicates(docs, table_bytes).collect()
    assert len(rows) == docs.count()
    for r in rows:
        own = group[low(TEXTS[r.doc_id])]
        assert (r.keep_id, r.group_size) == (max(own), len(own))
        assert r.text_sha256 == hashlib.sha256(low(TEXTS[r.doc_id]).encode()).hexdigest()
    assert sum(r.kept for r in rows) == len(group)
    kept = exact_dedup.deduplicate(docs, table_bytes)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in group.values())


def test_table_compares_content():
    t = exact_dedup.ContentTable(2)
    assert [t.add(7, c) for c in (b"a", b"b", b"a", b"c")] == [(0, True), (1, True), (0, False), (2, True)]


# --- 10 top k ---


def plain_top(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, block):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, [1.0] * 6) for i in range(400, 520)]  # ties
    rows += [(600, None), (650, []), (700, [1.0, None]), (750, [float("nan")] * 6), (800, [1.0, float("inf")]), (None, [1.0] * 6), (850, [2.0, 3.0]), (851, [1.0, 1.0]), (900, [5e6, -3e6] * 3)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query string, rank int").repartition(5)
    got = {tuple(r) for r in exact_topk.top_k(df, block=block).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(rows)


def test_top_k_of_nothing(spark):
    assert exact_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
