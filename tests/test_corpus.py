"""Ingest, packs, scope, snapshots and text functions on small fixtures."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, encoder
from quillspark.functions import text as T
from quillspark.functions.entities import unescaped
from quillspark.functions.wordpiece import encode
from quillspark.operators import audit, excerpts, ingest, library, packs, scope, state, tagging
from quillspark.operators.lexical import match_expression, query_terms
from quillspark.sources import snapshots


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_query_terms():
    assert match_expression("What did the Synod of Dort decree?") == "synod* OR dort* OR decree*"
    assert query_terms("what are these about") == ["what", "are", "these", "about"]
    assert query_terms("") == [] == query_terms("a of")


def test_text_functions(spark):
    assert one(spark, T.roman_to_int, "MCMXCIV") == 1994 and one(spark, T.roman_to_int, "abc") is None
    assert one(spark, T.int_to_roman, 1994, "int") == "MCMXCIV"
    assert one(spark, lambda c: T.slug(c), " Ünder the Hood! ") == "nder-the-hood" and one(spark, T.slug, "¡!") == "source"
    assert one(spark, lambda c: T.truncated(c, 10, "…"), "hello worldly") == "hello worl…"
    assert one(spark, lambda c: T.truncated(c, 12, "…"), "hello dear friends") == "hello dear…"
    assert one(spark, T.display_matter, "BY THE REV. JOHN") and not one(spark, T.display_matter, "plain prose here")
    assert one(spark, T.strip_tags, "<p>a&amp;b <script>x</script><b>c</b></p>") == "a&b c"
    assert one(spark, dates.years, "c. 280-367") == [280, 367]
    assert one(spark, dates.version_key, "2026.07.x") is None and one(spark, dates.version_key, "") is None
    assert tuple(one(spark, dates.version_key, "v2026.7.1+12")) == ([2026, 7, 1], 12) and tuple(one(spark, dates.version_key, "2026.7.0.0.5")) == ([2026, 7, 0, 0, 5], 0)
    assert one(spark, dates.version_key, "2026.8") == one(spark, dates.version_key, "2026.8.0")
    assert one(spark, lambda c: dates.version_key(c) > dates.version_key(F.lit("2026.7.1+3")), "2026.7.1+12")
    assert tuple(one(spark, dates.year_range, "c. 280–367")) == (280, 367) and one(spark, dates.year_range, "n.d.") is None
    assert str(one(spark, dates.from_iso, "2026-07-01T10:20:30.500")) == "2026-07-01 10:20:30.500000" and one(spark, dates.from_iso, "soon") is None
    assert one(spark, lambda c: dates.iso(dates.from_iso(c)), "2026-07-01T10:20:30") == "2026-07-01T10:20:30.000"
    assert [one(spark, T.part_noun, t) for t in ("Three Orations", "Lectures", "On Treatises and things", "Conferences of Cassian", "Hymns")] == ["Oration", "Lecture", "Treatise", "Conference", "Part"]
    f = one(spark, T.provenance_footer, "Translated by S.D.F. Salmond. From Nicene and Post-Nicene Fathers, Second Series, Vol. 9. Edited by Philip Schaff. (Buffalo, NY, 1899.)")
    assert tuple(f) == ("S.D.F. Salmond", "Nicene and Post-Nicene Fathers, Second Series, Vol. 9", 1899)


def test_slugs_and_ids(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, "c")], "id int, title string")
    assert [r.slug for r in library.slugs(df, "id", F.col("title")).orderBy("id").collect()] == ["a-b", "a-b-2", "c"]
    rng = np.random.default_rng(2)
    for n in range(4):
        titles = [["a", "A", "a-2", "a"], ["a-2", "a", "a", "a", "a 3", "a-2"], ["a", "a", "a-3", "a", "a-2", "a 2 2", "a"], [str(t) for t in rng.choice(["x", "x 2", "x-3", "x 2 2", "x 3"], 40)]][n]
        taken, want = set(), []
        for t in titles:
            base = t.lower().replace(" ", "-")
            want.append(next(s for s in (base if k == 1 else f"{base}-{k}" for k in range(1, 99)) if s not in taken))
            taken.add(want[-1])
        df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
        assert [r.slug for r in library.slugs(df, "id", F.col("title")).orderBy("id").collect()] == want


def test_notes(spark):
    n = one(spark, library.parse_notes, "Translated by A.B. | Ante-Nicene Fathers , Vol. 1 | Public-domain translation, 1885 | From a scan | Ingested from x.org")
    assert tuple(n) == ("A.B.", "Ante-Nicene Fathers, Vol. 1", "Public-domain translation, 1885", "x.org", None, ["From a scan"])
    n = one(spark, library.parse_notes, "Public-domain translation, 1885 | Rights: Mine | odd")
    assert (n.rights, n.extra) == ("Mine", ["odd"]) and one(spark, library.parse_notes, None).extra == []


def test_citations_as_json(spark):
    c = one(spark, lambda x: library.citation_of(library.citation_json(F.lit(7), x, F.lit(None).cast("string"), F.lit("t"), F.lit(None).cast("string"))), 'a "quoted" title')
    assert (c.contentId, c.source, c.author, c.tradition, c.sourceUrl) == (7, 'a "quoted" title', None, "t", None)
    assert one(spark, library.citation_of, "{broken").contentId is None


def test_markup(spark):
    assert one(spark, ingest.envelope, "x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny") == "body"
    assert one(spark, ingest.envelope, "no marks") is None
    assert one(spark, ingest.rule_separated, "a\n" + "_" * 24 + "\nb\n" + "_" * 20 + "\n ") == ["a", "b"]
    assert one(spark, ingest.clean_wikitext, "'''A''' [[b|c]] {{t|{{u}}}} d<ref>n</ref> [[e]]") == "A c d e"
    assert one(spark, ingest.clean_scan, "some-\nthing  is\nTHE RUNNING HEAD 12\nhere") == "something is\nhere"
    assert one(spark, ingest.pages, "a\fb") == ["a", "b"]
    got = one(spark, ingest.header_fields, "Title: A Book\n  of Things\nRights: Public Domain\n\nBody: no")
    assert got == {"Title": "A Book of Things", "Rights": "Public Domain"}
    assert one(spark, lambda c: unescaped(c), "a &amp; &eacute;") == "a & é"
    credits = lambda t: tuple(one(spark, ingest.credits, t))
    assert credits("Calvin, John (1509-1564) (Alternative) (Translator)") == ("John Calvin", None, 1509, 1564)
    assert credits("Calvin, John (1509-1564) Beveridge, Henry (Translator)") == ("John Calvin", "Henry Beveridge", 1509, 1564)
    assert credits("Henry, Matthew") == ("Matthew Henry", None, None, None) and credits("")[:2] == (None, None)
    assert one(spark, ingest.clean_plain, "a_b_c _so_ =it= is[12]\n-----\nx  y") == "a_b_c so it is\n\nx y"


def test_usfm(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("gen.usfm", r"\id GEN \c 1 \p \v 1 In the \w beginning|strong='H1'\w*\f + note\f* God \v 2 And \c 2 \v 1 Thus")
    files = spark.createDataFrame([("p.zip", bytearray(z.getvalue()))], "path string, content binary")
    books = ingest.zipped_texts(files).select(F.col("name").alias("book"), "text")
    got = [(r.chapter, r.verse, r.text) for r in ingest.usfm_verses(books).orderBy("chapter", "verse").collect()]
    assert got == [(1, 1, "In the beginning God"), (1, 2, "And"), (2, 1, "Thus")]


def test_anchors_and_gates(spark):
    df = spark.createDataFrame([(1, "ART. 1 a\nART. 2 bb\nART. 4 c"), (2, None)], "unit_id long, content string")
    got = ingest.segment_by_anchor(df, r"^ART\. (\d+)")
    assert [(r.anchor, r.start, r.end) for r in got.orderBy("nth").collect()] == [("1", 0, 9), ("2", 9, 19), ("4", 19, 27)]
    sections = got.select(F.col("unit_id").alias("work"), F.col("anchor").cast("int").alias("number"))
    g = ingest.gates(sections, spark.createDataFrame([(1, 3), (2, 1)], "work long, n int")).orderBy("work").collect()
    assert [(r.actual, r.complete, r.contiguous) for r in g] == [(3, True, False), (0, False, False)]


def test_hard_splits_against_a_plain_loop():
    def plain(text, limit):
        out = []
        while len(text) > limit:
            head = text[:limit]
            at = max(head.rfind(m) for m in (". ", "? ", "! "))
            at = at if at >= limit // 2 else head.rfind(" ")
            end = at + 1 if at >= limit // 2 else limit
            out.append(text[:end].strip())
            text = text[end:].lstrip()
        return [p for p in [*out, text.strip()] if p]

    rng = np.random.default_rng(3)
    for limit in (7, 20, 41):
        for _ in range(200):
            text = "".join(rng.choice(list("abc  .?!"), 150))
            assert [p for a, b in ingest.cuts(text, limit) if (p := text[a:b].strip())] == plain(text, limit)


def test_hard_split_loses_nothing(spark):
    text = "One. Two three four five six. Seven eight nine ten eleven twelve! " * 20
    df = spark.createDataFrame([(1, text), (2, "x" * 95), (3, "")], "unit_id long, content string")
    got = ingest.hard_split(df, 40).toPandas()
    assert "".join(got[got.unit_id == 1].text).replace(" ", "") == text.replace(" ", "")
    assert got.text.str.len().max() <= 40 and (got.unit_id == 3).sum() == 0


def test_corroboration_has_a_negative_control(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"])
    truth = " ".join(rng.choice(words, 300))
    shuffled = " ".join(rng.permutation(truth.split()))
    other = " ".join(rng.choice([w.upper().lower() + "x" for w in words], 300))
    units = spark.createDataFrame([(1, "noise " + truth + " noise"), (2, shuffled), (3, other)], "unit_id long, content string")
    got = {r.unit_id: r.containment for r in audit.containment(units, spark.createDataFrame([(7, truth)], "witness_id long, text string")).collect()}
    assert got[1] == 1.0 and got.get(2, 0) < 0.4 and got.get(3, 0) < 0.1


def test_verdicts(spark):
    rows = [(1, "s", "On the Creed That Is the Nicene", "x y z w"), (2, "s", "On the Nicene That the Creed", "who is the who is the which is the same"), (3, "t", "Credits", "hello"), (4, "t", "Real", "a plain text"), (5, "u", "Homily 12", "one"), (6, "u", "Homily 13", "two")]
    got = {r.unit_id: (r.verdict, r.reasons) for r in audit.verdicts(spark.createDataFrame(rows, "unit_id long, source string, title string, content string")).collect()}
    assert got[1][0] == "summary" and "shuffled title" in got[1][1] and got[2][0] == "summary"
    assert got[3] == ("boilerplate", "boilerplate title") and got[4][0] == got[5][0] == got[6][0] == "primary_text"


def test_scope(spark):
    works = spark.createDataFrame([(1, "The Canons and Decrees of the Synod of Dort", "Anonymous Writers"), (2, "On the Trinity", "Augustine of Hippo"), (3, "On Virgins", "Ambrose")], "source int, title string, author string")
    traditions = spark.createDataFrame([("Lutheran",), ("Eastern Orthodoxy",), ("Reformed",)], "tradition string")
    asked = spark.createDataFrame([(1, "What did the Synod of Dort decree?"), (2, "what do Lutherans and a Calvinist say"), (3, "was Augustine right"), (4, "the virgin birth"), (5, "")], "qid int, text string")
    got = {(r.qid, r.kind, r.label) for r in scope.recognise(asked, works, traditions).collect()}
    assert got == {(1, "work", "1"), (2, "tradition", "Lutheran"), (2, "tradition", "Reformed"), (3, "author", "Augustine of Hippo")}


def test_tags(spark):
    assert one(spark, tagging.question_tags, "Hello sincere evangelical") == []
    assert one(spark, tagging.question_tags, "SINS and the Lord's Supper") == ["eucharist", "sacraments", "sin"]
    assert {t for v in tagging.QUESTION_PHRASES.values() for t in v} == set(tagging.UNIT_KEYWORDS.values())


def test_packs(spark):
    members = spark.createDataFrame([("one", "a"), ("both", "a"), ("both", "b"), ("odd", "zz")], "collection string, fragment string")
    sizes = spark.createDataFrame([("a", 4194304), ("b", 6291456)], "fragment string, bytes long")
    held = lambda *f: spark.createDataFrame([(x,) for x in f], "fragment string")
    cost = lambda *f: {r.collection: r.bytes for r in packs.bytes_to_install(members, sizes, held(*f)).collect()}
    assert cost() == {"one": 4194304, "both": 10485760, "odd": 0}
    assert cost("a")["both"] == 6291456 and cost("a", "b")["both"] == 0
    assert [r.fragment for r in packs.uninstall_plan(members, F.col("collection") == "both").collect()] == ["b"]


def test_id_space(spark):
    schema = "source string, min long, max long, count long, hash string"
    before = spark.createDataFrame([("same", 1, 5, 5, "h"), ("moved", 6, 9, 4, "m"), ("text", 10, 12, 3, "t")], schema)
    now = spark.createDataFrame([("same", 1, 5, 5, "h"), ("moved", 5, 8, 4, "m"), ("text", 10, 12, 3, "other"), ("new", 13, 20, 8, "n"), ("sneaky", 3, 4, 2, "s")], schema)
    assert {(r.source, r.fault) for r in packs.id_faults(before, now).collect()} == {("moved", "moved"), ("text", "rewritten"), ("sneaky", "occupied")}
    assert packs.id_faults(before, before).count() == 0


def test_highlights(spark):
    schema = "id long, unit_id long, start int, end int"
    held = spark.createDataFrame([(1, 1, 0, 5), (2, 1, 5, 9), (3, 2, 0, 5)], schema)
    got = state.written(held, spark.createDataFrame([(9, 1, 4, 5)], schema))
    assert sorted(r.id for r in got.collect()) == [2, 3, 9]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert snapshots.current(spark, root) == 0 and snapshots.publish(spark, root, {"t": df}, 1, "m", dry_run=True) == 1
    snapshots.publish(spark, root, {"t": df}, 1, "m", {"t": "x"})
    new = snapshots.merged(snapshots.read(spark, root, "t"), spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), ["id"])
    assert snapshots.publish(spark, root, {"t": new}, 1, "m") == 2
    assert sorted((r.id, r.x) for r in snapshots.read(spark, root, "t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert snapshots.read(spark, root, "t", 1).count() == 2
    assert snapshots.collisions(df, new, ["id"]).count() == 2
    kept = snapshots.merged(df, new, ["id"], keep_old=True)
    assert sorted((r.id, r.x) for r in kept.collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_manifest(spark, tmp_path):
    good = {"corpusVersion": 15, "embeddingModel": "m", "fragments": [{"id": "a", "file": "a.gz", "bytes": 5, "sha256": "0" * 64, "sources": 1, "units": 2, "chunks": 3}], "collections": [{"id": "c", "kind": "k", "name": "n", "description": "d", "fragments": ["a", "b"]}]}
    (tmp_path / "m.json").write_text(json.dumps(good))
    m = snapshots.manifest(spark, f"file://{tmp_path}/m.json")
    assert m["fragments"].first().idSpace == 1 and m["members"].count() == 2
    (tmp_path / "bad.json").write_text('{"fragments": 3')
    with pytest.raises(Exception):
        snapshots.manifest(spark, f"file://{tmp_path}/bad.json")["fragments"].collect()


def test_excerpts(spark):
    long = "word " * 200
    works = {"titled": ["THE TITLE OF IT", "[Addr-1] This opening sentence is long enough to be quoted, surely, as it has over eighty letters."], "bare": ["BY JOHN"], "long": [long],
             "verse": ["one short line of it\n\nand one more line here\n\n" * 12], "sentence": ["This is a sentence of prose. " * 20]}
    rows = [(source, i, i, c) for source, own in works.items() for i, c in enumerate(own)]
    got = {r.source: r.excerpt for r in excerpts.excerpts(spark.createDataFrame(rows, "source string, unit_id long, sequence long, content string")).collect()}
    assert got["titled"].startswith("This opening") and got["bare"] == ""
    assert got["long"].endswith("word…") and len(got["long"]) <= 401 and got["verse"].startswith("one short line of it and one")
    assert got["sentence"].endswith("prose.") and 241 < len(got["sentence"]) <= 400


def test_chunk_ids_are_unique(spark):
    from quillspark.operators import chunks

    df = spark.createDataFrame([(4, "word " * 400_000), (5, "short"), (6, None)], "unit_id long, content string")
    got = chunks.chunk(df).toPandas()
    assert got.chunk_id.is_unique and got.chunk_id.notna().all() and (got.unit_id == 4).sum() > 1000


def test_packed_parts(spark):
    from quillspark.operators import chunks

    rng = np.random.default_rng(5)
    rows = [(g, i, int(x)) for g in "ab" for i, x in enumerate(rng.integers(1, 60, 80))]
    got = {(r.g, r.i): r.part for r in chunks.packed(spark.createDataFrame(rows, "g string, i int, n int"), "g", ["i"], "n", 100).collect()}
    for g in "ab":
        part = size = 0
        for own, i, n in rows:
            if own == g:
                assert got[g, i] == part
                size += n
                if size >= 100:
                    part, size = part + 1, 0


def test_wordpiece_and_pooling():
    v = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", "!"])}
    assert encode("Unaffable café! zz", v) == [1, 3, 4, 5, 6, 7, 0, 2]
    assert encode("x" * 101, v) == [1, 0, 2] and len(encode("un " * 400, v)) == 256
    p = encoder.pooled(np.ones((2, 3, 4)), np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(np.linalg.norm(p[0]), 1) and np.allclose(p[1], 0)
