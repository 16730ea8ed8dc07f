"""Articles with endnotes: proofs in their places, pages that are refused."""

from quillspark.operators import endnotes as N

MARKED = {1: [1, 2], 2: [3], 3: [], 4: [4, 6, 5]}
NOTES = {n: f"Proof {n}; 1 Tim. {n}:16" for n in range(1, 7)}


def page(marked=MARKED, notes=NOTES, numerals="I II III IV".split(), split=False):
    p = lambda x: f'<p class="main_body">{x}</p>\n'
    out = "<p>other</p>" + p("The <b>preface</b>")
    for (n, own), numeral in zip(marked.items(), numerals):
        body = f"Article <i>{n}</i> " + " ".join(f'word{m}<a href="#x">{m}</a>' for m in own) + " see 1 Tim. 6:16"
        out += p(f"{numeral}." if n % 2 else f"{numeral} [sic]") + p(body) + (p("and more") if n == 2 else "")
    return out + p("NOTES: " + " ".join(f'<a name="y">[{n}]</a> {t}' for n, t in notes.items()))


def run(spark, *pages):
    paragraphs = N.page_paragraphs(spark.createDataFrame([(f"w{i}", x) for i, x in enumerate(pages)], "work string, html string"))
    works = spark.createDataFrame([(f"w{i}",) for i in range(len(pages))], "work string")
    found = {(r.work, r.nth): (r.printed, r.text, r.proofs) for r in N.articles(paragraphs).collect()}
    failing = {}
    for r in N.report(paragraphs, works, 4, 6, {4: "IV"}, 10).where("NOT ok").collect():
        failing.setdefault(r.work, {})[r.check] = (r.expected, r.actual, r.odd)
    return found, failing


def test_proofs_are_placed(spark):
    found, failing = run(spark, page())
    assert failing == {}
    assert found["w0", 1] == ("I", "Article 1 word1 word2 see 1 Tim. 6:16", f"{NOTES[1]}; {NOTES[2]}")
    assert found["w0", 2][1].endswith("6:16 and more") and found["w0", 3][2] == ""
    assert found["w0", 4][2] == "; ".join(NOTES[n] for n in (4, 6, 5))


def test_what_is_refused(spark):
    _, failing = run(
        spark, page(numerals=["IX"] * 4), page(notes={n: t for n, t in NOTES.items() if n != 3}), page(MARKED | {3: [3]}), page(MARKED | {4: [4, 5]}), "<p>nothing</p>", None, page({1: [1, 2], 2: [3]}),
    )
    assert failing["w0"] == {"numerals in sequence": (0, 4, "1, 2, 3, 4")}
    assert failing["w1"] == {"notes": (6, 5, ""), "every mark has a note": (0, 1, "3")}
    assert failing["w2"] == {"no number twice": (0, 1, "3")}
    assert failing["w3"] == {"every note has a mark": (0, 1, "6")}
    assert failing["w4"]["articles"] == failing["w5"]["articles"] == (4, 0, "") and len(failing["w4"]) == len(failing["w5"]) == 7
    assert failing["w6"] == {"articles": (4, 2, ""), "every note has a mark": (0, 3, "4, 5, 6")}


def test_fifty_three_articles_headed_ix(spark):
    numerals = [N.MISPRINTS.get(i, r) for i, r in enumerate([a + b for a in ("", "X", "XX", "XXX", "XL", "L") for b in ("", *"I II III IV V VI VII VIII IX".split())][1:54], 1)]
    marked = {i: [i, *([53 + i] if i < 97 else [])] for i in range(1, 54)} | {53: [53, *range(106, 150)]}
    notes = {n: f"Proof {n}" for n in range(1, 150)}
    def failing(numerals):
        paragraphs = N.page_paragraphs(spark.createDataFrame([("w", page(marked, notes, numerals))], "work string, html string"))
        return {r.check for r in N.report(paragraphs, spark.createDataFrame([("w",)], "work string"), least=10).where("NOT ok").collect()}
    assert failing(numerals) == set() and failing(["IX"] * 53) == {"numerals in sequence"}
