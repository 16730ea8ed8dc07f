"""Pages by running heads, and the survey of landed pages."""

from quillspark.operators import paged, parsers, survey


def test_pages_by_running_head(spark):
    opening = "\n Psalm 119 \n\n\n12\n\nPsalm 119\n\nA preface in place of the usual block.\n"
    pages = ["Title\n1\n", "Psalm 1\n2\n  Indented.\n", "\n3\nGoes on without a head.", opening, "Psalm 119\nno page number here", "", "Psalm 1\n9\nback again"]
    df = spark.createDataFrame([(7, "\f".join(pages)), (8, None), (9, ""), (10, "no head at all\f2\n")], "work int, text string")
    rows = {(r.work, r.page): (r.number, r.printed, r.body) for r in paged.pages_by_head(df).collect()}
    assert rows == {
        (7, 1): (1, 1, "  Indented.\n"),
        (7, 2): (1, None, "Goes on without a head."),
        (7, 3): (119, 119, "Psalm 119\n\nA preface in place of the usual block.\n"),
        (7, 4): (119, 119, "Psalm 119\nno page number here"),
        (7, 5): (119, None, ""),
        (7, 6): (1, 1, "back again"),
    }
    whole = {r.number: (r.pages, r.body) for r in paged.texts_by_head(paged.pages_by_head(df)).collect()}
    assert whole[1] == (3, "  Indented.\n\nGoes on without a head.\nback again") and whole[119][0] == 3


def test_all_psalms_or_the_report_says_so(spark):
    book = "\f".join(f"Psalm {n}\n{2 * n + k}\n" + ("" if n == 119 else f"PSALM {n}\n") + f"Exposition {k}." for n in range(1, 151) for k in range(n % 3 + 1))
    texts = spark.createDataFrame([(1, book), (2, book.replace("Psalm 77\n", "Psalm 76\n"))], "work int, text string")
    found = paged.texts_by_head(paged.pages_by_head(texts))
    checks = {(r.work, r.check): (r.actual, r.ok) for r in parsers.report(found, parsers.FORMS["psalms"], texts).collect()}
    assert all(ok for (work, _), (_, ok) in checks.items() if work == 1) and checks[1, "sections"] == (150, True)
    assert checks[2, "sections"] == (149, False) and not checks[2, "numbers run without a gap"][1]


def test_links_are_resolved_against_their_page(spark):
    page = "http://Lib.example.org/a/b/c.html?q#f"
    cases = {
        "/x/y": "lib.example.org/x/y", "d": "lib.example.org/a/b/d", "../d/": "lib.example.org/a/d/", "../../../../d": "lib.example.org/d", "./": "lib.example.org/a/b/", "https://O.org": "o.org/",
        "//o.org/z?x#y": "o.org/z", "HTTP://o.org/./z": "o.org/z", "#top": None, "?q=1": None, "": None, "mailto:a@b": None, "javascript:void(0)": None, None: None, " /x ": "lib.example.org/x",
    }
    df = spark.createDataFrame([(page, k) for k in cases], "url string, link string")
    assert {r.link: r.to for r in df.select("link", survey.resolved(df.url, df.link).alias("to")).collect()} == cases


def test_survey_goes_on_where_it_ended(spark, tmp_path):
    index = '<a href="/lib/owen/glory">x</a> <a href="https://www.site.org/lib/owen/death/i.html">y</a><a href="/lib/owen/glory#2">z</a><a href="/lib/baxter/rest">other</a><a href="/lib/owen/owen">self</a><a href="/help">h</a>'
    pages = spark.createDataFrame([("owen", "http://www.site.org/lib/owen", index), ("owen", "http://www.site.org/lib/owen/2", '<a href="glory">g</a>'), ("baxter", "http://www.site.org/lib/baxter", None)], "owner string, url string, html string")
    works = survey.works_linked(pages, r"^www\.site\.org/lib/([a-z0-9_]+)/([a-z0-9_]+)")
    assert {(r.owner, r.work, r.pages) for r in works.collect()} == {("owen", "glory", 2), ("owen", "death", 1)}
    (tmp_path / "glory").write_bytes(b"HTTP/1.1 206 Partial Content\r\nContent-Range: bytes 0-1200/4618688\r\n\r\n  Title: Glory \xff\n  Creator(s): Owen, John\n\n   Rights: Public Domain\n  Title: Glory of Christ\n")
    raw = survey.landed(spark, f"file://{tmp_path}/glory").first().text
    rows = [("owen", "glory", raw), ("a", "gone", "HTTP/1.1 404 Not Found\r\nx: y\r\n\r\nTitle: x"), ("a", "none", None), ("a", "held", "HTTP/2 200 OK\nX: y\n\nRights: All reserved\n")]
    probed = spark.createDataFrame(rows, "owner string, work string, raw string")
    assert [r.work for r in survey.pending(works, probed).collect()] == ["death"]
    got = {r.work: r for r in survey.surveyed(probed).collect()}
    assert (got["glory"].state, got["glory"].bytes, got["glory"].title, got["glory"].creators) == ("public", 4618688, "Glory of Christ", "Owen, John")
    assert (got["held"].state, got["held"].bytes, got["gone"].state, got["gone"].title, got["none"].state) == ("withheld", None, "absent", None, "absent")
    assert {(r.state, r.works, r.bytes) for r in survey.totals(survey.surveyed(probed)).collect()} == {("public", 1, 4618688), ("absent", 2, 0), ("withheld", 1, 0)}
