"""What a site holds, from pages and responses that were landed: links to works, what is still to be probed, and what may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

HREF = r"""(?i)\bhref\s*=\s*["']([^"'<>]*)["']"""
# The fields of an export's header that a survey reads.
FIELDS = {"title": "Title", "creators": r"Creator\(s\)", "rights": "Rights", "subjects": "CCEL Subjects"}


def landed(spark: SparkSession, path: str) -> DataFrame:
    """path and text of landed files, whatever bytes they hold: what is no UTF-8 becomes replacement characters."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _normal(path: Column) -> Column:
    """A path without `.` and empty steps, each `..` taking the step before it along; a slash at the end stays."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return T.bound(folded, lambda f: F.concat(F.lit("/"), F.array_join(f, "/"), F.when((F.size(f) > 0) & path.rlike(r"/\.{0,2}\z"), "/").otherwise("")))


def resolved(url: Column, link: Column) -> Column:
    """host/path that a link on a page leads to, without query and fragment, hosts in lower case; null for links that stay on the page or lead to no page (mailto: and the like)."""
    flat = F.trim(link)
    bare = F.regexp_replace(flat, r"[?#].*\z", "")
    host = lambda c: F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)", 1))
    path = lambda c: F.regexp_replace(F.regexp_extract(c, r"^(?:[A-Za-z][\w+.-]*:)?//[^/?#]*([^?#]*)", 1), r"\A\z", "/")
    folder = F.regexp_replace(path(url), r"[^/]*\z", "")
    return (
        F.when(bare == "", F.lit(None))
        .when(flat.rlike("^(?i)(?:https?:)?//"), F.concat(host(bare), _normal(path(bare))))
        .when(flat.rlike(r"^[A-Za-z][\w+.-]*:"), F.lit(None))
        .when(F.startswith(bare, F.lit("/")), F.concat(host(url), _normal(bare)))
        .otherwise(F.concat(host(url), _normal(F.concat(folder, bare))))
    )


def works_linked(pages: DataFrame, pattern: str) -> DataFrame:
    """owner, work and on how many pages it is linked, of pages (owner, url, html).

    pattern: what an address of a work looks like, group 1 its owner, group 2 the work. Pages link to
    other owners' works as well; only their own count, and not the owner's own page. Links are made
    distinct in their page, then counted, so an owner of a third of all pages is as many rows as works.
    """
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: resolved(F.col("url"), x)))
    found = F.array_distinct(F.transform(F.filter(links, lambda x: F.coalesce(x.rlike(pattern), F.lit(False))), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("owner"), F.regexp_extract(x, pattern, 2).alias("work"))))
    rows = pages.select(F.col("owner").alias("of"), F.explode(found).alias("f")).select("of", "f.owner", "f.work")
    return rows.where("owner = of AND work <> owner").groupBy("owner", "work").agg(F.count("*").alias("pages"))


def pending(works: DataFrame, probed: DataFrame) -> DataFrame:
    """Works that no probe has answered for yet; absent ones have been answered for, so a survey goes on where it ended."""
    return works.join(probed.select("owner", "work"), ["owner", "work"], "left_anti")


def answer(raw: Column) -> Column:
    """What a response to a request for a text's first bytes says: exists, bytes (of the whole text, by Content-Range) and the header fields.

    The response has its headers in front, up to a blank line. Any status but 2xx, or no response, means
    that there is no text. A field that occurs twice has its last value.
    """
    parts = F.split(F.coalesce(raw, F.lit("")), r"\r?\n\r?\n", 2)
    head, body = F.element_at(parts, 1), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    exists = head.rlike(r"^HTTP/[\d.]+ 2\d\d\b")
    size = F.regexp_extract(head, r"(?im)^content-range:\s*bytes\s+\S+/(\d+)", 1).try_cast("long")
    field = lambda name: F.try_element_at(F.regexp_extract_all(body, F.lit(rf"(?m)^\s*{name}:\s*(\S.*?)\s*$"), F.lit(1)), F.lit(-1))
    return F.struct(exists.alias("exists"), F.when(exists, size).alias("bytes"), *(F.when(exists, field(name)).alias(key) for key, name in FIELDS.items()))


def surveyed(probed: DataFrame) -> DataFrame:
    """owner, work, state, bytes, title and rights of probed works (owner, work, raw): absent, public (the export says so itself) or withheld."""
    rows = probed.select("owner", "work", answer(F.col("raw")).alias("a"))
    public = F.contains(F.lower(F.coalesce("a.rights", F.lit(""))), F.lit("public domain"))
    state = F.when(~F.col("a.exists"), "absent").when(public, "public").otherwise("withheld")
    return rows.select("owner", "work", state.alias("state"), "a.bytes", "a.title", "a.creators", "a.rights", "a.subjects")


def totals(survey: DataFrame) -> DataFrame:
    """state, works and bytes: what taking all of them would move."""
    return survey.groupBy("state").agg(F.count("*").alias("works"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
