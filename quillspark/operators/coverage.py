"""Which collections that a reader does not have would help with a question.

All matches are equi-joins of word runs, so catalogues and question tables of any size work: names
and aliases against the question's runs of as many words as the longest name has, titles by three significant words in a
row, subjects by tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import packs as P

REASONS = ("names_author", "names_work", "tradition_absent", "covers_subject")
# How a tradition is named in questions; words of names that name nobody.
TRADITION_NAMES = {
    "Baptist": ["baptist", "baptists"],
    "Lutheran": ["lutheran", "lutherans"],
    "Reformed": ["reformed", "presbyterian", "presbyterians", "calvinist", "calvinists", "calvinism"],
    "Anglican": ["anglican", "anglicans", "episcopalian", "episcopalians"],
    "Methodist": ["methodist", "methodists", "wesleyan", "wesleyans"],
    "Catholic": ["catholic", "catholics", "catholicism"],
    "Eastern Orthodox": ["eastern orthodox", "orthodoxy"],
}
#: Words of the longest of these.
ALIAS_WORDS = max(len(a.split()) for names in TRADITION_NAMES.values() for a in names)
COMMON_NAMES = ("john", "gregory", "clement", "the", "of", "saint")


def significant(text: Column) -> Column:
    return F.filter(T.words(text), lambda w: (F.length(w) > 2) & ~w.isin(*T.FILLER))


def runs(text: Column, most: int) -> Column:
    """All runs of one to `most` words of a text."""
    return T.bound(T.words(text), lambda w: F.array_distinct(F.flatten(F.array(*(T.ngrams(w, n) for n in range(1, most + 1))))))


def name_forms(author: Column) -> Column:
    """A name as a whole, and those of its words that are long and not too common."""
    parts = F.filter(F.split(author, r"[\s/]+"), lambda p: (F.length(p) > 3) & ~F.lower(p).isin(*COMMON_NAMES))
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(author), parts), lambda p: F.array_join(T.words(p), " "))), lambda p: F.length(p) >= 4)


def _first(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy("qid", "collection").agg(F.min("value").alias("detail")).withColumn("reason", F.lit(REASONS.index(reason)))


def suggest(questions: DataFrame, contents: DataFrame, members: DataFrame, held: DataFrame, tags: DataFrame, asked_tags: DataFrame) -> DataFrame:
    """qid, place, collection, reason, detail.

    questions: qid, text; contents: fragment, kind (author, title or tradition), value; members:
    collection, fragment; held: fragment; tags: fragment, slug, n; asked_tags: qid, slug.
    """
    missing = P.available(members, held).where("NOT available").select("collection")
    have = contents.join(held.select("fragment"), "fragment", "left_semi").select("kind", "value").distinct()
    of = members.join(missing, "collection").join(contents, "fragment").select("collection", "kind", "value").distinct()
    new = of.join(have, ["kind", "value"], "left_anti")
    forms = new.where("kind = 'author'").select("collection", "value", F.explode(name_forms(F.col("value"))).alias("run"))
    longest = max(forms.agg(F.max(F.size(F.split("run", " ")))).first()[0] or 1, ALIAS_WORDS)
    said = questions.select("qid", F.explode(runs(F.col("text"), longest)).alias("run"))
    authors = forms.join(said, "run")
    thirds = questions.select("qid", F.explode(F.array_distinct(T.ngrams(significant(F.col("text")), 3))).alias("run"))
    works = new.where("kind = 'title'").select("collection", "value", F.explode(F.array_distinct(T.ngrams(significant(F.col("value")), 3))).alias("run")).join(thirds, "run")
    aliases = questions.sparkSession.createDataFrame([(k, a) for k, names in TRADITION_NAMES.items() for a in names], "value string, run string")
    named = said.join(F.broadcast(aliases), "run").select("qid", "value").distinct()
    absent = new.where("kind = 'tradition'").join(named, "value")
    best = P.covers_subject(tags, members, held)
    subject = asked_tags.join(best, "slug").select("qid", "collection", F.replace("slug", F.lit("-"), F.lit(" ")).alias("value"))
    every = _first(authors, REASONS[0])
    for rows, reason in zip((works, absent, subject), REASONS[1:]):
        every = every.unionByName(_first(rows, reason))
    one = every.groupBy("qid", "collection").agg(F.min_by(F.struct("reason", "detail"), "reason").alias("b")).select("qid", "collection", "b.reason", "b.detail")
    sizes = of.groupBy("collection").agg(F.count_if(F.col("kind") == "title").alias("works"), F.count_if(F.col("kind") == "tradition").alias("traditions"))
    by_tradition = F.col("reason") == REASONS.index("tradition_absent")
    order = [F.col("reason"), F.when(by_tradition, F.col("traditions")).otherwise(F.col("works")), F.when(by_tradition, -F.col("works")).otherwise(F.lit(0)), F.col("collection")]
    ranked = one.join(sizes, "collection", "left").fillna(0, ["works", "traditions"])
    once = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "reason", "detail").orderBy(*order))).where("nth = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).select("qid", "place", "collection", F.element_at(F.array(*map(F.lit, REASONS)), F.col("reason") + 1).alias("reason"), "detail")
