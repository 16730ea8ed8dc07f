"""Which works, authors and traditions a question names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENTITY_STOPWORDS

MIN_TOKENS, MIN_SHARE, DISTINCTIVE, MOST_WORKS = 2, 0.6, 2, 6


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9']+"), lambda t: (F.length(t) > 2) & ~t.isin(*ENTITY_STOPWORDS)))


def author_tokens(sources: DataFrame) -> DataFrame:
    """Tokens that name exactly one author."""
    each = sources.where("author IS NOT NULL AND author NOT IN ('Miscellaneous', 'Apocrypha')").select("author").distinct().select("author", F.explode(tokens(F.col("author"))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n"), F.min("author").alias("author")).where("n = 1").drop("n")


def source_tokens(sources: DataFrame) -> DataFrame:
    """token, source, how many tokens title and author have together and how many works have the token."""
    each = sources.select("source", tokens(F.concat_ws(" ", "title", "author")).alias("own")).select("source", F.size("own").alias("total"), F.explode("own").alias("token"))
    return each.join(each.groupBy("token").agg(F.count("*").alias("works")), "token")


def tradition_tokens(traditions: DataFrame) -> DataFrame:
    """token and tradition: words of the name, its last word and that word's plural; of several traditions the last."""
    last = F.element_at(F.split(F.lower("tradition"), " "), -1)
    extra = F.when(last == "orthodoxy", F.array(F.lit("orthodox"))).when(last == "reformed", F.array(F.lit("calvinist"))).when(last == "catholic", F.array(F.lit("roman"))).otherwise(F.array().cast("array<string>"))
    forms = F.array_distinct(F.concat(tokens(F.col("tradition")), F.array(last, F.concat(last, F.lit("s"))), extra))
    return traditions.select("tradition", F.explode(forms).alias("token")).groupBy("token").agg(F.max("tradition").alias("tradition"))


def recognise(questions: DataFrame, sources: DataFrame, traditions: DataFrame) -> DataFrame:
    """qid, kind (tradition, author or work) and label, a row for everything that a question names."""
    asked = questions.select("qid", F.explode(tokens(F.col("text"))).alias("token"))
    by_tradition = asked.join(tradition_tokens(traditions), "token").select("qid", F.lit("tradition").alias("kind"), F.col("tradition").alias("label")).distinct()
    by_author = asked.join(author_tokens(sources), "token").select("qid", F.lit("author").alias("kind"), F.col("author").alias("label")).distinct()
    hits = asked.join(source_tokens(sources), "token").groupBy("qid", "source").agg(F.count("*").alias("hits"), F.max("total").alias("total"), F.min("works").alias("rarest"))
    named = hits.where((F.col("hits") >= MIN_TOKENS) & ((F.col("hits") >= F.col("total")) | (F.col("hits") >= MIN_SHARE * F.col("total")) | (F.col("rarest") <= DISTINCTIVE)))
    works = named.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_WORKS).join(named, "qid").select("qid", F.lit("work").alias("kind"), F.col("source").cast("string").alias("label"))
    return by_tradition.unionByName(by_author).unionByName(works)
