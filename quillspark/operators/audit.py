"""Audits of a corpus: duplicates, generated filler, contents pages, rights."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored
from .joins import with_counts

# What marks generated and scraped text.
TEMPLATE_TITLE = r"(?i)^On the .+ (?:That Is|That the|as the|and the|Who Is|Which Is) "
CHAIN = r"(?i)\b(?:who|that|which) is the\b"
BOILERPLATE_MARKERS = ("new advent", "kevin knight", "nihil obstat", "imprimatur", "contact information", "this page", "transcribed by", "for the sake of the poor souls")
BOILERPLATE_TITLES = ("about this page", "about this page.", "footer", "credits")
TEMPLATE_COUNTS = (7, 9)
CHAINS, REPEATS, REPEAT_MOST_LENGTH = 3, 4, 2500
# What marks a page of contents.
MARKER = r"(?i)\b(?:Chapter|Book|Homily|Letter|Section|Article|Canon|Sermon|Discourse|Tractate|Question|Part|Preface|Prologue)\s+[IVXLC0-9]"
SENTENCE = r"[.!?](?:\s|\z)"
MARKERS_PER_1K, SENTENCES_PER_1K = 3.0, 6.0
PUBLIC_BEFORE = 1929


def copies(units: DataFrame) -> DataFrame:
    """unit_id and how many units have the same text. Texts are read once for their digests; a text that a third of all units share is no task of its own."""
    keyed = stored(units.select("unit_id", F.sha2(F.trim("content"), 256).alias("digest")), "digests")
    return with_counts(keyed, ["digest"], "n").select("unit_id", F.coalesce("n", F.lit(1)).cast("long").alias("copies"))


def most_repeated(text: Column, sizes=(3, 4)) -> Column:
    """How often the most frequent run of so many words occurs, 0 without one; null for null. Runs are counted text by text in Arrow batches, as tuples of words."""
    word = re.compile("[a-z']+")

    def most(text: str | None) -> int | None:
        if text is None:
            return None
        own = word.findall(text)
        return max((max(Counter(zip(*(own[i:] for i in range(n)))).values(), default=0) for n in sizes), default=0)

    @F.pandas_udf("int")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([most(t) for t in texts], dtype="Int32")

    return each(F.lower(text))


def title_tokens(title: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(T.words(title), lambda t: ~t.isin(*T.TITLE_STOPWORDS))))


def verdicts(units: DataFrame) -> DataFrame:
    """unit_id, verdict and reasons. Texts are read once, for flags and digests, which are stored; sibling counts come from these."""
    content, title = F.trim("content"), F.trim("title")
    tokens = title_tokens(F.col("title"))
    flagged = units.select(
        "unit_id", "source", F.sha2(content, 256).alias("digest"),
        F.lower(title).alias("t"), F.array_join(tokens, " ").alias("tokens"),
        (F.size(tokens) > 1).alias("wordy"), (F.size(F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$"))) > 1).alias("worded"),
        F.lower(title).isin(*BOILERPLATE_TITLES).alias("bp_title"),
        F.size(F.filter(F.array(*map(F.lit, BOILERPLATE_MARKERS)), lambda m: F.contains(F.lower(content), m))).alias("markers"),
        F.length(content).alias("n"),
        title.rlike(TEMPLATE_TITLE).alias("templated"),
        (F.regexp_count(content, F.lit(CHAIN)) >= CHAINS).alias("chain"),
        F.when((F.length(content) > 0) & (F.length(content) < REPEAT_MOST_LENGTH), most_repeated(content) >= REPEATS).otherwise(False).alias("repeats"),
    )
    rows = with_counts(stored(flagged, "flags"), ["source"], "n_units", 1)
    rows = with_counts(stored(rows, "flags"), ["source", "t"], "same_title")
    rows = with_counts(stored(rows, "flags"), ["source", "tokens"], "same_tokens", where=F.col("wordy") & F.col("worded"))
    rows = with_counts(stored(rows, "flags"), ["digest"], "copies")
    has = lambda c, reason: F.when(c, reason)
    boilerplate = F.array_compact(F.array(has(F.col("bp_title"), "boilerplate title"), has((F.col("markers") > 0) & ((F.col("n") < 1200) | (F.col("markers") > 1)), "boilerplate markers")))
    strong = F.array_compact(
        F.array(
            has(F.col("templated"), "templated title"),
            has(F.col("chain"), "relative-clause chain"),
            has(F.col("repeats"), "repeated phrase"),
            has(F.col("wordy") & F.col("worded") & F.col("same_tokens").isNotNull(), "shuffled title"),
            has(F.col("same_title").isNotNull(), "duplicate title"),
            has((F.col("n") > 0) & (F.col("copies") > 1), "duplicate content"),
        )
    )
    odd = F.coalesce(F.col("n_units"), F.lit(0)).isin(*TEMPLATE_COUNTS)
    rows = rows.withColumn("bp", boilerplate).withColumn("strong", strong)
    verdict = F.when(F.size("bp") > 0, "boilerplate").when((F.size("strong") >= 2) | ((F.size("strong") == 1) & odd), "summary").when(F.size("strong") == 1, "unknown").otherwise("primary_text")
    reasons = F.when(F.size("bp") > 0, F.col("bp")).otherwise(F.col("strong"))
    return rows.select("unit_id", "source", verdict.alias("verdict"), F.array_join(reasons, "; ").alias("reasons"))


def doomed_sources(judged: DataFrame, share: float = 0.25) -> DataFrame:
    """Works so much of which is no primary text that they go as a whole."""
    return judged.groupBy("source").agg(F.avg((F.col("verdict") != "primary_text").cast("double")).alias("generated")).where(F.col("generated") >= share)


def contents_pages(units: DataFrame) -> DataFrame:
    """Marker and sentence densities of each unit, and whether it looks like a page of contents."""
    m, s = T.density(F.col("content"), MARKER), T.density(F.col("content"), SENTENCE)
    return units.select("unit_id", m.alias("markers"), s.alias("sentences"), ((m >= MARKERS_PER_1K) & (s < SENTENCES_PER_1K)).alias("suspect"))


def rights(statement: Column, print_basis: Column, english_author: Column, death_year: Column) -> Column:
    """Why a work may be used or not: the stated right first, then the edition, the author's language and dates."""
    latest = F.array_max(F.transform(F.regexp_extract_all(print_basis, F.lit(r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b"), F.lit(0)), lambda y: y.cast("int")))
    return (
        F.when(F.contains(F.lower(statement), F.lit("public domain")), "allowed: stated")
        .when(F.coalesce(statement, F.lit("")) != "", "refused: other rights")
        .when(latest >= PUBLIC_BEFORE, "refused: modern edition")
        .when(~english_author, "refused: translation of unknown date")
        .when(death_year.isNull(), "refused: no dates")
        .when(death_year >= PUBLIC_BEFORE, "refused: recent author")
        .otherwise("allowed: old author in English")
    )


def modern_and_bylined(title: Column, date: Column, license: Column) -> Column:
    """A work under copyright, or after 1928, whose title ends in a name of up to three words in brackets."""
    name = F.trim(F.regexp_extract(title, r"\(([^()]*)\)\s*$", 1))
    year = F.left(date, F.lit(4)).try_cast("int")
    modern = license.isin("copyright", "fair use") | F.coalesce(year > 1928, F.lit(False))
    return modern & (name != "") & (F.size(F.split(name, r"\s+")) <= 3) & ~name.rlike("^[0-9]+$")


def bigrams(rows: DataFrame, key: str, text: Column, pattern: str = "[a-z]{2,}") -> DataFrame:
    """key and gram: the distinct word pairs of each text, made distinct within the row before any shuffle."""
    return rows.select(key, F.explode(F.array_distinct(T.ngrams(T.words(text, pattern), 2))).alias("gram"))


#: Ids of witnesses that one set can hold at most, and among how many tasks the rows of one word pair are dealt.
BLOCK, SPLIT = 4096, 8


def witness_sets(witnesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gram and set: which witnesses (witness_id: whole numbers) have a word pair; and set, witness_id.

    Witnesses go in blocks of BLOCK ids, so a pair that all of them have is a row a block, and no set is
    longer than a block. A set is named by the digest of its ids; pairs that the same witnesses have share it.
    """
    grams = bigrams(witnesses, "witness_id", F.col("text"))
    sets = grams.groupBy("gram", F.floor(F.col("witness_id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set("witness_id")).alias("ids"))
    named = stored(sets.select("gram", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("set"), "ids"), "witness-sets")
    return named.select("gram", "set"), named.groupBy("set").agg(F.first("ids").alias("ids")).select("set", F.explode("ids").alias("witness_id"))


def containment(units: DataFrame, witnesses: DataFrame) -> DataFrame:
    """unit_id, witness_id and the share of the witness's word pairs that the unit holds. Pairs without a witness, units without a shared pair and null texts give no rows.

    A unit's pairs meet the sets of witnesses, one row a pair however many witnesses have it, and are
    counted by set; only then a set becomes its witnesses, and counts add up. A pair that all units have
    is dealt among SPLIT tasks by unit, as is a set. Spark broadcasts the witnesses' side while it finds it small.
    """
    grams, members = witness_sets(witnesses)
    size = grams.join(members, "set").groupBy("witness_id").agg(F.count("*").alias("size"))
    dealt = F.explode(F.array(*map(F.lit, range(SPLIT)))).alias("deal")
    own = bigrams(units, "unit_id", F.col("content")).withColumn("deal", F.pmod(F.hash("unit_id"), F.lit(SPLIT)))
    by_set = own.join(grams.select("*", dealt), ["gram", "deal"]).groupBy("unit_id", "deal", "set").agg(F.count("*").alias("n"))
    shared = by_set.join(members.select("*", dealt), ["set", "deal"]).groupBy("unit_id", "witness_id").agg(F.sum("n").alias("shared"))
    return shared.join(size, "witness_id").select("unit_id", "witness_id", "shared", (F.col("shared") / F.col("size")).alias("containment"))


def best_witness(scores: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("witness_id", "containment"), F.struct("containment", -F.col("witness_id")))
    return scores.groupBy("unit_id").agg(best.alias("b")).select("unit_id", "b.witness_id", "b.containment")


def gate(best: DataFrame, group: str, floor: float, median: float) -> DataFrame:
    """Whether the median of a group's best scores and each of them reach their thresholds."""
    return best.groupBy(group).agg(F.count("*").alias("n"), F.percentile("containment", 0.5).alias("median"), F.min("containment").alias("worst")).withColumn("ok", (F.col("median") >= median) & (F.col("worst") >= floor))


def union_coverage(units: DataFrame, witnesses: DataFrame) -> DataFrame:
    """For each unit the share of its word pairs that any witness has."""
    own = bigrams(units, "unit_id", F.col("content"))
    known = bigrams(witnesses, "witness_id", F.col("text")).select("gram").distinct().withColumn("known", F.lit(1))
    return own.join(known, "gram", "left").groupBy("unit_id").agg(F.count("*").alias("pairs"), F.count("known").alias("known"))


def contents_works(units: DataFrame) -> DataFrame:
    """source, densities over a work's units as if they were one text joined by blanks, and whether the work looks like a page of
    contents. Counts of units add up, so no work's text is gathered; a mark that only joining would make does not count."""
    count = lambda pattern: F.sum(F.regexp_count("content", F.lit(pattern)).cast("long"))
    each = units.groupBy("source").agg(count(MARKER).alias("m"), count(SENTENCE).alias("s"), (F.sum(F.length("content").cast("long")) + F.count("*") - 1).alias("n"))
    per_1k = lambda c: F.when(F.col("n") > 0, F.col(c) * 1000.0 / F.col("n")).otherwise(0.0)
    rows = each.select("source", per_1k("m").alias("markers"), per_1k("s").alias("sentences"))
    return rows.withColumn("suspect", (F.col("markers") >= MARKERS_PER_1K) & (F.col("sentences") < SENTENCES_PER_1K))


def unexpanded(hubs: DataFrame, units: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """source, parts, units and state of works (source, parts) of whose parts too few came in: withheld on purpose (withdrawn:
    source), absent, or short, which is fewer units than half the parts, and than two."""
    held = units.groupBy("source").agg(F.count("*").alias("units"))
    rows = hubs.join(held, "source", "left").join(withdrawn.select("source", F.lit(True).alias("gone")).distinct(), "source", "left")
    short = (F.col("parts") >= 2) & (F.col("units") < F.greatest(F.lit(2.0), F.col("parts") / 2))
    state = F.when(F.col("gone"), "withheld").when(F.col("units").isNull(), "absent").when(short, "short")
    return rows.select("source", "parts", F.coalesce("units", F.lit(0)).cast("long").alias("units"), state.alias("state")).where("state IS NOT NULL")


# What units must share with their witnesses, by kind of collection, and what a foreign text must not reach.
CORROBORATION = {
    "catechism": {"floor": 0.55, "median": 0.80},
    "edition": {"floor": 0.75, "union": 0.90},
    "commentary": {"floor": 0.70, "median": 0.85},
    "paragraphs": {"floor": 0.95},
    "confession": {"floor": 0.80},
    "articles": {"floor": 0.70, "median": 0.88},
}
CONTROL = {"edition": 0.60, "commentary": 0.55}


def corroborated(scores: DataFrame, group: str, kind: str) -> DataFrame:
    """For each group whether its units (containment in the best witness, and `whole` in all of them) pass the gate of their kind.

    A unit passes by its best witness or, where the kind allows it, by all witnesses together. Scores
    are rounded to six digits, so the table of an exact median stays small however many units a group has.
    """
    rule = CORROBORATION[kind]
    best = F.round("containment", 6)
    ok = best >= rule["floor"]
    if "union" in rule:
        ok = ok | (F.col("whole") >= rule["union"])
    each = scores.groupBy(group).agg(F.count("*").alias("n"), F.count_if(~ok).alias("failing"), F.percentile(best, 0.5).alias("median"))
    return each.withColumn("ok", (F.col("failing") == 0) & (F.col("median") >= rule.get("median", 0.0)))


def control_holds(scores: DataFrame, kind: str) -> DataFrame:
    """One row: the highest containment of texts that must not pass, and whether it stays below what the kind allows. No such text is no control."""
    return scores.agg(F.max("containment").alias("highest")).select("highest", F.coalesce(F.col("highest") < CONTROL[kind], F.lit(False)).alias("ok"))


def vocabulary_share(units: DataFrame, witness: DataFrame, least: int = 2) -> DataFrame:
    """unit_id, its distinct words of `least` letters or more and how many of them the witness texts (text) use; words are made distinct in the row, then the witness's once."""
    known = witness.select(F.explode(F.array_distinct(T.stream_words(F.col("text"), least))).alias("word")).distinct().withColumn("known", F.lit(1))
    own = units.select("unit_id", F.explode(F.array_distinct(T.stream_words(F.col("content"), least))).alias("word"))
    return own.join(known, "word", "left").groupBy("unit_id").agg(F.count("*").alias("words"), F.count("known").alias("known"))
