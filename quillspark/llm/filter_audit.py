"""Filter interaction audit: what five filters remove, alone and in every order, by inclusion-exclusion.

A text fails a filter by its flag: A, few words; B, few distinct words; C, many capitals; D, a sign of
SIGNS; E, a text that a smaller doc_id has too. One aggregation for each part of the documents sums the
products of flags of all 32 sets of filters: how many documents fail all filters of a set J(S), and how
many of these have a good or a toxic label. All else follows from these sums without another look at
the documents:

* what passes all filters of a set P is the sum of (-1)**|S| J(S) over the subsets S of P;
* what a filter removes after P is what passes P less what passes P with the filter;
* what fails a filter only is the sum of (-1)**(|S|-1) J(S) over the sets S that hold it;
* removal is a game whose Harsanyi dividend of S is (-1)**(|S|+1) J(S); a filter's Shapley value is the
  sum of dividends / |S| over the sets that hold it, times 120 for the sum over all orders.

Texts are read once and leave the scan as a digest of 256 bits, four flags and the part. Copies of a
text meet only in a minimum that is taken before the shuffle; which rows are not the first is then an
equi-join on text and doc_id together, so a text that a third of all rows hold is spread over the tasks.

Defined results: a null text is an empty one (it fails A only, and E beside another); a null language
is the part '' together with empty ones; rows without doc_id count, have no labels and never fail E,
nor is any row behind them; a row that repeats counts as often, and rows of one doc_id are not behind
each other; a document is good or toxic if any of its labels says so, null labels say nothing; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, materialize, table, word_count

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, "#$%&*|"
SETS = 1 << len(FILTERS)
#: 120: how many orders there are.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_BEHIND = SETS >> 1


def flags(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words, signs = word_count(text), F.length(text)
    distinct = F.size(F.array_distinct(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")))
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * signs, F.regexp_like(text, F.lit(f"[{SIGNS}]"))]
    return reduce(lambda a, b: a + b, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of all five filters), good, toxic and n, the number of such rows; one row or more for each document and text."""
    text = F.coalesce("text", F.lit(""))
    seen = materialize(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), flags(text).alias("fails")), "audit-flags")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = seen.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    rows = rows.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    mark = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    rows = rows.select("part", (F.col("fails") + F.when(F.col("first"), 0).otherwise(_BEHIND)).alias("fails"), mark("good"), mark("toxic"), "n")
    nameless = seen.where("doc_id IS NULL").groupBy("part", "fails").agg(F.count("*").alias("n"))
    return rows.unionByName(nameless.select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n"))


def joint_counts(rows: DataFrame) -> DataFrame:
    """For each part the arrays `all`, `good` and `toxic`: at place S the rows that fail every filter of the set of bits S."""
    flag = [F.shiftright("fails", i).bitwiseAND(1) for i in range(len(FILTERS))]
    product = lambda s: reduce(lambda a, b: a * b, (flag[i] for i in range(len(FILTERS)) if s >> i & 1), F.col("n"))
    sums = lambda weight, name: F.array(*(F.sum(product(s) * weight) for s in range(SETS))).alias(name)
    return rows.groupBy("part").agg(sums(F.lit(1), "all"), sums(F.col("good"), "good"), sums(F.col("toxic"), "toxic"))


def _signed(counts: Column, which, weight=lambda s: F.lit(1)) -> Column:
    """Sum of (-1)**|S| J(S), each times a weight, over the sets that `which` names."""
    term = lambda s: F.when(F.bit_count(s) % 2 == 0, 1).otherwise(-1) * weight(s) * F.get(counts, s)
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), which), F.lit(0).cast("long"), lambda total, s: total + term(s))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of filters and step. docs has doc_id, text and lang, labels doc_id, quality and toxic."""
    joint = materialize(joint_counts(failures(docs, labels)), "audit-counts")
    # a filter after a set of others: 80 for each part, whatever the number of orders
    pairs = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("nth")) for f in range(len(FILTERS)) for b in range(SETS) if not b >> f & 1))
    at = joint.select("*", F.explode(pairs).alias("at")).select("part", "all", "good", "toxic", "at.before", "at.nth")
    bit = F.expr("shiftleft(1, nth)")
    after = F.col("before").bitwiseOR(bit)
    within = lambda mask: lambda s: s.bitwiseAND(mask) == s
    holds = lambda s: s.bitwiseAND(bit) != 0
    passed = lambda name, mask: _signed(F.col(name), within(mask))
    lost = lambda name: passed(name, F.col("before")) - passed(name, after)
    values = at.select(
        "part", "before", "nth", passed("all", after).alias("kept"), lost("all").alias("removed"), (F.get("all", bit) - lost("all")).alias("redundant"),
        (-_signed(F.col("all"), holds)).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        (-_signed(F.col("all"), holds, lambda s: (F.lit(len(ORDERS)) / F.bit_count(s)).cast("long"))).alias("shapley"),
    )
    steps = [(order, i + 1, sum(1 << FILTERS.index(f) for f in order[:i]), FILTERS.index(order[i])) for order in ORDERS for i in range(len(order))]
    named = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, nth int")
    return values.join(F.broadcast(named), ["before", "nth"]).select("part", "filter_order", "step", *values.columns[3:])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
SQL = {
    "op13_filter_audit": f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[{SIGNS}]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), seen AS (
  SELECT part, filter_order, step, own, contains(fails, own) AS fails_own, translate(fails, before, '') = fails AS here, fails = own AS only_own, good, toxic FROM f, steps
), counted AS (
  SELECT part, filter_order, step, own, count(*) FILTER (here AND NOT fails_own) AS kept, count(*) FILTER (here AND fails_own) AS removed,
    count(*) FILTER (NOT here AND fails_own) AS redundant, count(*) FILTER (only_own) AS unique_fails,
    coalesce(sum(good) FILTER (here AND fails_own), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND fails_own), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted"""
}
