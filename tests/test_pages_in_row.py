"""Running heads are carried within a book's row: against a plain loop, and with no page shuffled or stored."""

import random

from quillspark.operators import paged


def test_heads_are_carried_as_by_a_loop(spark):
    rng = random.Random(17)
    books = {w: [rng.choice([None, None, 1, 7, 99999999999]) for _ in range(w % 13 + 1)] for w in range(120)}
    texts = [(w, "\f".join(f"p{i}\n" if n is None else f" Psalm {n} \n{i}\n\np{i}\n" for i, n in enumerate(pages))) for w, pages in books.items()]
    want = {}
    for w, pages in books.items():
        number = None
        for i, n in enumerate(pages):
            printed = n if n is not None and n < 2**31 else None
            number = printed if printed is not None else number
            if number is not None:
                want[w, i] = number, printed, f"p{i}\n"
    df = spark.createDataFrame([*texts, (None, "\fPsalm 4\n1\nx"), (-1, None), (-2, "")], "work int, text string").repartition(3)
    want[None, 1] = 4, 4, "x"
    assert {(r.work, r.page): (r.number, r.printed, r.body) for r in paged.pages_by_head(df).collect()} == want


def test_no_page_is_shuffled_or_stored(spark):
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    found = paged.pages_by_head(spark.range(1).selectExpr("id AS work", "'Psalm 1\n1\na\fb' AS text"))
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before  # nothing was written to make the plan
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2
