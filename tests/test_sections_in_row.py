"""Which anchors begin a section is found within a text's row: against a plain loop, and without a stored or shuffled piece."""

import random

from quillspark.operators import parsers as R


def loop(numbers, form):
    """Places of the pieces that begin a section: rising, then the first of each number."""
    own, high = list(range(len(numbers))), None
    if form.rising:
        own = []
        for i, n in enumerate(numbers):
            if n is not None and n > (high or 0):
                own.append(i)
            high = n if high is None else max(high, n or 0)
    if form.first:
        seen = set()
        own = [i for i in own if numbers[i] is not None and 1 <= numbers[i] <= form.sections and not (numbers[i] in seen or seen.add(numbers[i]))]
    return own


def test_sections_are_picked_as_by_a_loop(spark):
    rng = random.Random(9)
    works = {w: [rng.choice([0, 1, 2, 3, 5, 8, 40, 99999999999]) if w % 4 else w for _ in range(w % 23)] for w in range(200)}
    texts = {w: f"preface {w}\n" + "".join(f"{n}. text {i} of {w}\n" for i, n in enumerate(own)) for w, own in works.items()}
    df = spark.createDataFrame([*texts.items(), (-1, None), (-2, ""), (None, "3. a\n2. b\n4. c")], "work int, text string").repartition(3)
    for form in (R.Form(r"^(\d+)\.", rising=True), R.Form(r"^(\d+)\.", first=True, sections=8), R.Form(r"^(\d+)\.", rising=True, first=True, sections=8)):
        got = {(r.work, r.nth): (r.number, r.printed, r.body) for r in R.sections(df, form).collect()}
        want = {(None, 1): (3, "3", "a\n2. b"), (None, 2): (4, "4", "c")} if form.rising else {(None, k + 1): x for k, x in enumerate([(3, "3", "a"), (2, "2", "b"), (4, "4", "c")])}
        for w, own in works.items():
            begin = loop([n if n < 2**31 else None for n in own], form)
            for k, i in enumerate(begin):
                last = begin[k + 1] if k + 1 < len(begin) else len(own)
                want[w, k + 1] = own[i], str(own[i]), "".join(f"{'' if j == i else f'{own[j]}.'} text {j} of {w}\n" for j in range(i, last)).strip()
        assert got == want


def test_nothing_is_shuffled_or_stored_for_them(spark, monkeypatch):
    from quillspark.operators import scans

    monkeypatch.setattr(scans, "stored", lambda *_: 1 / 0)
    df = spark.createDataFrame([(1, "1. a\n2. b\n1. c")], "work int, text string").coalesce(1)
    found = R.sections(df, R.FORMS["numbered_catechism"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2
