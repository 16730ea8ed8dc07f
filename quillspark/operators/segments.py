"""The pieces of a text that a reader can select, with their places.

A text is cut, never copied: cut positions divide it into stretches that cover it, each stretch is
narrowed to its ink (what is left without blanks at its ends), and a stretch without ink is no piece.
Blank lines, line ends and gaps between sentences so need no rule of their own: they are the blank
ends of stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame

SPLIT_OVER, LEAST_VERSES = 700, 2
# What begins a verse, what divides paragraphs, what stands between sentences.
VERSE = re.compile(r"^[ \t]*([0-9]{1,3})\.[ \t]+", re.M)
BLANK_LINE, LINE = re.compile(r"\n[ \t]*\n+"), re.compile(r"\n+")
SENTENCE_GAP = re.compile(r"(?:(?<=[.!?])|(?<=[.!?][\")\]]))\s+(?=[A-Z\"“(\[])")
INK = re.compile(r"\S(?:.*\S)?", re.S)


def _ink(text: str, cuts: list[int]) -> Iterator[tuple[int, int]]:
    """Start and end of what each stretch between two cuts holds."""
    for a, b in pairwise(cuts):
        if found := INK.search(text, a, b):
            yield found.span()


def _verses(text: str) -> list[tuple[str, int, int, int | None]]:
    """Verses and what stands before the first. A verse begins with its number, but a number without words is none."""
    marks = {m.start(): m for m in VERSE.finditer(text)}
    if len(marks) < LEAST_VERSES:
        return []
    words = {a: (marks[a].end(), int(marks[a][1])) if a in marks else (a, None) for a in {0, *marks}}
    out = []
    for a, b in pairwise([*sorted(words), len(text)]):
        at, number = words[a]
        if found := INK.search(text, at, b):
            out.append(("verse", a, found.end(), number))
    return out


def _paragraphs(text: str) -> list[list[int]]:
    """Cuts of each paragraph: its own bounds, and those between its sentences if it is long."""
    divider = BLANK_LINE if sum(map(bool, BLANK_LINE.split(text))) > 1 else LINE
    bounds = sorted({0, *(m.end() for m in divider.finditer(text)), len(text)})
    return [[a, *(m.end() for m in SENTENCE_GAP.finditer(text, a, b)), b] if b - a > SPLIT_OVER else [a, b] for a, b in _ink(text, bounds)]


def segments(text: str) -> list[tuple[str, int, int, int | None]]:
    """(kind, start, end, verse number) of each piece: verses if two or more are numbered, else paragraphs, those of more than SPLIT_OVER characters by sentences."""
    if found := _verses(text):
        return found
    cuts = _paragraphs(text)
    kind = "sentence" if any(c[-1] - c[0] > SPLIT_OVER for c in cuts) else "paragraph"
    return [(kind, a, b, None) for c in cuts for a, b in _ink(text, c)]


def _segmented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(unit, i, *s) for unit, text in zip(pdf["unit_id"], pdf["content"]) for i, s in enumerate(segments(text or ""))]
        out = pd.DataFrame(rows, columns=["unit_id", "idx", "kind", "start", "end", "number"])
        out["number"] = out["number"].astype("Int32")
        yield out


def segment(units: DataFrame) -> DataFrame:
    """unit_id, idx, kind, start, end and number of all pieces. A null or blank text has none."""
    return units.select("unit_id", "content").mapInPandas(_segmented, "unit_id long, idx int, kind string, start int, end int, number int")
