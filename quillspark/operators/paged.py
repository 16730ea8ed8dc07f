"""Scanned books as pages: what section a page belongs to is told by its running head, and where it has none, by the page before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# The running head of a book of psalms, whose group 1 is the number.
HEAD = r"Psalm[^\S\n]+(\d+)"
_BLANK_LINES, _LINE_END = r"(?:[^\S\n]*\n)*+", r"[^\S\n]*(?:\n|\z)"


def pages_by_head(texts: DataFrame, head: str = HEAD, keys: tuple[str, ...] = ("work",), text: str = "text") -> DataFrame:
    """The keys, page (from 0), number, printed (the head's own number, null where it is carried) and body of each page from the first head on.

    A page begins with its head and its page number; both go, with the blank lines around them, but only
    where the page number is there, as a heading of the text reads like a head. A book is a row, and its pages
    come from that row: numbers are carried within it, before form feeds are exploded, and nothing is shuffled. A null text has no pages.
    """
    books = texts.select(*keys, F.split(text, "\f").alias("raws"))

    def printed(raw):
        return F.regexp_extract(F.rtrim(F.regexp_extract(raw, r"\A\s*([^\n]*)", 1)), rf"\A{head}\s*\z", 1).try_cast("int")

    books = books.withColumn("printeds", F.transform("raws", printed)).withColumn("numbers", _carried("printeds"))
    rows = books.select(*keys, F.posexplode(F.arrays_zip("raws", "printeds", "numbers")).alias("page", "p")).where("p.numbers IS NOT NULL")
    bare = head.replace("(\\d", "(?:\\d")
    furniture = rf"\A{_BLANK_LINES}(?:[^\S\n]*{bare}{_LINE_END}{_BLANK_LINES})?[^\S\n]*\d+{_LINE_END}{_BLANK_LINES}"
    return rows.select(*keys, "page", F.col("p.numbers").alias("number"), F.col("p.printeds").alias("printed"), F.regexp_replace("p.raws", furniture, "").alias("body"))


@F.arrow_udf(ArrayType(IntegerType()))
def _carried(numbers: pa.Array) -> pa.Array:
    """Each list with the last number before in place of a null; null where there is none."""
    sizes = numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = numbers.flatten()
    place = np.arange(len(found))
    last = np.maximum.accumulate(np.where(found.is_valid().to_numpy(zero_copy_only=False), place, -1)) if len(found) else place
    none = last < np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found.take(pa.array(last, pa.int64(), mask=none)))


def texts_by_head(pages: DataFrame, keys: tuple[str, ...] = ("work",)) -> DataFrame:
    """The keys, number, printed, pages and body of each section: its pages in order, one line behind the other, wherever in the book they are."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda p: p["body"]), "\n")
    return pages.groupBy(*keys, "number").agg(F.count("*").alias("pages"), F.max(F.col("printed").cast("string")).alias("printed"), own.alias("body"))
