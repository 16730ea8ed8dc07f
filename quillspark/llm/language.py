"""Language of web pages by Bayesian evidence fusion.

1. Text: naive Bayes over hashed character n-grams of 1 to 3 of the page's visible text, learnt from
   documents whose language is known; at most SAMPLE of them, those with the smallest hash of
   doc_id. The likelihood is tempered, as n-grams of a text are far from independent.
2. Markup: the language that the page declares. How often pages of a language declare which one is
   estimated from all pages by their text.
3. Address: priors of the host, smoothed by those of its suffix, these by those of all pages. Counts
   are grouped sums of text posteriors; a page's own share is taken out of its prior.
4. The three are added up as logarithms; the language with the highest posterior wins.

Grouped sums are combined before the shuffle, so a host with a third of all pages is one row of a
few numbers for each task. Hosts join back by broadcast while they are few (BROADCAST_ROWS), else
over salted keys.

Defined results: a null or empty page has no text evidence and gets what its address says; a null
or malformed url counts as the empty host; without any labelled document every page's language is
null; of languages with equal posteriors the first by code point is given; rows that repeat a page_id
are rows of their own, each with its part in the counts of hosts; long pages are read whole, each by
itself; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .shared import materialize, small_join, table

#: The most labelled documents that the text model learns from.
SAMPLE = 20_000
#: Buckets of n-grams: 2**BITS numbers for each language.
BITS = 16
#: A text counts as this many independent n-grams at most.
EVIDENCE = 60.0
#: Pseudo-counts with which a host leans on its suffix, and a suffix on all pages.
LEAN = 8.0

_INVISIBLE = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def visible_text(html: str | None) -> str:
    """A page without markup, scripts, styles and comments; entities are characters."""
    return " ".join(unescape(_INVISIBLE.sub(" ", html or "")).split())


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased letters, over bytes, and the number of the text each is in."""
    data, offs = wordhash.text_bytes(column)
    data = wordhash.LOWER[data]
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    plain = np.where(letter, data, 32).astype(np.uint64)
    code, found, where = np.zeros(len(plain), np.uint64), [], []
    for n in range(1, 4):
        code = code[: len(plain) - n + 1] * np.uint64(257) + plain[n - 1 :] if n > 1 else plain + np.uint64(1)
        if not len(code):
            break
        inside = (text[n - 1 :] == text[: len(text) - n + 1]) & letter[: len(plain) - n + 1]
        h = wordhash.mix(code[inside] + np.uint64(n << 56))
        found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        where.append(text[n - 1 :][inside])
    return (np.concatenate(found), np.concatenate(where)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in wordhash.slices(whole, "text"):
            bucket, text = ngrams(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[langs[text] == lang], minlength=1 << BITS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log P(n-gram | language), from documents with text and lang."""
    chosen = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("place", F.xxhash64("doc_id", F.lit(4))).orderBy("place", "doc_id").limit(sample)
    rows = docs.where("lang IS NOT NULL").select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").select("text", "lang")
    sums = rows.mapInArrow(_bucket_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row of 2**BITS numbers for each language of the sample
    found = sorted((r["lang"], bytes(r["weights"])) for r in sums.groupBy("lang").applyInPandas(_log_shares, "lang string, weights binary").collect())
    return [lang for lang, _ in found], np.array([np.frombuffer(w, dtype=np.float32) for _, w in found], dtype=np.float32).reshape(len(found), 1 << BITS)


def _log_shares(counts: pd.DataFrame) -> pd.DataFrame:
    """A language's bucket counts, at most 2**BITS rows -> its smoothed log shares, packed."""
    n = np.full(1 << BITS, 0.5)
    n[counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    return pd.DataFrame({"lang": [counts["lang"].iloc[0]], "weights": [np.log(n / n.sum()).astype(np.float32).tobytes()]})


def _text_evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        n_langs = len(weights)
        for whole in batches:
            for batch in wordhash.slices(whole, "html"):
                column = pa.array([visible_text(h) for h in batch.column("html").to_pylist()], pa.string())
                bucket, text = ngrams(column)
                n = np.bincount(text, minlength=batch.num_rows)
                out = np.empty((batch.num_rows, n_langs))
                for k in range(n_langs):
                    out[:, k] = np.bincount(text, weights=weights[k][bucket], minlength=batch.num_rows)
                out *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                out -= out.max(1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_langs), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "suffix", "declared")), lists], names=["page_id", "host", "suffix", "declared", "evidence"])

    return run


def address(url: Column) -> tuple[Column, Column]:
    """Host and its suffix, the last label; empty where there is none."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return host, F.when(host.rlike(r"\.[a-z]{2,}$"), F.regexp_extract(host, r"([a-z]+)$", 1)).otherwise("")


def declared_language(html: Column) -> Column:
    """The language subtag in the html element or a content-language header, null if there is none."""
    head = F.regexp_extract(html, r"(?i)<html\b[^>]{0,2000}?\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)
    meta = F.regexp_extract(html, r"(?i)<meta\b[^>]{0,2000}?content-language[^>]{0,2000}?content\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)
    return F.lower(F.coalesce(F.nullif(head, F.lit("")), F.nullif(meta, F.lit(""))))


def _sums(p: Column, n: int) -> list[Column]:
    return [F.sum(p[k]).alias(f"s{k}") for k in range(n)]


def _array(n: int, what) -> Column:
    return F.array(*(what(k) for k in range(n)))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], lean: float = LEAN) -> DataFrame:
    """page_id, host, declared, lang and confidence of every page."""
    langs, weights = model
    host, suffix = address(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", host.alias("host"), suffix.alias("suffix"), declared_language(F.col("html")).alias("declared"))
    if not langs:
        return rows.select("page_id", "host", "declared", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    n = len(langs)
    sent = pages.sparkSession.sparkContext.broadcast(weights)
    seen = rows.mapInArrow(_text_evidence(sent), "page_id long, host string, suffix string, declared string, evidence array<double>")
    likely = F.transform("evidence", F.exp)
    seen = seen.withColumn("likely", likely).withColumn("text", F.transform("likely", lambda x: x / F.aggregate("likely", F.lit(0.0), lambda a, b: a + b)))
    seen = materialize(seen.drop("likely"), "language-text")

    # counts of each host, of each suffix, and of all pages; what is declared, for each language
    hosts = materialize(seen.groupBy("host", "suffix").agg(F.count("*").alias("n"), *_sums(F.col("text"), n)), "language-hosts")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), *(F.sum(f"s{k}").alias(f"t{k}") for k in range(n)))
    whole = hosts.agg(F.sum("n"), *(F.sum(f"s{k}") for k in range(n))).first()
    total, sums = float(whole[0] or 0), [float(x or 0) for x in whole[1:]]
    overall = [(s + 1) / (total + n) for s in sums]
    names = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise(F.when(F.col("declared").isNull(), "-").otherwise("other"))
    said = seen.withColumn("name", names).groupBy("name").agg(*_sums(F.col("text"), n)).collect()  # a row for each language and two more
    kinds = len(langs) + 2
    # a page declares its own language more often than another, until counts say otherwise
    log_said = {r["name"]: [float(np.log((r[f"s{k}"] + (2.0 if r["name"] == langs[k] else 1.0)) / (sums[k] + kinds + 1))) for k in range(n)] for r in said}

    joined = small_join(seen, hosts.select("host", F.col("n").alias("hn"), *(f"s{k}" for k in range(n))), "host", "page_id")
    joined = small_join(joined, suffixes, "suffix", "page_id")
    own = F.col("text")
    of_suffix = lambda k: (F.col(f"t{k}") - own[k] + lean * overall[k]) / (F.col("sn") - 1 + lean)
    prior = _array(n, lambda k: F.log(F.greatest(F.lit(1e-9), (F.col(f"s{k}") - own[k] + lean * of_suffix(k)) / (F.col("hn") - 1 + lean))))
    from_markup = F.lit(None)
    for name, values in log_said.items():
        from_markup = F.when(names == name, F.array(*map(F.lit, values))).otherwise(from_markup)
    fused = F.zip_with(F.zip_with("evidence", prior, lambda a, b: a + b), from_markup, lambda a, b: a + b)
    out = joined.select("page_id", "host", "declared", fused.alias("fused")).withColumn("top", F.array_max("fused"))
    out = out.withColumn("confidence", 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    return out.select("page_id", "host", "declared", F.element_at(F.array(*map(F.lit, langs)), F.array_position("fused", F.col("top")).cast("int")).alias("lang"), "confidence")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), fit(table(spark, sf_dir, "documents")))


#: n-gram hashes are beyond SQL; tests check the languages of labelled pages, with and without each kind of evidence.
SQL: dict = {}
