"""Token streams: markers of reasoning cut out, and lines put together from chunks, in batch and as streams.

A stream is rows (stream_id, seq, chunk, is_last) in order of seq; chunks may end anywhere. State is
a short buffer for each stream, so a streaming query holds no more than an unfinished line or marker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What opens and closes a thought.
PAIRS = (("<think>", "</think>"), ("<|channel>thought", "<channel|>"))
#: pair and whether it closes, by marker
_ROLES = {marker: (i, k == 1) for i, pair in enumerate(PAIRS) for k, marker in enumerate(pair)}
_ANY = re.compile("|".join(map(re.escape, _ROLES)))
#: buffer, pair that is open (-1: none), whether anything was emitted
FRESH = ("", -1, False)


def _unfinished(markers) -> re.Pattern:
    """An end of text with which one of the markers may begin."""
    starts = sorted({m[:n] for m in markers for n in range(1, len(m))}, key=len, reverse=True)
    return re.compile(rf"(?:{'|'.join(map(re.escape, starts))})\Z")


# what may wait at the end: outside any marker can come, within a pair only its closer
_WAITING = {-1: _unfinished(_ROLES)} | {i: _unfinished([pair[1]]) for i, pair in enumerate(PAIRS)}


def visible(state: tuple, chunk: str, last: bool = False) -> tuple[tuple, str]:
    """The next state, and what of a chunk is not reasoning.

    An end that may become a marker waits; a thought that never closes is dropped, so is a closer
    without a thought; blanks before the first visible character go.
    """
    carry, open_, emitted = state
    text, shown, at = carry + chunk, [], 0
    for found in _ANY.finditer(text):  # markers begin with a sign that none has within, so matches do not overlap
        pair, closes = _ROLES[found[0]]
        if open_ < 0:
            shown.append(text[at : found.start()])
            open_ = -1 if closes else pair
        elif closes and pair == open_:
            open_ = -1
        else:
            continue
        at = found.end()
    waits = None if last else _WAITING[open_].search(text, at)
    end = waits.start() if waits else len(text)
    if open_ < 0:
        shown.append(text[at:end])
    out = "".join(shown) if emitted else "".join(shown).lstrip()
    return (FRESH if last else (text[end:], open_, emitted or bool(out))), out


def lines(state: tuple, chunk: str, last: bool = False) -> tuple[tuple, list[str]]:
    """The next state, and the lines that a chunk completes; the end of the stream completes the last one."""
    parts = (state[0] + chunk).split("\n")
    rest = "" if last else parts.pop()
    return (rest,), [p for p in (x.rstrip("\r") for x in parts) if p]


def event_text(line: str) -> str | None:
    """The text of a server-sent event or of a line of JSON; None for comments, the end mark and broken JSON."""
    body = line[5:].strip() if line.startswith("data:") else line.strip()
    if not body.startswith("{"):
        return None
    try:
        got = json.loads(body)
    except ValueError:
        return None
    choices = got.get("choices") or [{}]
    for value in ((choices[0].get("delta") or {}).get("content"), (got.get("delta") or {}).get("text") if isinstance(got.get("delta"), dict) else None, (got.get("message") or {}).get("content"), got.get("response")):
        if isinstance(value, str):
            return value
    return None


def _reason(key, rows: Iterable[tuple], state: tuple) -> tuple[tuple, list]:
    out = []
    for seq, chunk, last in rows:
        state, text = visible(state, chunk or "", bool(last))
        if text:
            out.append((key, int(seq), text))
    return state, out


def _frame(key, rows: Iterable[tuple], state: tuple) -> tuple[tuple, list]:
    out = []
    for seq, chunk, last in rows:
        state, found = lines(state, chunk or "", bool(last))
        out += [(key, int(seq), text) for text in map(event_text, found) if text is not None]
    return state, out


def each_stream(rows: DataFrame, run: Callable[[str, list[tuple]], list[tuple]], out: str) -> DataFrame:
    """run(stream_id, its rows in order of seq) over streams that lie whole and in order in their tasks; a batch may end within one.

    Rows are read a batch at a time and parted where the id changes, as a call of pandas for each of very
    many short streams costs more than what it does. Rows hold stream_id and seq first; only one stream's are held.
    """
    names = [f.split()[0] for f in out.split(", ")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, []
        for pdf in batches:
            done = []
            for row in zip(*(pdf[c].tolist() for c in pdf.columns)):
                if own and row[0] != key:
                    done += run(key, own)
                    own = []
                key = row[0]
                own.append(row)
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame(run(key, own) if own else [], columns=names)

    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(go, out)


OUT = "stream_id string, seq long, text string"
KINDS: dict[str, tuple[Callable, tuple, str]] = {"reasoning": (_reason, FRESH, "buffer string, inside int, emitted boolean"), "frames": (_frame, ("",), "buffer string")}


def batch(chunks: DataFrame, kind: str) -> DataFrame:
    """Whole streams at once."""
    step, fresh, _ = KINDS[kind]

    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", "chunk", F.coalesce("is_last", F.lit(False)).alias("is_last"))
    return each_stream(rows, lambda key, own: step(key, [r[1:] for r in own], fresh)[1], OUT)


def stream(chunks: DataFrame, kind: str) -> DataFrame:
    """The same over a streaming DataFrame; state goes when a stream's last chunk came."""
    step, fresh, state_schema = KINDS[kind]

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        state, out = step(key[0], zip(rows["seq"], rows["chunk"], rows["is_last"]), tuple(held.get) if held.exists else fresh)
        if rows["is_last"].any():
            held.remove()
        else:
            held.update(state)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, OUT, state_schema, "append", GroupStateTimeout.NoTimeout)


def persist(shown: DataFrame, root: str, checkpoint: str):
    """Writes a stream's texts, a folder for each micro-batch: a batch that runs again overwrites its own, so nothing is stored twice."""
    return shown.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/batch={batch}"))


def until_cancelled(shown: DataFrame, cancels: DataFrame) -> DataFrame:
    """What is kept of streams (stream_id, seq, text) once they are over: one row each with the text up to the cancel (stream_id,
    seq: no chunk from there on), and whether it was cancelled. A stream cancelled before its first text keeps an empty one."""
    first = cancels.groupBy(F.col("stream_id").cast("string").alias("stream_id")).agg(F.min("seq").alias("stop"))
    rows = shown.join(first, "stream_id", "left")
    kept = F.when(F.col("stop").isNull() | (F.col("seq") < F.col("stop")), F.struct("seq", "text"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "")
    return rows.groupBy("stream_id").agg(texts.alias("text"), F.max(F.col("stop").isNotNull()).alias("cancelled"))
