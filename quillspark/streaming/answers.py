"""Answers while they are generated: thoughts cut out, cancelled by the reader, given up when nothing comes any more.

Chunks (stream_id, seq, chunk, is_last) and cancels (stream_id, seq: no chunk from there on) are one
stream of events that meet in the state of their answer. A cancel cuts what comes after it, also in later
micro-batches; an answer for which nothing comes for `idle` milliseconds ends as it is, by a timer. What
remains of an ended answer is a mark that lives `idle` milliseconds, so that late chunks do not begin
it anew. Chunks of an answer come in order of seq, as batches may hold them in any order but not later
ones first; what was shown before its cancel came stays shown.

Out come rows (stream_id, seq, text, event): `text` for what is shown, and one last row, without text
but for what waited for the end of a marker: `end`, `cancelled` or `expired`. State is in RocksDB: a buffer of a marker's
length and a few numbers for each answer that goes on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .tokens import FRESH, each_stream, visible

OUT = "stream_id string, seq long, text string, event string"
_STATE = "buffer string, inside int, emitted boolean, at long, stop long, over boolean"
_NEVER = (1 << 63) - 1
_NEW = (*FRESH, -1, _NEVER, False)
IDLE = 10 * 60 * 1000
# Fixed value: what a stopped answer ends with.
STOPPED = "\n\n_(stopped)_"


def events(chunks: DataFrame, cancels: DataFrame) -> DataFrame:
    """Chunks and cancels as one table or stream."""
    own = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "chunk", F.coalesce("is_last", F.lit(False)).alias("is_last"), F.lit(False).alias("cancel"))
    return own.unionByName(cancels.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.lit("").alias("chunk"), F.lit(False).alias("is_last"), F.lit(True).alias("cancel")))


def step(key: str, rows: Iterable[tuple], state: tuple) -> tuple[tuple, list[tuple]]:
    """The state after some events (seq, chunk, is_last, cancel) of an answer, and what they show."""
    buffer, inside, emitted, at, stop, over = state
    out, held = [], (buffer, inside, emitted)
    if over:
        return state, out
    rows = list(rows)
    stop = min([stop, *(int(seq) for seq, _, _, cancel in rows if cancel)])
    for seq, chunk, last, _ in sorted((r for r in rows if not r[3]), key=lambda r: r[0]):
        if seq >= stop:
            break
        at = int(seq)
        held, text = visible(held, chunk or "", bool(last))
        if text:
            out.append((key, at, text, "text"))
        if last:
            out.append((key, at, "", "end"))
            return (*FRESH, at, _NEVER, True), out
    if stop < _NEVER:
        out.append(_closed(key, held, at, "cancelled"))
        return (*FRESH, at, stop, True), out
    return (*held, at, stop, False), out


def _closed(key: str, held: tuple, at: int, event: str) -> tuple:
    return key, at, visible(held, "", True)[1], event


class Answer(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", _STATE, ttlDurationMs=2 * self.idle)  # the timer comes first

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else _NEW
        state, out = step(key[0], (r for pdf in rows for r in zip(pdf["seq"], pdf["chunk"], pdf["is_last"], pdf["cancel"])), state)
        self.state.update(state)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            buffer, inside, emitted, at, _, over = self.state.get()
            if not over:
                out.append(_closed(key[0], (buffer, inside, emitted), at, "expired"))
            self.state.clear()
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "event"])

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream(happened: DataFrame, idle: int = IDLE) -> DataFrame:
    """What a stream of events shows. The session's state store becomes RocksDB, as timers need it."""
    happened.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return happened.groupBy("stream_id").transformWithStateInPandas(Answer(idle), OUT, "Append", "ProcessingTime")


def batch(happened: DataFrame) -> DataFrame:
    """The same for events that are all there; answers without an end have none."""
    rows = happened.select("stream_id", "seq", "chunk", "is_last", "cancel")
    return each_stream(rows, lambda key, own: step(key, [r[1:] for r in own], _NEW)[1], OUT)


def kept(shown: DataFrame) -> DataFrame:
    """stream_id, text and event of answers that are over, as they are stored: once, a stopped one with a note unless it is blank."""
    ended = F.max(F.when(F.col("event") != "text", F.col("event")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", (F.col("event") != "text").alias("last"), "text"))), lambda t: t["text"]), "")
    each = shown.groupBy("stream_id").agg(texts.alias("text"), ended.alias("event")).where("event IS NOT NULL")
    return each.select("stream_id", F.when((F.col("event") == "cancelled") & (F.col("text") != ""), F.concat("text", F.lit(STOPPED))).otherwise(F.col("text")).alias("text"), "event")
