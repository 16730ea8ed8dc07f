"""Answers in a running stream: cancels between micro-batches, expiry by timers, batch = stream."""

import random
import time

import pytest

from quillspark.streaming import answers as A

CHUNKS = "stream_id string, seq long, chunk string, is_last boolean"
CANCELS = "stream_id string, seq long"


@pytest.fixture()
def run(spark, tmp_path):
    """Feeds micro-batches of (chunks, cancels) to a stream and gives what came out."""
    def go(batches, idle, pause=0.0):
        both = lambda chunks, cancels: A.events(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(cancels, CANCELS)).coalesce(1)
        both([], []).write.parquet(f"{tmp_path}/in")
        out, sent, seen = [], 0, {}
        shown = A.stream(spark.readStream.schema(both([], []).schema).parquet(f"{tmp_path}/in"), idle)
        query = shown.writeStream.foreachBatch(lambda rows, _: out.extend(rows.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
        try:
            for batch in batches:
                time.sleep(pause)
                sent += len(batch[0]) + len(batch[1])
                both(*batch).write.mode("append").parquet(f"{tmp_path}/in")
                until = time.time() + 60
                while sum(seen.values()) < sent and time.time() < until:  # a stream with timers never says that it is done
                    time.sleep(0.3)
                    seen |= {p.batchId: p.numInputRows for p in query.recentProgress}
            time.sleep(pause)
        finally:
            query.stop()
        return sorted(tuple(r) for r in out)

    return go


def test_a_cancel_cuts_between_batches(spark, run):
    batches = [
        ([("a", 0, "<think>x</think>One ", False), ("b", 0, "Be", False), ("c", 0, "Cee <thi", False)], []),
        ([("a", 1, "two", False), ("b", 1, "fore", False)], [("c", 1), ("d", 0)]),
        ([("a", 2, " three", False), ("b", 2, " gone", False), ("d", 0, "never", False)], [("b", 2)]),
        ([("a", 3, ".", True), ("b", 3, " too", True), ("c", 1, "nk>late", True)], []),
    ]
    shown = run(batches, 60_000)
    want = [("a", 0, "One ", "text"), ("a", 1, "two", "text"), ("a", 2, " three", "text"), ("a", 3, ".", "text"), ("a", 3, "", "end"), ("b", 0, "Be", "text"), ("b", 1, "fore", "text"),
            ("b", 1, "", "cancelled"), ("c", 0, "Cee ", "text"), ("c", 0, "<thi", "cancelled"), ("d", -1, "", "cancelled")]
    assert shown == sorted(want)
    chunks, cancels = ([r for b in batches for r in b[k]] for k in (0, 1))
    whole = A.events(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(cancels, CANCELS))
    assert sorted(tuple(r) for r in A.batch(whole).collect()) == shown
    stored = {r.stream_id: (r.text, r.event) for r in A.kept(A.batch(whole)).collect()}
    assert stored == {"a": ("One two three.", "end"), "b": ("Before" + A.STOPPED, "cancelled"), "c": ("Cee <thi" + A.STOPPED, "cancelled"), "d": ("", "cancelled")}


def test_an_answer_without_end_expires(run):
    shown = run([([("a", 0, "left <thi", False), ("b", 0, "fine", True)], []), ([("z", 0, "tick", False)], []), ([("z", 1, "tock", True), ("b", 1, "late", True)], [])], 3_000, 4.0)
    assert [r for r in shown if r[0] == "a"] == [("a", 0, "<thi", "expired"), ("a", 0, "left ", "text")]
    assert [r for r in shown if r[0] == "b" and r[3] == "expired"] == []


def test_batch_is_stream_however_it_is_cut(spark, run):
    rng = random.Random(8)
    batches, cut = [([], []) for _ in range(4)], {}
    for s in range(12):
        text = "".join(rng.choice(["word ", "<think>", "</think>", "<|channel>thought", "<channel|>", "<thi", "\n"]) for _ in range(12))
        parts = [text[i : i + 7] for i in range(0, len(text), 7)]
        cut[s] = rng.choice([None, rng.randrange(len(parts))])
        for i, part in enumerate(parts):
            batches[i * 4 // len(parts)][0].append((f"s{s}", i, part, i == len(parts) - 1))
        if cut[s] is not None:
            batches[cut[s] * 4 // len(parts)][1].append((f"s{s}", cut[s]))
    shown = run(batches, 60_000)
    whole = A.events(*(spark.createDataFrame([r for b in batches for r in b[k]], schema) for k, schema in ((0, CHUNKS), (1, CANCELS))))
    assert sorted(tuple(r) for r in A.batch(whole).collect()) == shown
