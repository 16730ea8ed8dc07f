import random

import pytest

from quillspark.streaming import tokens as S

CASES = [
    ("plain text", "plain text"),
    ("a < b", "a < b"),
    ("<think>no</think>\n\nyes", "yes"),
    ("<think>never ends", ""),
    ("stray</think> closer", "stray closer"),
    ("<|channel>thought\nhm<channel|>out", "out"),
    ("one<think>x</think>two<think>y</think>", "onetwo"),
    ("ends on <thi", "ends on <thi"),
    ("", ""),
    ("\n\n  lead", "lead"),
]


def run(text, cuts):
    state, out = S.FRESH, ""
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    for i, p in enumerate(parts):
        state, shown = S.visible(state, p, i == len(parts) - 1)
        out += shown
    return out


@pytest.mark.parametrize("text, want", CASES)
def test_reasoning_however_it_is_cut(text, want):
    rng = random.Random(1)
    assert run(text, []) == want
    assert run(text, list(range(1, len(text)))) == want
    for _ in range(20):
        assert run(text, sorted(rng.sample(range(len(text) + 1), min(3, len(text))))) == want


def test_lines_across_chunks():
    state, out = ("",), []
    for c in "data: {\"response\":\"a\"}\r\n\ndata: x\nlast":
        state, found = S.lines(state, c)
        out += found
    assert S.lines(state, "", True)[1] == ["last"] and out == ['data: {"response":"a"}', "data: x"]


def test_event_text():
    assert S.event_text('data: {"choices":[{"delta":{"content":"hi"}}]}') == "hi"
    assert S.event_text('{"message":{"content":"m"}}') == "m" == S.event_text('{"delta":{"text":"m"}}')
    assert S.event_text("data: [DONE]") is None is S.event_text("data: {bad") is S.event_text(": ping")


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for s, (text, _) in enumerate(CASES):
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text))))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(f"s{s}", i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    schema = "stream_id string, seq long, chunk string, is_last boolean"
    rows.sort(key=lambda r: r[1])
    for k in range(0, len(rows), 9):
        spark.createDataFrame(rows[k : k + 9], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = S.stream(source, "reasoning").writeStream.format("memory").queryName("shown").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()

    def whole(df):
        out: dict = {}
        for r in sorted(df.collect(), key=lambda r: (r.stream_id, r.seq)):
            out[r.stream_id] = out.get(r.stream_id, "") + r.text
        return out

    want = {f"s{i}": w for i, (_, w) in enumerate(CASES) if w}
    stored = S.persist(S.stream(source, "reasoning"), f"{tmp_path}/out", f"{tmp_path}/cp2").start()
    stored.processAllAvailable()
    stored.stop()
    assert whole(spark.read.parquet(f"{tmp_path}/out")) == want
    assert whole(spark.table("shown")) == want == whole(S.batch(spark.createDataFrame(rows, schema), "reasoning"))
