"""Event lines: a stream that is interrupted and grows, against one batch read; both layouts; odd lines."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quirespark.plans import increments
from quirespark.sources import event_lines

SF = "/root/testdata/sf0.001"


def drain(spark, source, sink, checkpoint):
    q = spark.readStream.format("event_lines").load(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_replay_equals_batch(spark, monkeypatch):
    """Files grow by pieces that end within lines and characters; the query is restarted for each piece."""
    spark.dataSource.register(event_lines.EventLines)
    base = tempfile.mkdtemp(prefix="spark-")
    source = f"{base}/in"
    os.makedirs(f"{source}/deep")
    bodies = [(r.stream, r.body.encode()) for r in increments.streamed_bodies(spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 6")).collect()]
    assert len(bodies) > 5
    for step in range(3):
        for k, (name, body) in enumerate(bodies):
            if k % 3 > step:
                continue  # some streams begin later
            cuts = [len(body) * (k % 3 + 1) // 7, len(body) * 5 // 7 + 1, len(body)]
            with open(f"{source}/{'deep/' if k % 2 else ''}{name}", "ab") as f:
                f.write(body[f.tell() : cuts[step]])
                if step == 2:
                    f.write(b"\n")
        drain(spark, source, f"{base}/out", f"{base}/checkpoint")
    drain(spark, source, f"{base}/out", f"{base}/checkpoint")  # nothing is new
    got = spark.read.parquet(f"{base}/out")
    want = spark.read.format("event_lines").load(source)
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == got.distinct().count()
    texts = {r.stream.split("/")[-1]: r.text for r in event_lines.replies(got).collect()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 6").collect()
    assert texts == {f"{r.conv_id}-{r.turn}": r.text for r in turns}


def test_splits_lose_no_line(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    lines = [f"data: {'x' * (i * 7 % 90)}{i}é" for i in range(200)] + ["event: ping", "", "data:", "DATA: no", "  data: late  ", "data: half"]
    with open(f"{folder}/s", "wb") as f:
        f.write("\n".join(lines).encode())
    want = [x.strip()[5:].strip() for x in lines if x.strip().startswith("data:")]
    for split in (1, 13, 64, 1 << 20):
        monkeypatch.setattr(event_lines, "SPLIT", split)
        monkeypatch.setattr(event_lines, "CHUNK", 50)
        rows = [(a, d) for p in event_lines._Batch(folder).partitions() for b in event_lines.read_span(folder, p) for a, d in zip(b.column("at").to_pylist(), b.column("data").to_pylist())]
        assert [d for _, d in rows] == want and len({a for a, _ in rows}) == len(rows)
    stream = event_lines._Stream(folder)
    end = stream.latestOffset()
    waits = [d for p in stream.partitions({}, end) for b in event_lines.read_span(folder, p) for d in b.column("data").to_pylist()]
    assert waits == want[:-1]  # the half line waits
    assert stream.partitions(end, end) == []


@pytest.mark.parametrize(
    ("datas", "want"),
    [
        (['{"choices":[{"delta":{"content":"<think>a"}}]}', '{"choices":[{"delta":{"content":"b</think>c"},"finish_reason":"stop"}]}', "[DONE]"], ("c", "end", 0, 0, None)),
        (['{"choices":[{"delta":{"content":"a"}}]}', '{"choices":[{"finish_reason":"content_filter"}],"x_groq":{"usage":{"prompt_tokens":3}}}'], ("a", "refusal", 3, 0, None)),
        (['{"choices":[{"delta":{"content":"a"},"finish_reason":"tool"}]}', '{"choi', "null", "7"], ("a", "other", 0, 0, None)),
        (['{"candidates":[{"content":{"parts":[{"text":"x","thought":true},{"text":"y"},{"text":"z"}]}}]}', '{"candidates":[{"finishReason":"MAX_TOKENS"}],"usageMetadata":{"promptTokenCount":5,"candidatesTokenCount":2,"thoughtsTokenCount":4}}'], ("yz", "max_tokens", 5, 6, None)),
        (['{"promptFeedback":{"blockReason":"X"}}'], ("", "refusal", 0, 0, None)),
        (['{"candidates":[{"finishReason":"RECITATION"}]}', '{"error":{"message":"first"}}', '{"error":{"message":"second"}}'], ("", "refusal", 0, 0, "first")),
        ([], None),
    ],
)
def test_layouts(spark, datas, want):
    events = spark.createDataFrame([("s", i, d) for i, d in enumerate(datas)], event_lines.SCHEMA)
    rows = event_lines.replies(events).drop("stream").collect()
    assert [tuple(r) for r in rows] == ([want] if want else [])


def test_no_files(spark):
    spark.dataSource.register(event_lines.EventLines)
    assert spark.read.format("event_lines").load(tempfile.mkdtemp(prefix="spark-")).count() == 0
    assert event_lines.lines_of(spark.createDataFrame([("a", None), ("b", "")], "s string, b string"), "s", "b").where(F.lit(True)).count() == 0
