"""Folds, quality rules, sources and streams against plain Python."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.functions import pricing, quality
from quirespark.functions import text as tx
from quirespark.operators import folds, glossary, health, intervals
from quirespark.sources import epub, html, store
from quirespark.streaming import state

SF = "/root/testdata/sf0.001"


def values(spark, column, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_word_count(spark):
    texts = ["rock-n-roll aujourd'hui", "", None, "— * * *", "日本語のテキスト one two"]
    assert values(spark, tx.word_count(F.col("v")), texts) == [2, 0, 0, 0, 7]


def test_price_points(spark):
    words = [300, 5_000, 10_000, 44_152, 210_000]
    assert values(spark, pricing.price_for(F.col("v"), F.lit(False)), words, "v long") == [9.9, 9.9, 16.9, 67.9, 314.9]
    assert values(spark, pricing.round_to_90(F.col("v")), [19.12, 19.95, 19.90], "v double") == [19.9, 20.9, 19.9]


def test_batch_shapes(spark):
    items = spark.createDataFrame([(1, i, 42) for i in range(1000)], "k long, i long, n long")
    for most, rows, want in ((24_000, 120, [120] * 8 + [40]), (24_000, 400, [400, 400, 200])):
        got = folds.greedy_batches(items, "k", "i", "n", most, rows).groupBy("batch").count().orderBy("batch").collect()
        assert [r["count"] for r in got] == want
    first = folds.greedy_batches(items, "k", "i", "n", 4_200, 120).where("batch = 0").count()
    assert first == 100


def test_batches_keep_rows_and_limits(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([5, 50, 900])) for k in range(4) for i in range(60)]
    got = folds.greedy_batches(spark.createDataFrame(rows, "k long, i long, n long"), "k", "i", "n", 800, 7).collect()
    size = {(k, i): n for k, i, n in rows}
    held = defaultdict(list)
    for r in got:
        held[r.k, r.batch].append(size[r.k, r.i])
    assert len(got) == len(rows) and all(len(v) == 1 or (sum(v) <= 800 and len(v) <= 7) for v in held.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.booleans(), st.booleans()), max_size=30))
def test_breaker_properties(events):
    held, last = None, 0
    for at, failed, account in sorted(events):
        held, (name, n, until) = health.breaker_step(held, at, failed, account)
        if not failed:
            assert (name, n, until) == ("closed", 0, 0)
        else:
            assert at + health.COOLDOWN <= until <= at + health.CEILING and name in ("open", "cooldown")
        last = at
    assert last >= 0


def test_breaker_sequence():
    s, held, seen = health.SECOND, None, []
    for at in (0, 61, 122, 243):
        held, (name, _, until) = health.breaker_step(held, at * s, True, False)
        seen.append((name, until // s - at))
    assert seen == [("cooldown", 60), ("cooldown", 60), ("open", 120), ("open", 240)]
    assert health.breaker_step(None, 0, True, True)[1] == ("open", 0, 6 * 3600 * s)


def test_paced_requests(spark):
    rows = [(1, 0, i, 3000) for i in range(4)] + [(1, 0, 9, 20_000)]
    got = health.paced_starts(spark.createDataFrame(rows, "k long, us long, id long, n long"), "k", "us", "id", "n", 30, 8000).orderBy("id").collect()
    assert [r.start // health.SECOND for r in got] == [0, 2, 60, 62, 122]


GOOD = [("The sea remembers everything that it has ever held in its cold hands.", "O mar se lembra de tudo o que já segurou em suas mãos frias, sempre.")]
BAD = [
    ("Good morning.", "...", "empty"), ("Hello there, my friend.", "Olá <seg id=3> amigo", "leak"), ("She smiled.", "<b>Ela</b> sorriu.", "stray-tag"), ("She smiled.", "Ela **sorriu** bem.", "stray-tag"),
    ("He left.", "Ele 离开 foi.", "foreign-script"), ("He left at dawn.", "Here is the translation: Ele saiu.", "commentary"), ("He left.", "I'm sorry, I can't translate this passage.", "commentary"),
    ("they walked along the river until night", "They walked along the river, until night!", "echo"), ("x " * 60, "y", "length"), ("Yes.", "Sim " * 40, "length"),
]


@pytest.mark.parametrize("src,out,want", [*((a, b, None) for a, b in GOOD), *BAD])
def test_quality_verdict(spark, src, out, want):
    df = spark.createDataFrame([(src, out)], "a string, b string")
    assert df.select(quality.verdict(F.col("a"), F.col("b"), F.lit("pt-BR"))).first()[0] == want


def test_quality_extras(spark):
    df = spark.createDataFrame([("<em_1>one</em_1> <br_2/>two", "<em_1>um</em_1> dois", "Sorry, I cannot translate this text.")], "a string, b string, c string")
    r = df.select(quality.warnings(F.col("a"), F.col("b")).alias("w"), quality.refusal(F.col("c")).alias("r"), quality.without_stray_tags(F.lit("<b>a</b> **b**")).alias("s")).first()
    assert (r.w, r.r, r.s) == (["fmt-lost"], True, "a b")


def test_mentions(spark):
    rows = [("the dementors", "Dementor", True), ("Anabela", "Ana", False), ("Holmes's pipe", "Holmes", True), ("a.b", "a+b", False), ("C++ code", "c++", True)]
    df = spark.createDataFrame(rows, "t string, term string, want boolean")
    assert df.where(glossary.mentions(F.col("t"), F.col("term")) != F.col("want")).count() == 0


def test_interval_join(spark):
    rows = spark.createDataFrame([("d", i) for i in range(6)] + [("e", 0)], "k string, i long")
    cuts = spark.createDataFrame([("d", 1, 3, "a"), ("d", 3, 5, "b")], "k string, start long, end long, title string")
    got = {(r.k, r.i): r.title for r in intervals.interval_join(rows, cuts, "k").collect()}
    assert got == {("d", 0): None, ("d", 1): "a", ("d", 2): "a", ("d", 3): "b", ("d", 4): "b", ("d", 5): None, ("e", 0): None}


def test_html_segments(spark):
    page = '<html><script>var t="</p><p>no";</script><h2>Title</h2><p>One <b>two</b><br>three &lt;x&gt;<ul><li>item</ul><p> </p>'
    got = html.segments(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.page_id, r.i, r.tag, r.role, r.level, r.src) for r in got] == [
        (1, 0, "h2", "heading", 2, "Title"), (1, 1, "p", "paragraph", None, "One <b_1>two</b_1><br_2/>three &lt;x&gt;"), (1, 2, "li", "list", None, "item"),
    ]


def test_epub_round_trip(spark, tmp_path):
    chapters = [("a", i, f"Chapter {i}", f"<p>Text {i} &amp; more</p>", "en") for i in range(3)]
    built = epub.build_epubs(spark.createDataFrame(chapters, "book_id string, idx long, title string, body string, language string")).collect()
    (tmp_path / "a.epub").write_bytes(built[0].epub)
    (tmp_path / "bad.epub").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "other.txt").write_bytes(b"plain")
    rows = epub.read_epubs(spark, str(tmp_path)).orderBy("path", "idx").collect()
    assert [(r.idx, r.label) for r in rows if r.error is None] == [(i, f"Chapter {i}") for i in range(3)]
    assert sum(r.error is not None for r in rows) == 1 and "Text 1 &amp; more" in rows[1].html


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    once = store.upsert(a, b, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, "w")] == sorted(map(tuple, store.upsert(once, b, ["k"]).collect()))
    calls = []
    for _ in range(2):
        got = store.cached(spark, f"file://{tmp_path}", "key", lambda: calls.append(1) or a)
    assert len(calls) == 1 and got.count() == 2


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("at"))
    e = e.select("user_id", "event_id", "at", "us", F.floor("value").cast("long").alias("tokens"), (F.col("event_type") == "error").alias("failed"), (F.col("value") > 90).alias("account"))
    e.coalesce(1).orderBy("us").write.parquet(str(folder / "in"))
    return spark.read.parquet(str(folder / "in")), spark.readStream.schema(e.schema).parquet(str(folder / "in")), str(folder)


def drained(stream, name, mode, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_usage_equals_batch(spark, events):
    batch, stream, folder = events
    got = drained(state.daily_usage(stream, "user_id", "at", "tokens", "America/Los_Angeles"), "usage", "complete", folder)
    want = health.daily_usage(batch, "user_id", "at", "tokens", "America/Los_Angeles")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_breaker_equals_batch(spark, events):
    batch, stream, folder = events
    got = drained(state.breaker(stream, "user_id"), "breaker", "append", folder).select("user_id", "us", "event_id", "state", "consecutive", "blocked_until")
    want = health.breaker_states(batch, "user_id", "us", "event_id", "failed", "account").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_once_and_sessions(spark, events):
    batch, stream, folder = events
    twice = stream.unionByName(stream)
    assert drained(state.once(twice, "event_id", "at"), "once", "append", folder).count() == batch.count()
    sessions = drained(state.hold_sessions(stream, "user_id", "at"), "holds", "complete", folder)
    assert sessions.agg(F.sum("events")).first()[0] == batch.count()


def test_markup_repair(spark):
    from quirespark.functions import markup as mk

    rows = [
        ("<em_1>a <b_2>b</em_1></b_2> <i_9>c</i_9>", "<em_1>x</em_1><b_2>y</b_2>", "<em_1>a <b_2>b</b_2></em_1> c", [], 4),
        ("one\ntwo", "one<br_3/>two<img_4/>", "one<br_3/>two<img_4/>", [4], 0),
        ("5 < 6 & <em_1>x", "<em_1>x</em_1>", "5 &lt; 6 &amp; <em_1>x</em_1>", [], 1),
        (None, "x", None, None, None),
    ]
    df = spark.createDataFrame([(o, s) for o, s, *_ in rows], "o string, s string").select(mk.repair(F.col("o"), F.col("s")).alias("r"))
    got = [(r.r.markup, r.r.missing, r.r.issues) if r.r else (None, None, None) for r in df.collect()]
    assert got == [tuple(r[2:]) for r in rows]


def test_limits_and_replies(spark):
    from quirespark.functions import markup as mk

    messages = ["Please try again in 7.66s", "TPD limit: try again in 14m24s", "wait 3600 seconds ByDay", "wait 39 seconds", "busy"]
    assert values(spark, mk.limit_wait_ms(F.col("v")), messages) == [7660, 864_000, 3_600_000, 39_000, None]
    assert values(spark, mk.limit_daily(F.col("v")), messages) == [False, True, True, False, False]
    reply = 'x <think>no</think><seg id=1>a</seg><seg id="2"> b <think>kept</think><seg id="3">c</seg><new_terms>\n- Ana => Anna | character\nbad\n</new_terms>'
    assert values(spark, mk.reply_segments(F.col("v")), [reply])[0] == [(1, "a"), (2, "b <think>kept</think>"), (3, "c")]
    assert values(spark, mk.new_terms(F.col("v")), [reply])[0] == [("Ana", "Anna", "character")]
