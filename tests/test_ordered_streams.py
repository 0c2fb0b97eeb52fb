"""Streams whose events come late and shuffled over micro-batches, against the batch folds."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quirespark.operators import health
from quirespark.operators.folds import ordered_fold
from quirespark.streaming import ordered

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def late(spark):
    """Events dealt into six files by a time of arrival up to 40 minutes behind their own, and one far event that moves the watermark on."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("at"))
    kind = F.when(F.col("event_type").isin("signup", "click"), "open").when(F.col("event_type") == "purchase", "paid").otherwise("other")
    e = e.select("user_id", "event_id", "at", "us", (F.col("event_type") == "error").alias("failed"), (F.col("value") > 90).alias("account"), kind.alias("kind"))
    rows = [tuple(r) for r in e.collect()]
    rng = random.Random(4)
    arriving = sorted(rows, key=lambda r: r[3] + rng.randrange(40 * 60 * 1_000_000))
    folder = tempfile.mkdtemp(prefix="spark-")
    n = -(-len(arriving) // 6)
    far = (-1, -1, rows[0][2].replace(year=2030), 1_900_000_000_000_000, False, False, "other")
    for k in range(6):
        part = arriving[k * n : (k + 1) * n] + ([far] if k == 5 else [])
        rng.shuffle(part)
        spark.createDataFrame(part, e.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/b{k}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    yield spark.createDataFrame(rows, e.schema), stream, folder
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def drained(stream, name, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    found = stream.sparkSession.table(name)
    return found.where("user_id >= 0"), q


def test_late_breaker_equals_batch(spark, late):
    batch, stream, folder = late
    got, _ = drained(ordered.breaker(stream, "user_id"), "late_breaker", folder)
    want = health.breaker_states(batch, "user_id", "us", "event_id", "failed", "account").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 100


def test_late_upgrades_equal_batch(spark, late):
    batch, stream, folder = late
    gap = 3 * 86400 * 1_000_000
    got, _ = drained(ordered.upgrades(stream, "user_id", gap_us=gap), "late_upgrades", folder)

    def step(state, us, kind):
        state, made = ordered.upgrade_step(state, us, kind, gap)
        return state, (made["session"], made["outcome"])

    want = ordered_fold(batch, ["user_id"], ["us", "event_id"], ["us", "kind"], lambda: [0, None], step, {"session": "long", "outcome": "string"}).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.outcome for r in want.select("outcome").distinct().collect()} == {"opened", "kept", "completed", "expired", "ignored"}


def test_upgrade_steps():
    state, seen = [0, None], []
    for us, kind in [(0, "paid"), (1, "open"), (5, "open"), (9, "paid"), (20, "open"), (31, "open"), (50, "other"), (51, "open"), (52, "other")]:
        state, made = ordered.upgrade_step(state, us, kind, 10)
        seen.append((made["session"], made["outcome"]))
    assert seen == [(0, "ignored"), (1, "opened"), (1, "kept"), (1, "completed"), (2, "opened"), (3, "expired"), (3, "expired"), (4, "opened"), (4, "ignored")]
