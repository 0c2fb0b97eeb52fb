"""The chapter table: replayed and broken batches, deltas against a recount, edited segments, aborted books."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quirespark.sources import chapters


@pytest.fixture
def book(spark):
    rng = random.Random(2)
    rows = [(b, i // 4, i, rng.randrange(1, 30), "old" if i % 5 == 0 else None, False, i % 7 == 3, None, None) for b in range(5) for i in range(20)]
    made = chapters.ChapterTable(spark, tempfile.mkdtemp(prefix="spark-") + "/t", parts=3)
    made.create(spark.createDataFrame(rows, chapters.SEGMENTS))
    return made


def results(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), rng.randrange(5), rng.randrange(22), rng.choice([None, "a", "b"]), rng.random() < 0.5, "m", ["w"]) for _ in range(40)]
    return spark.createDataFrame([(b, i // 4, i, *rest) for b, _, i, *rest in rows], chapters.RESULTS)


def state(table):
    return sorted(map(str, table.segments().collect()))


def test_deltas_equal_a_recount(spark, book):
    total = {(r.book, r.chapter): (r.words, r.segments, r.failed) for r in chapters.progress(book.segments()).collect()}
    for batch in range(4):
        for r in book.save(batch, results(spark, batch)).collect():
            total[r.book, r.chapter] = tuple(a + b for a, b in zip(total[r.book, r.chapter], (r.words, r.segments, r.failed)))
        assert total == {(r.book, r.chapter): (r.words, r.segments, r.failed) for r in chapters.progress(book.segments()).collect()}
    assert book.segments().count() == 100


def test_replay_changes_nothing(spark, book):
    first = sorted(book.save(0, results(spark, 0)).collect())
    book.save(1, results(spark, 1))
    now = state(book)
    assert sorted(book.save(0, results(spark, 99)).collect()) == first and state(book) == now
    again = sorted(book.save(1, results(spark, 1)).collect())
    assert state(book) == now and again == sorted(book.save(1, results(spark, 1)).collect())
    with pytest.raises(ValueError):
        book.save(-5, results(spark, 1))


def test_a_broken_batch_is_written_anew(spark, book):
    """Rows are written but the manifest isn't: readers see the state before, and the batch's repetition gives what a whole one gives."""
    book.save(0, results(spark, 0))
    before = state(book)
    chapters.merged(book.segments(), results(spark, 7)).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(book._folder("rows", 1))
    assert state(book) == before
    whole = book.save(1, results(spark, 1))
    want = chapters.progress(book.segments())
    assert whole.count() > 0 and want.agg(F.sum("segments")).first()[0] > 0
    assert state(chapters.ChapterTable(spark, book.root, 3)) == state(book)


def test_edited_segments_stay(spark, book):
    before = {(r.book, r.i): r for r in book.segments().collect()}
    every = spark.createDataFrame([(b, i // 4, i, "new", False, "m", None) for b in range(5) for i in range(20)], chapters.RESULTS)
    book.save(0, every)
    for r in book.segments().collect():
        assert r == before[r.book, r.i] if r.edited else (r.out, r.failed, r.by) == ("new", False, "m")


def test_saving_from_a_stream(spark, book, tmp_path):
    results(spark, 3).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chapters.RESULTS).parquet(str(tmp_path / "in"))
    seen = []

    def save(df, batch):
        seen.append(sorted(book.save(batch, df).collect()))
        seen.append(sorted(book.save(batch, df).collect()))

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and seen and seen[0] == seen[1]


def test_empty_batches_and_tables(spark, book):
    now = state(book)
    assert book.save(0, spark.createDataFrame([], chapters.RESULTS)).count() == 0 and state(book) == now
    none = chapters.ChapterTable(spark, tempfile.mkdtemp(prefix="spark-") + "/t")
    assert none.segments().count() == 0
    none.create(spark.createDataFrame([], chapters.SEGMENTS))
    assert none.save(0, results(spark, 1)).count() == 0 and none.segments().count() == 0
