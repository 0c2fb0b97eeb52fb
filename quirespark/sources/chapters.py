"""Saving a book's segments batch by batch (T27) and putting back what an aborted run left.

The segments lie in a fixed number of parts by book. A batch rewrites the parts it
touches under its own number and then commits a manifest that names, for each part,
the batch that wrote it last; readers see whole batches only. A batch that comes
again, as after a restart of ``foreachBatch``, is answered from what it recorded; one
that broke off is written anew from the state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["book", "chapter", "i"]
SEGMENTS = "book long, chapter long, i long, words long, out string, failed boolean, edited boolean, by string, warn array<string>"
RESULTS = "book long, chapter long, i long, out string, failed boolean, by string, warn array<string>"
DELTAS = "book long, chapter long, words long, segments long, failed long"


def _measures(row: str = "") -> dict[str, Column]:
    """What a segment adds to its chapter's progress."""
    done = F.col(f"{row}out").isNotNull()
    return {
        "words": F.when(done, F.col(f"{row}words")).otherwise(0).cast("long"),
        "segments": done.cast("long"),
        "failed": F.coalesce(F.col(f"{row}failed"), F.lit(False)).cast("long"),
    }


def progress(segments: DataFrame) -> DataFrame:
    """(book, chapter, words, segments, failed) counted from the segments."""
    return segments.groupBy("book", "chapter").agg(*(F.sum(m).alias(name) for name, m in _measures().items()))


def merged(old: DataFrame, results: DataFrame) -> DataFrame:
    """``old`` segments with a batch's results put in, with what each counted before (``was``) and whether it was touched.

    An edited segment stays as it is; a translation replaces what was there and
    clears the failure; a failure without one is marked. Results for no known
    segment are left out; of several for one segment a translation counts before a failure, then the first by its text.
    """
    first = Window.partitionBy(*KEYS).orderBy(F.col("out").asc_nulls_last(), F.col("failed").desc_nulls_last(), "by")
    new = results.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*KEYS, F.struct("out", "failed", "by", "warn").alias("new"))
    n, edited = F.col("new"), F.coalesce("edited", F.lit(False))
    joined = old.join(new, KEYS, "left").withColumn("was", F.struct(*(m.alias(name) for name, m in _measures().items())))
    takes = n.isNotNull() & ~edited
    translated, failed = takes & n["out"].isNotNull(), takes & n["out"].isNull() & F.coalesce(n["failed"], F.lit(False))
    changed = {
        "out": F.when(translated, n["out"]).otherwise(F.col("out")),
        "failed": F.when(translated, False).when(failed, True).otherwise(F.col("failed")),
        "by": F.when(translated, n["by"]).when(failed, None).otherwise(F.col("by")),
        "warn": F.when(translated | failed, n["warn"]).otherwise(F.col("warn")),
    }
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in old.columns), "was", takes.alias("touched"))


class ChapterTable:
    """Segments under ``root``; the number of parts is fixed when it is made."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("book"), F.lit(self.parts)).cast("int")

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch={batch}"

    def _committed(self, kind: str, batch: int) -> bool:
        return self._fs.exists(self._path(f"{self._folder(kind, batch)}/_SUCCESS"))

    def batches(self) -> list[int]:
        """Committed batches in order; -1 is the table's beginning."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(b for b in (int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")) if self._committed("manifest", b))

    def _manifest(self, batch: int) -> dict[int, int]:
        """The batch that wrote each part last: ``parts`` rows at most."""
        return {r.part: r.written for r in self.spark.read.schema("part int, written long").parquet(self._folder("manifest", batch)).collect()}

    def _write(self, rows: DataFrame, batch: int, before: dict[int, int]) -> None:
        folder = self._folder("rows", batch)
        rows.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        parts = {int(n.removeprefix("part=")): batch for n in made if n.startswith("part=")}
        deltas = self.spark.read.schema(f"{SEGMENTS}, was struct<words:long,segments:long,failed:long>, touched boolean").parquet(folder) if parts else None
        sums = [(F.sum(m) - F.sum(f"was.{name}")).alias(name) for name, m in _measures().items()]
        found = self.spark.createDataFrame([], DELTAS) if deltas is None else deltas.where("touched").groupBy("book", "chapter").agg(*sums)
        found.coalesce(1).write.mode("overwrite").parquet(self._folder("deltas", batch))
        self.spark.createDataFrame(sorted((before | parts).items()), "part int, written long").coalesce(1).write.mode("overwrite").parquet(self._folder("manifest", batch))

    def create(self, segments: DataFrame) -> None:
        """The table's beginning; a table that is there stays."""
        if not self.batches():
            rows = segments.select(*(c.split()[0] for c in SEGMENTS.split(", ")))
            none = F.struct(*(F.lit(0).cast("long").alias(n) for n in _measures()))
            self._write(rows.select("*", none.alias("was"), F.lit(False).alias("touched")), -1, {})

    def _read(self, manifest: dict[int, int], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self._folder('rows', b)}/part={p}" for p, b in sorted(manifest.items()) if only is None or p in only]
        return self.spark.read.schema(SEGMENTS).parquet(*paths) if paths else self.spark.createDataFrame([], SEGMENTS)

    def segments(self) -> DataFrame:
        """The segments as of the last committed batch."""
        done = self.batches()
        return self._read(self._manifest(done[-1])) if done else self.spark.createDataFrame([], SEGMENTS)

    def save(self, batch: int, results: DataFrame) -> DataFrame:
        """Puts a batch's results in and returns (book, chapter, words, segments, failed): what it changed of each chapter it touched.

        Batches come in order; one that is committed already changes nothing and returns what it returned then.
        """
        done = self.batches()
        if not done:
            raise ValueError("make the table first")
        if batch <= done[-1] and not self._committed("deltas", batch):
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        if batch > done[-1]:
            before = self._manifest(done[-1])
            own = results.select(*(c.split()[0] for c in RESULTS.split(", ")))
            touched = [r[0] for r in own.select(self._part()).distinct().collect()]  # no more than parts
            self._write(merged(self._read(before, touched), own), batch, before)
            for old in done[:-1]:  # the last two manifests say all that a reader may still need
                self._fs.delete(self._path(self._folder("manifest", old)), True)
        return self.spark.read.schema(DELTAS).parquet(self._folder("deltas", batch))


def deltas(history: DataFrame, key: list[str], group: list[str], version: str, measures: list[str]) -> DataFrame:
    """(group, version, measures): what each version of the keyed rows changed, against the version before it of the same key.

    ``history`` has a row for each key and version in which the key was written.
    """
    before = Window.partitionBy(*key).orderBy(version)
    change = [F.col(m) - F.coalesce(F.lag(m).over(before), F.lit(0)) for m in measures]
    changed = history.select(*group, version, *(c.alias(m) for c, m in zip(change, measures, strict=True)))
    return changed.groupBy(*group, version).agg(*(F.sum(m).cast("long").alias(m) for m in measures))


def settled(chapters: DataFrame, books: DataFrame, aborted: Column) -> tuple[DataFrame, DataFrame]:
    """Chapters and books after ``aborted`` books have been stopped: active chapters are pending again, a book that isn't queued is paused.

    ``chapters`` has (book, status), ``books`` (book, status, phase); other columns stay.
    """
    stopped = books.select("book", F.coalesce(aborted, F.lit(False)).alias("stopped")).where("stopped").distinct()
    active = F.col("status").isin("translating", "analyzing")
    again = chapters.join(stopped, "book", "left").withColumn("status", F.when(F.col("stopped") & active, "pending").otherwise(F.col("status"))).select(*chapters.columns)
    paused = F.coalesce(aborted, F.lit(False)) & ~F.coalesce(F.col("status") == "queued", F.lit(False))
    halted = books.select(*(F.when(paused, value).otherwise(F.col(c)).alias(c) if (value := {"status": "paused", "phase": "Pausado"}.get(c)) else F.col(c) for c in books.columns))
    return again, halted
