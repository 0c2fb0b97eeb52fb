"""What the operators share: the shared work folder and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Application folders made by this process.
_OURS: set[str] = set()
#: Tables made within the innermost :func:`scratch`.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where a local session has none, as in tests, a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder for one table, inside the application's own, which is deleted when the application ends."""
    ours = f"{work_folder(spark)}/quire-{spark.sparkContext.applicationId}"
    if ours not in _OURS:
        path = spark._jvm.org.apache.hadoop.fs.Path(ours)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _OURS.add(ours)
    made = f"{ours}/{tag}-{uuid.uuid4().hex}"
    if (tables := _MADE.get()) is not None:
        tables.append(made)
    return made


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables made within, but for the last one: for work whose result is that table and needs the others no more."""
    token = _MADE.set([])
    try:
        yield
        for path in (_MADE.get() or [])[:-1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    finally:
        last = (_MADE.get() or [])[-1:]
        _MADE.reset(token)
        if (outer := _MADE.get()) is not None:
            outer.extend(last)


def written(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as a row may hold a very long text; one bound for all operators, whenever a plan is made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def held_out(doc_id: Column) -> Column:
    """Rows of the test fold: crc32 of the id as text, modulo 5, is 0; rows without an id are in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def training_labels(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``most`` labelled rows outside the test fold, the first in hash order.

    Of a document with several labels the larger counts. ``most`` bounds what
    a fit gathers, whatever the corpus' size.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    one = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("id"), "id").limit(most)
