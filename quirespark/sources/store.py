"""Keyed document tables: scans (S13, S15, S31), latest version (S16), upsert by rewrite (S17 to S19), content-addressed caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one for each file; unreadable ones are left out."""
    kept = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return kept.where("_bad is null").drop("_bad")


def latest(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with changed rows replaced and new ones added; a second run changes nothing."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.select(*table.columns))


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table under a content key, built once; Spark's commit makes it appear whole."""
    path = f"{root.rstrip('/')}/{key}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
