"""Samples of books within a budget, and what readers change by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def analysis_sample(chapters: DataFrame, book: str, order: str, words: str, text: str, least: int = 300, each: int = 3500, most: int = 16_000) -> DataFrame:
    """(book, order, sample): beginnings of a book's chapters of ``least`` words or more, ``each`` characters at most, until ``most`` are reached; of all chapters where none is that long."""
    by = Window.partitionBy(book)
    long = F.col(words) >= least
    fit = chapters.withColumn("long_", long).withColumn("any_", F.max("long_").over(by)).where("long_ or not any_")
    cut = fit.select(book, order, F.left(text, F.lit(each)).alias("sample"))
    before = F.coalesce(F.sum(F.length("sample")).over(Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("before_", before).where(F.col("before_") < most).select(book, order, "sample")


def hand_edited(segments: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """``segments`` (keys, out, edited, by, failed and more) with texts that a reader has written: they count as edited, by no model and without failure.

    A blank text changes nothing. ``edits`` has (keys, text), one row for each segment at most.
    """
    said = edits.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select(*keys, F.col("text").alias("said_"))
    joined = segments.join(said, keys, "left")
    new = {"out": F.col("said_"), "edited": F.lit(True), "by": F.lit(None), "failed": F.lit(False)}
    return joined.select(*(F.when(F.col("said_").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in segments.columns))


def to_retranslate(segments: DataFrame) -> DataFrame:
    """``segments`` as before their translation, but for those that a reader has edited."""
    kept = F.coalesce("edited", F.lit(False))
    return segments.select(*(F.when(kept, F.col(c)).otherwise(F.lit(False) if c == "failed" else F.lit(None)).alias(c) if c in ("out", "by", "failed") else F.col(c) for c in segments.columns))
