"""Half-open intervals over positions: building them, joining rows into them, carrying values forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def build_intervals(splits: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, start, end, title, depth): chapters of each document.

    ``splits`` (key, start, title, depth, pos) are cut points in list order;
    those outside the document go, of equal starts the shallowest (then first)
    stays, and a chapter at 0 without a title is put in front where none starts
    there. ``sizes`` (key, n) has each document's length; empty documents have none.
    """
    fit = splits.join(sizes.where("n > 0"), key).where((F.col("start") >= 0) & (F.col("start") < F.col("n")) & (F.col("depth") <= 1))
    best = Window.partitionBy(key, "start").orderBy("depth", "pos")
    cuts = fit.withColumn("r", F.row_number().over(best)).where("r = 1").select(key, "start", "title", "depth")
    first = sizes.where("n > 0").join(cuts.where("start = 0"), key, "left_anti")
    cuts = cuts.unionByName(first.select(key, F.lit(0).cast("long").alias("start"), F.lit(None).cast("string").alias("title"), F.lit(0).cast("long").alias("depth")))
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return cuts.join(sizes, key).select(key, "start", F.coalesce(nxt, F.col("n")).alias("end"), "title", "depth")


def sections(rows: DataFrame, key: str, at: str, cut: Column, into: str = "start") -> DataFrame:
    """``rows`` with the position at which the section of each begins: the last one at or before it where ``cut`` holds, else 0.

    For cut points that are rows themselves: one sort by key and position, and no join.
    """
    before = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.coalesce(F.last(F.when(cut, F.col(at)), ignorenulls=True).over(before), F.lit(0).cast("long")))


def interval_join(rows: DataFrame, intervals: DataFrame, key: str, at: str = "i") -> DataFrame:
    """Each row with the interval that holds it; rows outside all intervals are kept with nulls.

    Intervals do not overlap, so each row looks up the last start at or before
    it: an as-of carry-forward over one sort by key and position, without the
    blow-up of a range predicate. The end then says whether the row is inside.
    """
    both = rows.withColumn("_iv", F.lit(None).cast("struct<start:bigint,end:bigint,title:string>")).withColumn("_o", F.lit(1)).unionByName(
        intervals.select(key, F.col("start").cast(rows.schema[at].dataType).alias(at), F.struct("start", "end", "title").alias("_iv"), F.lit(0).alias("_o")),
        allowMissingColumns=True,
    )
    order = Window.partitionBy(key).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_iv", F.last("_iv", ignorenulls=True).over(order)).where("_o = 1")
    inside = F.col("_iv.end") > F.col(at)
    return found.select(*rows.columns, *(F.when(inside, F.col(f"_iv.{c}")).alias(c) for c in ("start", "end", "title")))


def carry_forward(rows: DataFrame, key: str, order: list[str], value: str, into: str) -> DataFrame:
    """The last non-null ``value`` up to and with each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(w))


def compact_ranges(rows: DataFrame, key: str, n: str) -> DataFrame:
    """(key, first, last): runs of consecutive integers."""
    w = Window.partitionBy(key).orderBy(n)
    return rows.select(key, n).distinct().withColumn("g", F.col(n) - F.row_number().over(w)).groupBy(key, "g").agg(F.min(n).alias("first"), F.max(n).alias("last")).drop("g")
