"""Quality verdicts over pairs of turns, and page segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import quality as qa
from quirespark.functions import text as tx
from quirespark.session import table
from quirespark.sources import html


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by id in the session's number of shuffle partitions, stated so that it isn't lowered for their few bytes: judging a turn is work of milliseconds."""
    return table(spark, sf_dir, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return dealt(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("src"), F.lead("text").over(w).alias("out")).where("out is not null")


def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, Q14, Q15: letters, ratio and length verdict of each turn and the next one."""
    ratio = qa.length_ratio(F.col("src"), F.col("out"))
    flag = (
        F.when(~tx.has_words(F.col("out")) & tx.has_words(F.col("src")), "empty")
        .when((F.length("src") >= 80) & ((ratio < 0.35) | (ratio > 2.8)), "length")
        .when((F.length("src") < 80) & (F.length("out") > F.length("src") * 6 + 40), "length")
        .when((F.length("src") >= 80) & ((ratio < 0.6) | (ratio > 1.8)), "ratio")
    )
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(ratio, 6).alias("ratio"), F.coalesce(flag, F.lit("ok")).alias("flag"))


def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q3 to Q7, Q16: the chain without wrong-language, with its warnings (look-behind patterns: no RE2 form)."""
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "turn", F.coalesce(qa.verdict(F.col("src"), F.col("out"), F.lit("pt-BR")), F.lit("ok")).alias("verdict"), F.array_join(qa.warnings(F.col("src"), F.col("out")), ",").alias("warnings"))


def html_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text segments of each page with tag, role, level and words."""
    found = html.segments(table(spark, sf_dir, "pages"))
    return found.select("page_id", "i", "tag", "role", "level", F.md5(F.col("src")).alias("src_md5"), tx.word_count(F.col("src")).alias("words"))


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's title, its first heading of level 3 at most, else its first heading, else its first segment."""
    s = html.segments(table(spark, sf_dir, "pages"))
    head = F.col("role") == "heading"
    return s.groupBy("page_id").agg(
        F.coalesce(F.min_by("src", F.when(head, F.struct(F.col("level") > 3, F.col("i")))), F.min_by("src", "i")).alias("full")
    ).select("page_id", tx.truncate(F.trim(tx.collapse(F.col("full"))), 120).alias("title"))


def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in a page's footer, decoded."""
    footer = F.regexp_extract("html", r"(?s)<footer>(.*?)</footer>", 1)
    return table(spark, sf_dir, "pages").select("page_id", html.decoded(footer).alias("footer"))


QUERIES = {f.__name__: f for f in (quality_flags, quality_verdicts, html_segments, html_titles, html_entities)}
_SIZE = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]'))"
ORACLES = {
    "quality_flags": rf"""
SELECT conv_id, turn, round(r, 6) AS ratio, CASE WHEN NOT regexp_matches(out, '\p{{L}}') AND regexp_matches(src, '\p{{L}}') THEN 'empty'
       WHEN length(src) >= 80 AND (r < 0.35::DOUBLE OR r > 2.8::DOUBLE) THEN 'length' WHEN length(src) < 80 AND length(out) > length(src) * 6 + 40 THEN 'length'
       WHEN length(src) >= 80 AND (r < 0.6::DOUBLE OR r > 1.8::DOUBLE) THEN 'ratio' ELSE 'ok' END AS flag
FROM (SELECT *, {_SIZE.format('out')}::DOUBLE / greatest(1, {_SIZE.format('src')}) / 1.1::DOUBLE AS r
      FROM (SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations) WHERE out IS NOT NULL)""",
}
