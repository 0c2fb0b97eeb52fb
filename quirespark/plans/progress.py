"""Progress, status and review roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import text as tx
from quirespark.plans.text import sql_words
from quirespark.session import table


def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, turns and first unanswered turn of each conversation."""
    turns = table(spark, sf_dir, "conversations").withColumn("words", tx.word_count(F.col("text")))
    done = F.col("role") != "user"
    return turns.groupBy("conv_id").agg(
        F.sum("words").alias("total_words"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.when(done, F.col("words")).otherwise(0)).alias("done_words"),
        F.coalesce(F.bool_and(done), F.lit(True)).cast("int").alias("complete"),
        F.min(F.when(~done, F.col("turn"))).alias("first_open_turn"),
    )


QUERIES = {"progress_rollup": progress_rollup}
ORACLES = {
    "progress_rollup": f"""
SELECT conv_id, CAST(sum(w) AS BIGINT) AS total_words, count(*) AS n_turns,
       CAST(sum(CASE WHEN role <> 'user' THEN w ELSE 0 END) AS BIGINT) AS done_words,
       CAST(bool_and(role <> 'user') AS INT) AS complete,
       min(CASE WHEN role = 'user' THEN turn END) AS first_open_turn
FROM (SELECT *, {sql_words("text")} AS w FROM conversations) GROUP BY conv_id"""
}
