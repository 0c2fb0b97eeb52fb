"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir), written as Parquet and read
again as the next one's docs. All but the last return the columns of documents,
whatever else these are named; an empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import line_dedup, packing, ranking, simhash, wu_manber
from quirespark.llm.common import scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the others go.

    A null text is scored as an empty one. Rows that repeat an id are scored each.
    """
    model = ranking.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ranking.score_quality(docs, model, prefix="_quality_").where("_quality_predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Duplicate lines are cut out; a document of which no word is left by that goes.

    Null and empty texts and rows without an id stay as they are.
    """
    found = line_dedup.dedup_lines(docs)
    left = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)) | (F.col("n_dropped") == 0)
    kept = found.where(left).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not among (doc_id, text_hash) of ``gone``; a row is one struct meanwhile, so no name of a column can clash."""
    rows = docs.select(F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"))
    same = F.col("row").getField("doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row").getField("text")) == F.col("text_hash"))
    return rows.join(gone.select("doc_id", "text_hash").distinct(), same, "left_anti").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by id and text; equal rows go or stay together.
    """
    with scratch(spark):
        found = simhash.near_duplicates(docs)
        gone = written(found.where(~F.col("kept")).select("doc_id", "text_hash"), "gone")
    return without(docs, gone)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window.

    A row is judged by its own text, also where others have its id or none has one; a null text stays.
    """
    found = wu_manber.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    # written first, so that its size is known and the documents stay where they are if it is small
    return without(docs, written(found.where("n_hit > 0").select("doc_id", "text_hash"), "hits"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of power-of-two length, with their token ids; a null text is packed as an empty one."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), with_ids=True)


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near), ("decontamination", clean), ("packing", pack)]
#: Training, fingerprints and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
