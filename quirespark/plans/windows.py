"""Positional windows, top-k and ring buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import text as tx
from quirespark.operators import intervals as iv
from quirespark.plans.text import sql_words
from quirespark.session import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("words", tx.word_count(F.col("text"))).withColumn("chars", F.length("text").cast("long"))


def preceding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns before each one, cut to 60 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    short = F.collect_list(tx.truncate(F.col("text"), 60)).over(w)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size(short).cast("long").alias("n"), F.md5(F.array_join(short, "|")).alias("context_md5"))


def bridge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns that fit a character budget at the end of each conversation, one at least."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = _turns(spark, sf_dir).withColumn("upto", F.sum("chars").over(back)).withColumn("r", F.row_number().over(back))
    return t.where((F.col("r") <= 8) & ((F.col("r") == 1) | (F.col("upto") <= 1800))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("chars").alias("chars"))


def heading_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes ranked from the largest within each brand, at most level 3."""
    # ranked are the few different sizes of a brand, not its parts
    parts, w = table(spark, sf_dir, "part"), Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    levels = parts.select("p_brand", "p_size").distinct().withColumn("level", F.least(F.row_number().over(w), F.lit(3)).cast("long"))
    return parts.join(levels, ["p_brand", "p_size"]).select("p_partkey", "level")


def consecutive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"))  # noqa: E741
    return iv.compact_ranges(l, "l_orderkey", "n")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup value on each later event of a user."""
    e = table(spark, sf_dir, "events").withColumn("title", F.when(F.col("event_type") == "signup", F.col("event_id")))
    got = iv.carry_forward(e, "user_id", ["ts", "event_id"], "title", "head")
    return got.groupBy("user_id", "head").agg(F.count(F.lit(1)).alias("pages"))


def shelf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: each customer's orders by status, then newest first."""
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(status, F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 20").select("user_id", "event_id")


def preview_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation that fit 2,500 characters, one at least."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, sf_dir).withColumn("upto", F.sum("chars").over(w)).withColumn("r", F.row_number().over(w))
    return t.where((F.col("upto") <= 2500) | (F.col("r") == 1)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("words").alias("words"))


def lang_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 8 words or more of each document until 8,000 characters are reached."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "src")).where(tx.word_count(F.col("src")) >= 8)
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    kept = lines.withColumn("before", F.coalesce(F.sum(F.length("src")).over(w), F.lit(0))).where("before < 8000")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("src").cast("long")).alias("chars"))


def frequent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words inside lines that occur at least three times, the 15 most frequent of each language."""
    found = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r" (\p{Lu}\p{Ll}{2,})"), F.lit(1))).alias("name"))
    n = found.groupBy("lang", "name").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "name")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 15")


def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines of a source's documents, in how many they stand, and whether these are enough to be headers or footers."""
    lines = F.split("text", "\n", -1)
    fold = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\d+", "#")
    d = table(spark, sf_dir, "documents")
    edges = d.select("source", F.explode(F.array_distinct(F.array(fold(F.element_at(lines, 1)), fold(F.element_at(lines, -1))))).alias("edge")).where("edge <> ''")
    counts = edges.groupBy("source", "edge").agg(F.count(F.lit(1)).alias("n"))
    pages = d.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    repeated = F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 5))
    return counts.join(pages, "source").select("source", F.md5(F.col("edge")).alias("edge_md5"), "n", "pages", repeated.alias("repeated"))


def first_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first open line of each order and who began it."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    open_ = F.col("l_linestatus") == "O"
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return l.groupBy("l_orderkey").agg(
        F.min(F.when(open_, F.col("l_linenumber"))).cast("long").alias("next_line"), F.min_by("l_suppkey", F.when(open_, key)).alias("owner"), F.count_if(~open_).alias("done")
    )


def paragraph_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new paragraph where the gap to the event before is larger than six hours; paragraphs and their longest inner gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    gap = e.withColumn("gap", F.col("us") - F.lag("us").over(w))
    cut = gap.withColumn("part", F.sum(F.coalesce((F.col("gap") > 21_600_000_000).cast("long"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = F.when(F.col("gap") <= 21_600_000_000, F.col("gap"))
    return cut.groupBy("user_id").agg(F.max("part").alias("paragraphs"), F.max(inner).alias("longest_gap"))


QUERIES = {
    f.__name__: f
    for f in (
        preceding_context, bridge_context, heading_dense_rank, consecutive_ranges, carry_forward, shelf_order, ring_buffer, preview_budget,
        lang_sample, frequent_names, repeated_edges, first_unfinished, paragraph_gaps,
    )
}
_T = f"(SELECT *, {sql_words('text')} AS words, CAST(length(text) AS BIGINT) AS chars FROM conversations)"
_SHORT = r"CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(text[1:59], '\s+$', '') || '…' END"
_L = "(SELECT doc_id, unnest(l) AS src, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
ORACLES = {
    "preceding_context": f"""
SELECT conv_id, turn, CAST(coalesce(len(c), 0) AS BIGINT) AS n, md5(coalesce(array_to_string(c, '|'), '')) AS context_md5
FROM (SELECT conv_id, turn, list({_SHORT}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM conversations)""",
    "bridge_context": f"""
SELECT conv_id, count(*) AS turns, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT conv_id, chars, sum(chars) OVER w AS upto, row_number() OVER w AS r FROM {_T} WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
WHERE r <= 8 AND (r = 1 OR upto <= 1800) GROUP BY conv_id""",
    "heading_dense_rank": "SELECT p_partkey, CAST(least(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 3) AS BIGINT) AS level FROM part",
    "consecutive_ranges": """
SELECT l_orderkey, min(n) AS first, max(n) AS last FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g
FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_quantity > 10)) GROUP BY l_orderkey, g""",
    "carry_forward": """
SELECT user_id, head, count(*) AS pages FROM (SELECT user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS head FROM events) GROUP BY ALL""",
    "shelf_order": """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS place FROM orders""",
    "ring_buffer": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20",
    "preview_budget": f"""
SELECT conv_id, count(*) AS turns, CAST(sum(words) AS BIGINT) AS words FROM (SELECT conv_id, words, sum(chars) OVER w AS upto, row_number() OVER w AS r FROM {_T} WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE upto <= 2500 OR r = 1 GROUP BY conv_id""",
    "lang_sample": f"""
SELECT doc_id, count(*) AS lines, CAST(sum(length(src)) AS BIGINT) AS chars FROM (SELECT doc_id, src, coalesce(sum(length(src)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM {_L} WHERE {sql_words('src')} >= 8) WHERE before < 8000 GROUP BY doc_id""",
    "frequent_names": r"""
SELECT lang, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, name) AS rank FROM (
SELECT lang, name, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, ' (\p{Lu}\p{Ll}{2,})', 1)) AS name FROM documents) GROUP BY ALL HAVING count(*) >= 3)) WHERE rank <= 15""",
    "repeated_edges": r"""
SELECT source, md5(edge) AS edge_md5, n, pages, n >= greatest(3, floor(pages / 5.0)) AS repeated FROM (SELECT source, edge, count(*) AS n FROM (SELECT source, unnest(list_distinct([regexp_replace(lower(trim(l[1], ' ')), '\d+', '#', 'g'), regexp_replace(lower(trim(l[-1], ' ')), '\d+', '#', 'g')])) AS edge
FROM (SELECT source, string_split(text, chr(10)) AS l FROM documents)) WHERE edge <> '' GROUP BY ALL) JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) USING (source)""",
    "first_unfinished": """
SELECT l_orderkey, CAST(min(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS BIGINT) AS next_line,
       arg_min(l_suppkey, CASE WHEN l_linestatus = 'O' THEN (l_linenumber, l_partkey, l_suppkey) END) AS owner, count(*) FILTER (WHERE l_linestatus <> 'O') AS done FROM lineitem GROUP BY l_orderkey""",
    "paragraph_gaps": """
SELECT user_id, CAST(sum(CASE WHEN gap <= 21600000000 THEN 0 ELSE 1 END) AS BIGINT) AS paragraphs, max(CASE WHEN gap <= 21600000000 THEN gap END) AS longest_gap
FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id""",
}
