"""Saves with their deltas, books put back after an abort, contents lists in another language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import package as pk
from quirespark.operators import job
from quirespark.session import table
from quirespark.sources import chapters


def save_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's saves changed of a user's words and failures; a segment is one event type, whose last event of a day counts."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    last = F.max_by(F.coalesce("value", F.lit(0.0)), F.struct("ts", "event_id"))
    saved = e.groupBy("user_id", "event_type", "day").agg(last.alias("value"))
    error = F.col("event_type") == "error"
    history = saved.select("user_id", "event_type", "day", F.when(error, 0).otherwise(F.floor("value")).cast("long").alias("words"), (error & (F.col("value") > 50)).cast("long").alias("failed"))
    return chapters.deltas(history, ["user_id", "event_type"], ["user_id"], "day", ["words", "failed"])


def settled_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in progress are aborted: their open lines are pending again, they are paused, but for those of urgent priority, which are queued."""
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), status.alias("status"), F.col("o_orderstatus").alias("phase"))
    state = F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_returnflag") == "N", "translating").otherwise("analyzing")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("line"), state.alias("status"))
    again, halted = chapters.settled(lines, books, F.col("phase") == "P")
    counts = again.groupBy("book").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status").isin("translating", "analyzing")).alias("active"))
    return halted.join(counts, "book").select("book", "status", "phase", "pending", "active")


def translated_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose list of links has new labels; a page's own first words between brackets stand for translations."""
    p = table(spark, sf_dir, "pages")
    own = F.array_distinct(F.regexp_extract_all(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1), F.lit(r"<a [^>]*>([^<]*)</a>"), F.lit(1)))
    plain = F.transform(own, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    labels = F.map_from_arrays(plain, F.transform(plain, lambda x: F.concat(F.lit("["), x, F.lit("]"))))
    return p.select("page_id", F.md5(pk.relabelled(F.col("html"), labels, ["a"])).alias("html_md5"))


def translation_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of conversations in requests of 600 characters; a service that speaks 400 characters of each leaves lines to go out again."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    lines = turns.select(F.col("conv_id").alias("book"), F.col("turn").alias("chapter"), F.posexplode(F.split("text", "\n", -1)).alias("i", "src"))
    lines = lines.select("book", "chapter", F.col("i").cast("long").alias("i"), "src", F.lit(None).cast("string").alias("out"), F.lit(False).alias("failed")).where("src <> ''")

    def service(requests: DataFrame) -> DataFrame:
        said = F.regexp_extract_all("prompt", F.lit(r"(?s)<seg id=\"\d+\">.*?</seg>"), F.lit(0))
        # as many segments as have begun within 400 characters of text
        begin = F.aggregate(said, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept")), lambda acc, x: F.struct(
            (acc["n"] + F.length(F.regexp_replace(x, r"(?s)^<seg[^>]*>|</seg>$", ""))).alias("n"), F.when(acc["n"] < 400, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept")), lambda acc: acc["kept"])
        return requests.select("request", F.array_join(begin, "\n").alias("reply"), F.when(F.size(begin) < F.size(said), "max_tokens").otherwise("end").alias("stop_reason"))

    rows = job.requests_of(job.pending(lines), chars=600)
    made = job.one_round(job.begun(rows), service)
    return made.select("book", "chapter", "i", "origin", "id", "state", F.when(F.col("state") == "again", F.col("again")).alias("again"), F.md5("out").alias("out_md5"))


QUERIES = {f.__name__: f for f in (save_deltas, settled_books, translated_nav, translation_round)}
ORACLES = {
    "translation_round": r"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chapter, i) AS rn FROM (SELECT conv_id AS book, turn AS chapter, unnest(x) AS src, unnest(range(len(x))) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations WHERE text IS NOT NULL)) WHERE src <> ''),
f AS (SELECT DISTINCT book, 0::BIGINT AS rn, 0 AS batch, 0::BIGINT AS held, 0 AS rows FROM l UNION ALL
      SELECT l.book, l.rn, CASE WHEN full_ THEN batch + 1 ELSE batch END, CASE WHEN full_ THEN length(src) ELSE held + length(src) END, CASE WHEN full_ THEN 1 ELSE rows + 1 END
      FROM (SELECT l.*, f.batch, f.held, f.rows, f.rows > 0 AND (f.held + length(l.src) > 600 OR f.rows >= 120) AS full_ FROM f JOIN l ON l.book = f.book AND l.rn = f.rn + 1) l),
r AS (SELECT l.*, l.book || '/' || batch AS origin, row_number() OVER (PARTITION BY l.book, batch ORDER BY l.rn) AS id FROM l JOIN f ON f.book = l.book AND f.rn = l.rn),
s AS (SELECT * FROM (SELECT *, min(id) OVER (PARTITION BY origin, src) AS first FROM r WHERE regexp_matches(src, '\p{L}')) WHERE first = id),
b AS (SELECT *, coalesce(sum(length(src)) OVER (PARTITION BY origin ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 400 AS back FROM s),
d AS (SELECT *, count(*) OVER (PARTITION BY origin) AS n, count(*) FILTER (WHERE NOT back) OVER (PARTITION BY origin) AS rest, count(*) FILTER (WHERE NOT back) OVER (PARTITION BY origin ORDER BY id) AS nth FROM b)
SELECT book, chapter, i, origin, id, CASE WHEN back THEN 'done' ELSE 'again' END AS state,
       CASE WHEN NOT back THEN origin || '.' || CASE WHEN rest < n AND rest <= ceil(n / 2) THEN 'r' WHEN nth > ceil(rest / 2) THEN 'b' ELSE 'a' END END AS again,
       CASE WHEN back THEN md5(replace(replace(replace(regexp_replace(src, '^\s+|\s+$', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) END AS out_md5 FROM d""",
    "save_deltas": """
WITH s AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, arg_max(coalesce(value, 0), (ts, event_id)) AS v FROM events GROUP BY ALL),
h AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(v) AS BIGINT) END AS w, CAST(event_type = 'error' AND v > 50 AS BIGINT) AS f FROM s),
d AS (SELECT user_id, day, w - coalesce(lag(w) OVER k, 0) AS w, f - coalesce(lag(f) OVER k, 0) AS f FROM h WINDOW k AS (PARTITION BY user_id, event_type ORDER BY day))
SELECT user_id, day, CAST(sum(w) AS BIGINT) AS words, CAST(sum(f) AS BIGINT) AS failed FROM d GROUP BY user_id, day""",
    "translated_nav": r"""SELECT page_id, md5(regexp_replace(html, '(<a href="[^"]*">)([^<]*)(</a>)', '\1[\2]\3', 'g')) AS html_md5 FROM pages""",
    "settled_books": """
WITH b AS (SELECT o_orderkey AS book, CASE WHEN o_orderpriority = '1-URGENT' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status, o_orderstatus = 'P' AS gone, o_orderstatus AS s FROM orders)
SELECT book, CASE WHEN gone AND status <> 'queued' THEN 'paused' ELSE status END AS status, CASE WHEN gone AND status <> 'queued' THEN 'Pausado' ELSE s END AS phase,
       CAST(count(*) FILTER (WHERE gone AND l_linestatus <> 'F') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE NOT gone AND l_linestatus <> 'F') AS BIGINT) AS active
FROM b JOIN lineitem ON l_orderkey = book GROUP BY ALL""",
}
