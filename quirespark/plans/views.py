"""Read views, access predicates, routing reports and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import markup as mk
from quirespark.functions import text as tx
from quirespark.plans.text import sql_words
from quirespark.session import table


def book_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's view of each book: percent, time left, no internal columns."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    done = F.col("l_linestatus") == "F"
    b = l.groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("words"), F.sum(F.when(done, F.col("l_quantity")).otherwise(0)).cast("long").alias("done"), F.count_if(done).alias("chapters_done"), F.count(F.lit(1)).alias("chapters")
    )
    percent = F.when(F.col("done") >= F.col("words"), F.lit(100.0)).otherwise(F.least(F.lit(99.9), F.floor(F.col("done").cast("double") / F.col("words") * 1000) / 10))
    eta = F.when((F.col("done") > 20) & (F.col("done") < F.col("words")), F.floor((F.col("words") - F.col("done")) * 30.0 / F.col("done")).cast("long"))
    return b.select("l_orderkey", percent.alias("percent"), eta.alias("eta_s"), "chapters_done", "chapters")


def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows an owner sees; an administrator sees all, nobody sees none."""
    readers = spark.createDataFrame([("owner", 7, False), ("admin", None, True), ("nobody", None, False)], "reader string, owner long, admin boolean")
    # owners first, so that the administrator's rows are added up and not multiplied
    owners = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows"))
    seen = owners.join(F.broadcast(readers), F.col("admin") | (F.col("o_custkey") == F.col("owner")))  # three rows
    return readers.join(seen.groupBy("reader").agg(F.sum("rows").alias("n")), "reader", "left").select("reader", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def deep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: documents long enough for an analysis of their own; verse only from 1,000 words."""
    w, lines = tx.word_count(F.col("text")), F.size(F.split("text", "\n", -1))
    d = table(spark, sf_dir, "documents").select("lang", w.alias("w"), lines.alias("lines"))
    deep = F.when(F.col("w") < 300, False).when(F.col("w") >= 1000, True).otherwise(F.col("w") / F.col("lines") >= 12)
    return d.groupBy("lang").agg(F.count_if(deep).alias("deep"), F.count(F.lit(1)).alias("docs"))


def routing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of each level in order, with their events and whether they may serve."""
    levels = spark.createDataFrame([("gratis", ["view", "click", "gone"], True), ("pago", ["purchase", "signup"], False)], "level string, ids array<string>, free boolean")
    listed = levels.select("level", "free", F.posexplode("ids").alias("place", "event_type"))
    use = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 90).alias("high"))
    r = listed.join(use, "event_type", "left")
    return r.select("level", F.col("place").cast("long").alias("place"), "event_type", F.coalesce("n", F.lit(0)).cast("long").alias("requests"), (F.coalesce("n", F.lit(0)) > 0).cast("int").alias("offered"), (F.col("high") == 0).cast("int").alias("closed"))


def restart_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clerk priority's active orders, the longest untouched first."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    first = F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return o.groupBy("o_orderpriority").agg(first.alias("next_order"), F.count(F.lit(1)).alias("active"))


def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20, Q21: segments of a reply; of a repeated id the last body that is not the source."""
    turns = table(spark, sf_dir, "conversations")
    seg = F.concat(F.lit('<seg id="'), F.col("turn").cast("string"), F.lit('">'), F.concat(F.lit("» "), F.col("text")), F.lit("</seg>"), F.lit('<seg id="'), F.col("turn").cast("string"), F.lit('">'), F.col("text"), F.lit("</seg>"))
    parts = F.array_sort(F.collect_list(F.struct("turn", seg.alias("s"))))
    reply = turns.groupBy("conv_id").agg(F.concat(F.lit("<think>plan</think>"), F.array_join(F.transform(parts, lambda p: p["s"]), "\n")).alias("reply"))
    got = reply.select("conv_id", F.posexplode(mk.reply_segments(F.col("reply"))).alias("pos", "s")).select("conv_id", "pos", "s.id", "s.body")
    src = turns.select("conv_id", F.col("turn").alias("id"), F.regexp_replace(F.col("text"), r"^\s+|\s+$", "").alias("src"))
    good = got.join(src, ["conv_id", "id"]).withColumn("good", (F.col("body") != "") & (F.col("body") != F.col("src")))
    return good.groupBy("conv_id", "id").agg(F.md5(F.max_by("body", F.struct("good", "pos"))).alias("body_md5"), F.count(F.lit(1)).alias("copies"))


def new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q22: the capitalised words of each turn as the terms of its reply; those count that the turn before mentions."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("source", F.lag("text").over(w))
    names = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|[ \n])([A-Z][a-z]{2,})[,.]?(?:[ \n]|$)"), F.lit(1))), 1, 30)
    lines = F.transform(names, lambda n: F.concat(F.lit("- "), n, F.lit(" => "), F.lower(n), F.when(F.length(n) > 5, F.lit(" | place")).otherwise(F.lit(" | thing"))))
    reply = F.concat(F.lit("<new_terms>\n"), F.array_join(lines, "\n"), F.lit("\nnoise\n</new_terms>"))
    found = c.where("source is not null").select("conv_id", "turn", F.posexplode(mk.new_terms(reply, F.col("source"))).alias("place", "t"))
    return found.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "t.term", "t.translation", "t.kind")


def limit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long services ask to wait."""
    i, k = F.col("event_id"), F.col("event_id") % 60
    msg = (
        F.when(i % 3 == 0, F.concat(F.lit("TPD: try again in "), (i % 24).cast("string"), F.lit("h"), k.cast("string"), F.lit("m7.5s")))
        .when(i % 3 == 1, F.concat(F.lit("Please wait "), k.cast("string"), F.lit(" seconds before retrying")))
        .otherwise(F.lit("overloaded"))
    )
    e = table(spark, sf_dir, "events").select("event_id", msg.alias("m"))
    return e.select("event_id", mk.limit_daily(F.col("m")).cast("int").alias("daily"), mk.limit_wait_ms(F.col("m")).alias("wait_ms"))


def repaired_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crossing and unknown markers of turns repaired."""
    src = F.concat(F.lit("<em_1>a</em_1> <b_2>b</b_2><br_3/>"), "text")
    out = F.concat(F.lit("<em_1>x <b_2>y</em_1></b_2> <i_9>z</i_9>\n"), "text")
    fixed = mk.repair(out, src)
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", fixed.alias("f"))
    return t.select("conv_id", "turn", F.md5("f.markup").alias("markup_md5"), F.array_join("f.missing", ",").alias("missing"), F.col("f.issues").cast("long").alias("issues"))


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved settings of known keys over defaults."""
    defaults = F.create_map(F.lit("brand"), F.lit("none"), F.lit("size"), F.lit("1"), F.lit("type"), F.lit("plain"))
    saved = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), F.lit("other"), F.lit("x"))
    known = F.map_filter(saved, lambda k, v: k.isin("brand", "size", "type") & v.isNotNull())
    kept = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(known), k))
    m = F.map_concat(kept, known)
    return table(spark, sf_dir, "part").select("p_partkey", m["brand"].alias("brand"), m["size"].alias("size"), m["type"].alias("type"), F.size(m).cast("long").alias("keys"))


QUERIES = {f.__name__: f for f in (book_view, visible_rows, deep_context, routing_report, restart_order, reply_parse, new_terms, limit_messages, repaired_markup, settings_merge)}
ORACLES = {
    "book_view": """
SELECT l_orderkey, CASE WHEN done >= words THEN 100.0::DOUBLE ELSE least(99.9::DOUBLE, floor(done::DOUBLE / words * 1000) / 10) END AS percent,
       CASE WHEN done > 20 AND done < words THEN CAST(floor((words - done) * 30.0::DOUBLE / done) AS BIGINT) END AS eta_s, chapters_done, chapters
FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS words, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS done,
      count(*) FILTER (WHERE l_linestatus = 'F') AS chapters_done, count(*) AS chapters FROM lineitem GROUP BY l_orderkey)""",
    "visible_rows": """
SELECT reader, count(o_orderkey) AS n FROM (VALUES ('owner', 7, FALSE), ('admin', NULL, TRUE), ('nobody', NULL, FALSE)) AS r(reader, owner, admin) LEFT JOIN orders ON admin OR o_custkey = owner GROUP BY reader""",
    "deep_context": f"""
SELECT lang, count(*) FILTER (WHERE w >= 1000 OR (w >= 300 AND w::DOUBLE / n >= 12)) AS deep, count(*) AS docs FROM (SELECT lang, {sql_words('text')} AS w, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY lang""",
    "routing_report": """
SELECT level, place, event_type, CAST(coalesce(n, 0) AS BIGINT) AS requests, CAST(coalesce(n, 0) > 0 AS INT) AS offered, CAST(high = 0 AS INT) AS closed
FROM (VALUES ('gratis', 0::BIGINT, 'view'), ('gratis', 1, 'click'), ('gratis', 2, 'gone'), ('pago', 0, 'purchase'), ('pago', 1, 'signup')) AS l(level, place, event_type)
LEFT JOIN (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 90) AS high FROM events GROUP BY 1) USING (event_type)""",
    "restart_order": "SELECT o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS next_order, count(*) AS active FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1",
    "reply_parse": r"""
SELECT conv_id, turn AS id, md5(regexp_replace('» ' || text, '\s+$', '')) AS body_md5, 2::BIGINT AS copies FROM conversations""",
    "new_terms": r"""
WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations),
n AS (SELECT conv_id, turn, ' ' || regexp_replace(lower(source), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS s, list_distinct(regexp_extract_all(text, '(?:^|[ \n])([A-Z][a-z]{2,})[,.]?(?:[ \n]|$)', 1)) AS d, regexp_extract_all(text, '(?:^|[ \n])([A-Z][a-z]{2,})[,.]?(?:[ \n]|$)', 1) AS w FROM c WHERE source IS NOT NULL),
t AS (SELECT conv_id, turn, s, x AS term, min(k) AS k FROM (SELECT conv_id, turn, s, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM n) GROUP BY conv_id, turn, s, x QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(k)) <= 30),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS place FROM t
      WHERE contains(s, ' ' || lower(term) || ' ') OR contains(s, ' ' || lower(term) || 's ') OR contains(s, ' ' || lower(term) || 'es '))
SELECT conv_id, turn, place, term, lower(term) AS translation, CASE WHEN length(term) > 5 THEN 'place' ELSE 'other' END AS kind FROM m WHERE place < 20""",
    "limit_messages": """
SELECT event_id, CAST(event_id % 3 = 0 AS INT) AS daily, CASE WHEN event_id % 3 = 0 THEN CAST(ceil(((event_id % 24) * 3600 + (event_id % 60) * 60 + 7.5) * 1000) AS BIGINT)
       WHEN event_id % 3 = 1 THEN nullif((event_id % 60) * 1000, 0) END AS wait_ms FROM events""",
    "settings_merge": "SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '1' END AS size, 'plain' AS type, 3::BIGINT AS keys FROM part",
}
