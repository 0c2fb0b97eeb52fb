"""Ordered folds, service state and daily limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import text as tx
from quirespark.operators import folds, health
from quirespark.plans.text import sql_words
from quirespark.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.withColumn("us", F.unix_micros("at")).withColumn("tokens", F.floor(F.coalesce("value", F.lit(0.0))).cast("long"))


def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation in batches of 800 characters and 3 turns; each takes 21 characters more."""
    t = table(spark, sf_dir, "conversations").withColumn("n", (F.length("text") + 21).cast("long"))
    return folds.greedy_batches(t, "conv_id", "turn", "n", 800, 3)


def chapter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: consecutive documents of a source that fit one request of 24,000 characters and 120 lines."""
    d = table(spark, sf_dir, "documents").withColumn("chars", F.length("text").cast("long")).withColumn("segments", F.size(F.split("text", "\n", -1)).cast("long"))
    return folds.chapter_groups(d, "source", "doc_id", "chars", "segments", 24_000, 120)


def word_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source cut into parts of 3,500 words."""
    d = table(spark, sf_dir, "documents").withColumn("words", tx.word_count(F.col("text")))
    return folds.word_cuts(d, "source", "doc_id", "words")


def binding_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: a binding for each customer of a nation's shelf."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", tx.fnv1a(F.col("c_name")).alias("h"), (F.col("c_custkey") % 4 == 0).alias("covered"))
    return folds.assign_bindings(c, "c_nationkey", ["c_custkey"], "h", "covered")


def line_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a page (an order's lines) put into text lines by their distance from the line's first item."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y"), "l_linenumber", "l_partkey", (F.col("l_tax") * 100).alias("size"))
    return folds.page_lines(i, "l_orderkey", ["y", "l_linenumber", "l_partkey"], "y", "size").groupBy("l_orderkey").agg((F.max("line") + 1).alias("lines"), F.count(F.lit(1)).alias("items"))


def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's circuit breaker after each event; errors fail, values over 90 fail the account."""
    e = _events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error").withColumn("account", F.coalesce(F.col("value") > 90, F.lit(False)))
    return health.breaker_states(e, "user_id", "us", "event_id", "failed", "account")


def paced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's request may start at 20 requests and 8,000 tokens a minute."""
    return health.paced_starts(_events(spark, sf_dir), "user_id", "us", "event_id", "tokens", 20, 8000)


def token_window_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: tokens of all users' requests of a type in the 60 seconds before each one.

    Each event stands in its own minute and, as what went before, in the next one,
    so that the window of a frequent type is many small ones.
    """
    minute = F.floor(F.col("us") / 60_000_000).cast("long")
    e = _events(spark, sf_dir).withColumn("own", minute).withColumn("minute", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    w = Window.partitionBy("event_type", "minute").orderBy("us").rangeBetween(-60_000_000, 0)
    summed = e.select("event_id", "own", "minute", F.sum("tokens").over(w).alias("used"), F.count(F.lit(1)).over(w).alias("requests"))
    return summed.where("own = minute").drop("own", "minute")


def quota_daily_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and tokens of each user by Pacific day."""
    return health.daily_usage(_events(spark, sf_dir), "user_id", "at", "tokens", "America/Los_Angeles")


def quota_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of 12 requests a day, 0 once the day had an error, by UTC day."""
    e = _events(spark, sf_dir).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    by = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "error").alias("out"))
    return by.select("user_id", "day", F.when(F.col("out"), F.lit(0)).otherwise(F.greatest(F.lit(0), 12 - F.col("n"))).cast("long").alias("left"))


def hold_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events that end after two hours without one."""
    s = _events(spark, sf_dir).groupBy("user_id", F.session_window("at", "2 hours").alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "events")


def daily_preview_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two clicks of a user's day."""
    e = _events(spark, sf_dir).where("event_type = 'click'").withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    w = Window.partitionBy("user_id", "day").orderBy("us", "event_id")
    return e.withColumn("r", F.row_number().over(w)).where("r <= 2").select("user_id", "day", "event_id")


def review_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q25, Q26: labelled documents of poor quality lose their output; how many by language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reset = (F.coalesce(F.col("quality"), F.lit(1)) == 0) & (F.col("doc_id") % 5 != 0)
    return d.groupBy("lang").agg(F.count_if(reset).alias("reset"), F.sum(F.when(reset, 0).otherwise(F.length("text"))).cast("long").alias("kept_chars"))


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before the n-th attempt, doubled each time up to a ceiling."""
    n = F.col("l_linenumber").cast("double")
    ms = F.least(F.lit(15_000.0) * F.pow(F.lit(2.0), n - 1), F.lit(300_000.0))
    service = F.least(F.lit(900_000.0) * F.pow(F.lit(2.0), n), F.lit(21_600_000.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.max(ms).cast("long").alias("wait_ms"), F.max(service).cast("long").alias("service_ms")).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


def next_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next Pacific midnight, UTC midnight and month after each user's last event, in UTC seconds."""
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max("at").alias("at"))
    zone = "America/Los_Angeles"
    pacific = F.to_utc_timestamp(F.date_add(F.to_date(F.from_utc_timestamp("at", zone)), 1).cast("timestamp"), zone)
    day = F.date_add(F.to_date("at"), 1).cast("timestamp")
    month = F.add_months(F.trunc(F.to_date("at"), "month"), 1).cast("timestamp")
    return last.select("user_id", *(F.unix_seconds(c).alias(n) for c, n in ((pacific, "pacific"), (day, "utc_day"), (month, "utc_month"))))


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid, short or open orders; a payment that is too small is refunded."""
    paid = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("paid"))
    o = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    j = o.join(paid, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    enough = F.col("paid") + F.lit("0.005").cast("decimal(18,3)") >= F.col("price")
    state = F.when(F.col("paid").isNull(), "open").when(enough, "confirmed").otherwise("refund")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.when(state == "refund", F.col("paid"))).cast("double").alias("refunded"))


def merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document as paragraphs, which begin with a capital behind a sentence's end; lines with a quotation mark are italic."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", "i", line.alias("line")).where("line <> ''")
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("i"))
    begins = F.coalesce(before.rlike(r"[.!?]$") & F.col("line").rlike(r"^\p{Lu}"), F.lit(True))
    runs = F.array(F.struct(F.col("line").alias("text"), F.contains("line", F.lit('"')).alias("italic"), F.lit(False).alias("bold")))
    found = folds.merged_lines(lines.select("doc_id", "i", runs.alias("runs"), begins.alias("begins")), "doc_id", "i", "runs", "begins")
    return found.select("doc_id", "para", F.size("runs").cast("long").alias("runs"), F.md5(F.array_join(F.transform("runs", lambda r: r["text"]), "")).alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        greedy_batches, chapter_groups, word_cuts, binding_assign, line_cluster, breaker_state, paced_requests, token_window_60s, quota_daily_tz,
        quota_left, hold_sessions, daily_preview_limit, review_reset, retry_waits, next_resets, order_states, merged_paragraphs,
    )
}
_E = "(SELECT *, epoch_us(ts) AS us, CAST(floor(coalesce(value, 0)) AS BIGINT) AS tokens FROM events)"


def _recursive(src: str, key: str, order: str, cols: str, start: str, step: str, out: str) -> str:
    """A fold as a recursive query over row numbers: each step joins the next row of every key."""
    return f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {src}),
f AS (SELECT {key}, {order}, rn, {start} FROM s WHERE rn = 1 UNION ALL SELECT s.{key}, s.{order}, s.rn, {step} FROM f JOIN s ON s.{key} = f.{key} AND s.rn = f.rn + 1)
SELECT {key}, {order}, {out} FROM f"""


#: FNV-1a of a name, and nine bindings with their families.
_FNV = """CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
  lambda h, c: (CAST(xor(CAST(h AS BIGINT), CAST(c AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296) AS BIGINT)"""
_FAMILIES = "[" + ", ".join(f"'{family}'" for _, family in folds.BINDINGS) + "]"
_NAMES = "[" + ", ".join(f"'{name}'" for name, _ in folds.BINDINGS) + "]"
#: The first place of a book's walk over the bindings whose family the last two do not have, else the walk's end, which is its beginning.
_PICK = f"coalesce(list_filter(s.walk, lambda x: NOT list_contains(recent, ({_FAMILIES})[x + 1]))[1], s.walk[1])"
_CUT = "(held + s.n > 800 OR c >= 3)"
_GCUT = "(hc + s.chars > 24000 OR hs + s.segments > 120 OR c >= 40)"
ORACLES = {
    "merged_paragraphs": r"""
WITH l AS (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
b AS (SELECT *, lag(line) OVER w AS prev FROM l WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND regexp_matches(prev, '[.!?]$') AND regexp_matches(line, '^\p{Lu}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM b),
n AS (SELECT *, lead(line) OVER w AS next, coalesce(contains(line, '"') <> lag(contains(line, '"')) OVER w, true) AS turns FROM p WINDOW w AS (PARTITION BY doc_id, para ORDER BY i))
SELECT doc_id, CAST(para AS BIGINT) AS para, CAST(count(*) FILTER (WHERE turns) AS BIGINT) AS runs,
       md5(string_agg(CASE WHEN next IS NULL THEN line WHEN regexp_matches(line, '\p{L}-$') AND regexp_matches(next, '^\p{Ll}') THEN left(line, -1) ELSE line || ' ' END, '' ORDER BY i)) AS text_md5 FROM n GROUP BY doc_id, para""",
    "binding_assign": f"""
WITH RECURSIVE s AS (SELECT c_nationkey, c_custkey, c_custkey % 4 = 0 AS covered, list_transform(range(9), lambda i: (h % 9 + i * (1 + (h >> 8) % 8)) % 9) AS walk,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM (SELECT *, {_FNV} AS h FROM customer)),
f AS (SELECT c_nationkey, c_custkey, rn, s.walk[1] AS pick, CASE WHEN covered THEN [] ELSE [({_FAMILIES})[s.walk[1] + 1]] END AS recent FROM s WHERE rn = 1
  UNION ALL SELECT s.c_nationkey, s.c_custkey, s.rn, {_PICK}, CASE WHEN s.covered THEN recent ELSE list_prepend(({_FAMILIES})[{_PICK} + 1], recent[1:1]) END
  FROM f JOIN s ON s.c_nationkey = f.c_nationkey AND s.rn = f.rn + 1)
SELECT c_nationkey, c_custkey, ({_NAMES})[pick + 1] AS binding, ({_FAMILIES})[pick + 1] AS family FROM f""",
    "line_cluster": """
WITH RECURSIVE s AS (SELECT l_orderkey, l_quantity AS y, l_tax * 100 AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey) AS rn FROM lineitem),
f AS (SELECT l_orderkey, rn, 0 AS line, y AS first FROM s WHERE rn = 1
  UNION ALL SELECT s.l_orderkey, s.rn, CASE WHEN abs(y - first) > greatest(2.0::DOUBLE, 0.45::DOUBLE * size) THEN line + 1 ELSE line END,
    CASE WHEN abs(y - first) > greatest(2.0::DOUBLE, 0.45::DOUBLE * size) THEN y ELSE first END FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.rn = f.rn + 1)
SELECT l_orderkey, CAST(max(line) + 1 AS BIGINT) AS lines, count(*) AS items FROM f GROUP BY l_orderkey""",
    "breaker_state": f"""
WITH RECURSIVE e AS (SELECT user_id, us, event_id, event_type = 'error' AS failed, coalesce(value > 90, FALSE) AS account FROM {_E}),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM e),
f AS (SELECT user_id, 0::BIGINT AS us, -1::BIGINT AS event_id, 0::BIGINT AS rn, 0::BIGINT AS consecutive, 0::BIGINT AS opens, FALSE AS fatal, 0::BIGINT AS blocked FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, us, event_id, rn, c, o, g, CASE WHEN failed THEN least(greatest(CASE WHEN blocked > us THEN blocked ELSE 0 END,
      CASE WHEN account THEN us + 21600000000 WHEN c >= 3 THEN us + least(CAST(120000000 * pow(2, least(o - 1, 40)) AS HUGEINT), 3600000000) ELSE us + 60000000 END), us + 3024000000000) ELSE 0 END
  FROM (SELECT s.user_id, s.us, s.event_id, s.rn, s.failed, s.account, f.blocked, CASE WHEN NOT s.failed THEN 0 WHEN s.account THEN f.consecutive ELSE f.consecutive + 1 END AS c,
      CASE WHEN NOT s.failed THEN 0 WHEN NOT s.account AND f.consecutive + 1 >= 3 THEN f.opens + 1 ELSE f.opens END AS o, s.failed AND s.account AS g
      FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1))
SELECT user_id, us, event_id, CASE WHEN blocked = 0 THEN 'closed' WHEN fatal OR consecutive >= 3 THEN 'open' ELSE 'cooldown' END AS state, consecutive, blocked AS blocked_until FROM f WHERE rn > 0""",
    "greedy_batches": _recursive(
        "(SELECT conv_id, turn, CAST(length(text) + 21 AS BIGINT) AS n FROM conversations)", "conv_id", "turn", "n",
        "0::BIGINT AS batch, n AS held, 1 AS c", f"CASE WHEN {_CUT} THEN batch + 1 ELSE batch END, CASE WHEN {_CUT} THEN s.n ELSE held + s.n END, CASE WHEN {_CUT} THEN 1 ELSE c + 1 END", "batch",
    ),
    "chapter_groups": _recursive(
        "(SELECT source, doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS segments FROM documents)", "source", "doc_id", "",
        "0::BIGINT AS g, chars AS hc, segments AS hs, 1 AS c",
        f"CASE WHEN {_GCUT} THEN g + 1 ELSE g END, CASE WHEN {_GCUT} THEN s.chars ELSE hc + s.chars END, CASE WHEN {_GCUT} THEN s.segments ELSE hs + s.segments END, CASE WHEN {_GCUT} THEN 1 ELSE c + 1 END",
        'g AS "group"',
    ),
    "word_cuts": _recursive(
        f"(SELECT source, doc_id, {sql_words('text')} AS w FROM documents)", "source", "doc_id", "",
        "0::BIGINT AS part, w AS held", "CASE WHEN held >= 3500 THEN part + 1 ELSE part END, CASE WHEN held >= 3500 THEN s.w ELSE held + s.w END", "part",
    ),
    "token_window_60s": f"""
SELECT event_id, CAST(sum(tokens) OVER w AS BIGINT) AS used, count(*) OVER w AS requests FROM {_E} WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)""",
    "quota_left": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(CASE WHEN bool_or(event_type = 'error') THEN 0 ELSE greatest(0, 12 - count(*)) END AS BIGINT) AS left FROM events GROUP BY 1, 2",
    "quota_daily_tz": f"SELECT user_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM {_E} GROUP BY 1, 2",
    "hold_sessions": f"""
SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 7200000000 THEN 0 ELSE 1 END AS n FROM {_E})) GROUP BY user_id, s""",
    "daily_preview_limit": """
SELECT user_id, day, event_id FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'click') WHERE r <= 2""",
    "review_reset": """
SELECT lang, count(*) FILTER (WHERE r) AS reset, CAST(sum(CASE WHEN r THEN 0 ELSE length(text) END) AS BIGINT) AS kept_chars
FROM (SELECT lang, text, coalesce(quality, 1) = 0 AND d.doc_id % 5 <> 0 AS r FROM documents d LEFT JOIN labels USING (doc_id)) GROUP BY lang""",
    "retry_waits": """
SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(max(least(15000 * pow(2, l_linenumber - 1), 300000)) AS BIGINT) AS wait_ms, CAST(max(least(900000 * pow(2, l_linenumber), 21600000)) AS BIGINT) AS service_ms FROM lineitem GROUP BY l_linenumber""",
    "next_resets": """
SELECT user_id, CAST(epoch(date_trunc('day', t - INTERVAL 8 HOUR) + INTERVAL 32 HOUR) AS BIGINT) AS pacific, CAST(epoch(date_trunc('day', t) + INTERVAL 1 DAY) AS BIGINT) AS utc_day,
       CAST(epoch(date_trunc('month', t) + INTERVAL 1 MONTH) AS BIGINT) AS utc_month FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id)""",
    "order_states": """
SELECT state, count(*) AS orders, CAST(sum(CASE WHEN state = 'refund' THEN paid END) AS DOUBLE) AS refunded FROM (SELECT paid, CASE WHEN paid IS NULL THEN 'open' WHEN paid + 0.005 >= o_totalprice::DECIMAL(18,2) THEN 'confirmed' ELSE 'refund' END AS state
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS paid FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) GROUP BY state""",
}
