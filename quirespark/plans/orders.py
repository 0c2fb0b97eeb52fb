"""Order states, coverage of paid orders, price floors, wallets and lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import pricing as pr
from quirespark.functions import text as tx
from quirespark.plans.text import sql_words
from quirespark.session import table

#: Services that cost nothing; an unknown one counts as paid.
FREE_SERVICES = ["gemini", "groq"]


def by_free_service(by: Column) -> Column:
    """Made by a free service; ``by`` is service/model. False for null."""
    return F.coalesce(F.substring_index(by, "/", 1).isin(FREE_SERVICES), F.lit(False))


def paid_order_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words a paid order covers; a free one covers what is left."""
    by = F.when(F.col("l_returnflag") == "A", "gemini/flash").when(F.col("l_returnflag") == "N", "anthropic/haiku")
    has_out = (F.col("l_linestatus") == "F") | (F.col("l_linenumber") % 2 == 1)
    to_do = ~has_out | ((F.col("l_linenumber") != 5) & by_free_service(by))
    words = F.col("l_quantity").cast("long")
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(to_do, words).otherwise(0)).alias("paid_words"), F.greatest(F.lit(0), F.sum(words) - F.sum(F.when(has_out, words).otherwise(0))).alias("remaining")
    )
    return o.select("*", F.when(F.col("l_orderkey") % 3 == 0, F.col("remaining")).otherwise(F.col("paid_words")).alias("covered"))


def order_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders confirmed as free, begun as free or of the paid level, by status label."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "literaria").otherwise("padrao").alias("level"),
        F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "awaiting_payment").otherwise("canceled").alias("status"),
        (k % 4 == 0).alias("beta"), F.when(k % 5 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("price"), (k % 7 == 0).alias("replaces"),
    )
    free = F.col("level") == "padrao"
    legacy = free & (F.col("status") == "paid") & F.col("beta")
    confirmed = (F.col("status") == "paid") & free & ((F.col("price") == 0) | legacy)
    begun = confirmed | ((F.col("status") == "awaiting_payment") & F.col("replaces"))
    label = F.when(F.col("status") == "paid", "pago").when(F.col("status") == "awaiting_payment", "aguardando").otherwise("cancelado")
    return o.groupBy(label.alias("label")).agg(
        F.count_if(legacy).alias("legacy"), F.count_if(confirmed).alias("confirmed_free"), F.count_if(begun).alias("started_free"),
        F.count_if((F.col("status") != "canceled") & ~free).alias("paid_level"), F.count_if(free).alias("free_books"),
    )


def price_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst cost of each region's qualities and the least price of a credit at half margin."""
    known = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    q = s.groupBy("n_regionkey", "n_nationkey").agg(F.coalesce(F.max(known), F.lit(0.0)).alias("worst"), F.coalesce(F.min(known), F.lit(0.0)).alias("expected"))
    per_credit = F.col("worst") / (F.col("n_nationkey") % 4 + 1)
    return q.groupBy("n_regionkey").agg(
        F.max("worst").alias("worst"), F.max("expected").alias("expected"), (F.max(per_credit) / F.lit(pr.NET * 0.5)).alias("least_price")
    )


def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans and packs in one list with the price of a credit, infinite without credits."""
    plans = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("price"), (F.col("s_suppkey") % 5).alias("credits"), F.lit("plan").alias("kind"))
    packs = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("long").alias("credits"), F.lit("pack").alias("kind"))
    each = F.coalesce(F.try_divide("price", "credits"), F.lit(float("inf")))
    return plans.unionByName(packs).select("kind", "name", each.alias("per_credit"))


def toc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels take translations by position, but only where there are as many of both."""
    side = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", F.col("text").alias("t")))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("user").alias("u"), side("assistant").alias("a"))
    joined = F.array_join(F.zip_with("u", "a", lambda x, y: F.concat(x["t"], F.lit("="), y["t"])), "|")
    return c.select("conv_id", F.size("u").cast("long").alias("labels"), F.md5(F.when(F.size("u") == F.size("a"), joined).otherwise("")).alias("zipped_md5"))


def finished_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output of the heading that equals the title, else of the first heading; a saved one stands."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.first("text").over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("title"))
    heading = (F.length("text") < 400) & (F.col("turn") > 0)
    best = F.min_by(F.reverse("text"), F.when(heading, F.struct(F.col("text") != F.col("title"), F.col("turn"))))
    found = t.groupBy("conv_id").agg(best.alias("out"))
    return found.select("conv_id", F.md5(F.when(F.col("conv_id") % 5 == 0, "Saved").otherwise(F.substring("out", 1, 160))).alias("title_md5"))


def single_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch has a summary of its own only if it has one title."""
    one = F.when(F.count_distinct("o_orderpriority") == 1, F.min("o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(one.alias("title"), F.count(F.lit(1)).alias("n"))


def glossary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by type in a fixed order, empty types left out, the first three of each shown."""
    kinds = F.array(*map(F.lit, ("person", "place", "title", "other")))
    kind = F.element_at(kinds, (F.col("n_nationkey") * 7 % 3 + 1).cast("int"))
    g = table(spark, sf_dir, "nation").select(kind.alias("kind"), "n_name").groupBy("kind").agg(F.array_sort(F.collect_list("n_name")).alias("terms"))
    return g.select(F.array_position(kinds, F.col("kind")).alias("place"), "kind", F.size("terms").cast("long").alias("n"), F.array_join(F.slice("terms", 1, 3), ",").alias("shown"))


def spine_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part is in the manifest, numbered anew in their order."""
    manifest = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    spine = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(manifest, F.col("l_partkey") == F.col("p_partkey"))
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return spine.select("l_orderkey", "l_partkey", "l_suppkey", at.cast("long").alias("place"))


def book_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown title, stage and advertisement place of each book."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(k % 3 == 0, "translating").when(k % 3 == 1, "queued").otherwise("ready")
    o = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), (k % 4 == 0).alias("review"), (k % 5).alias("done_words"))
    title = F.when((F.col("status") == "done") & (k % 2 == 0), F.concat(F.lit("Livro "), k.cast("string"))).otherwise(F.concat(F.lit("Book "), k.cast("string")))
    stage = (
        F.when(F.col("status") == "done", 4)
        .when(F.col("status") == "translating", F.when(F.col("review"), 3).otherwise(2))
        .when(F.col("status") == "queued", 1)
        .otherwise(F.when(F.col("done_words") > 0, 2).otherwise(1))
    )
    ad = F.when(F.col("status").isin("queued", "analyzing", "translating"), "traduzindo").when(F.col("status") == "done", "pronto")
    return o.select("o_orderkey", title.alias("title"), stage.cast("long").alias("stage"), ad.alias("ad"))


def credit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose credits do not suffice, what they need and how many words the credits cover."""
    per_1k = F.when(F.col("l_orderkey") % 2 == 0, pr.CREDITS_PER_1K["literario"]).otherwise(pr.CREDITS_PER_1K["padrao"]).cast("long")
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity").cast("long") * 100).alias("words"))
    c = o.select("l_orderkey", (F.col("words") * per_1k).alias("needed"), (F.col("l_orderkey") % 40 * 1000).alias("free"), per_1k.alias("per_1k"))
    short = c.where("free < needed")
    return short.select(
        "l_orderkey", F.ceil(F.col("needed") / F.lit(1000.0)).cast("long").alias("needed"), F.floor(F.col("free") / F.lit(1000.0)).cast("long").alias("available"),
        F.floor(F.col("free").cast("double") / F.col("per_1k")).cast("long").alias("cover_words"), (F.col("free") >= F.col("per_1k") * 50).cast("int").alias("partial"),
    )


def cost_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: low and high cost of each text; close reading for 1,000 words and more."""
    p_in, p_out = pr.MODEL_PRICES["gemini-3.8-flash"]
    d = table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).cast("double").alias("w"))
    #: Tokens a word, reading and writing factors.
    tokens = F.col("w") * F.lit(1.4)
    read = tokens * F.when(F.col("w") >= 1000, 2.6).otherwise(1.8)
    cost = lambda r, o: (read * F.lit(r) * F.lit(p_in) + tokens * F.lit(o) * F.lit(p_out)) / F.lit(1e6)
    return d.select("doc_id", cost(0.8, 1.25).alias("low"), cost(1.3, 2.4).alias("high"))


def wallet_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welcome and monthly grants at a customer's reads, expiry by the last one, a partial reservation."""
    reads = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    months = reads.groupBy("o_custkey", F.trunc("day", "month").alias("month")).agg(F.max("day").alias("day"))
    w = Window.partitionBy("o_custkey")
    lots = months.withColumn("now", F.max("day").over(w)).withColumn("first", F.min("month").over(w))
    alive = F.add_months("month", 2) > F.col("now")
    monthly = F.sum(F.when(alive, 5000).otherwise(0))
    welcome = F.max(F.when(F.add_months("first", 12) > F.col("now"), 15000).otherwise(0))
    b = lots.groupBy("o_custkey").agg((monthly + welcome).cast("long").alias("available"), F.count_if(~alive).alias("expired"))
    return b.select("*", F.least(F.col("available"), F.lit(12000).cast("long")).alias("reserved"))


def valid_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q24: terms of a JSON reply, trimmed; those without term or translation left out, unknown types other."""
    k = F.col("n_nationkey")
    item = F.struct(
        F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("term"), F.when(k % 3 == 0, "  ").otherwise(F.lower("n_name")).alias("translation"),
        F.when(k % 2 == 0, "place").otherwise("planet").alias("type"),
    )
    raw = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array(item)).alias("reply"))
    t = raw.select("n_nationkey", F.explode(F.from_json("reply", "array<struct<term:string,translation:string,type:string>>")).alias("t"))
    kind = F.when(F.col("t.type").isin("person", "place", "title", "other"), F.col("t.type")).otherwise("other")
    c = t.select("n_nationkey", F.trim("t.term").alias("term"), F.trim("t.translation").alias("translation"), kind.alias("kind"))
    return c.where("term <> '' and translation <> '' and length(term) <= 80")


def nested_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over each order's lines, weighted and of failed lines; no order's lines are gathered."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    failed = F.when(F.col("l_linestatus") == "O", q).otherwise(F.lit(0).cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q * n).alias("weighted"), F.sum(failed).alias("failed"))


def entry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's entry under the new key, else under the old one, else the default."""
    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("new"))
    old = o.where("o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("old"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return c.join(new, "o_custkey", "left").join(old, "o_custkey", "left").select(F.col("o_custkey").alias("c_custkey"), F.coalesce("new", "old", F.lit(-1)).alias("entry"))


QUERIES = {
    f.__name__: f
    for f in (
        paid_order_words, order_predicates, price_floor, catalog_items, toc_titles, finished_titles, single_title, glossary_groups, spine_order,
        book_states, credit_check, cost_ranges, wallet_refresh, valid_terms, nested_sums, entry_lookup,
    )
}
ORACLES = {
    "paid_order_words": """
SELECT l_orderkey, p AS paid_words, r AS remaining, CASE WHEN l_orderkey % 3 = 0 THEN r ELSE p END AS covered
FROM (SELECT l_orderkey, CAST(sum(CASE WHEN NOT done OR (l_linenumber <> 5 AND l_returnflag = 'A') THEN l_quantity ELSE 0 END) AS BIGINT) AS p,
             CAST(sum(CASE WHEN done THEN 0 ELSE l_quantity END) AS BIGINT) AS r
      FROM (SELECT *, l_linestatus = 'F' OR l_linenumber % 2 = 1 AS done FROM lineitem) GROUP BY l_orderkey)""",
    "order_predicates": """
SELECT label, count(*) FILTER (WHERE legacy) AS legacy, count(*) FILTER (WHERE conf) AS confirmed_free, count(*) FILTER (WHERE conf OR (label = 'aguardando' AND k % 7 = 0)) AS started_free,
       count(*) FILTER (WHERE label <> 'cancelado' AND k % 3 = 0) AS paid_level, count(*) FILTER (WHERE k % 3 <> 0) AS free_books
FROM (SELECT k, label, label = 'pago' AND k % 3 <> 0 AND k % 4 = 0 AS legacy, label = 'pago' AND k % 3 <> 0 AND (k % 5 = 0 OR p = 0 OR k % 4 = 0) AS conf
      FROM (SELECT o_orderkey AS k, o_totalprice AS p, CASE o_orderstatus WHEN 'F' THEN 'pago' WHEN 'O' THEN 'aguardando' ELSE 'cancelado' END AS label FROM orders)) GROUP BY label""",
    "price_floor": f"""
SELECT n_regionkey, max(worst) AS worst, max(expected) AS expected, max(worst / (n_nationkey % 4 + 1)) / {pr.NET * 0.5!r}::DOUBLE AS least_price
FROM (SELECT n_regionkey, n_nationkey, coalesce(max(s_acctbal) FILTER (WHERE s_acctbal > 0), 0) AS worst, coalesce(min(s_acctbal) FILTER (WHERE s_acctbal > 0), 0) AS expected
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY n_regionkey""",
    "catalog_items": """
SELECT kind, name, CASE WHEN c = 0 THEN 'Infinity'::DOUBLE ELSE p / c END AS per_credit
FROM (SELECT 'plan' AS kind, s_name AS name, s_acctbal AS p, s_suppkey % 5 AS c FROM supplier UNION ALL SELECT 'pack', p_name, p_retailprice, p_size FROM part)""",
    "toc_titles": """
SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS labels,
       md5(CASE WHEN count(*) FILTER (WHERE role = 'user') = count(*) FILTER (WHERE role = 'assistant') THEN array_to_string(list_transform(list_zip(
         coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'user'), []), coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), [])), lambda x: x[1] || '=' || x[2]), '|') ELSE '' END) AS zipped_md5
FROM conversations GROUP BY conv_id""",
    "finished_titles": """
SELECT conv_id, md5(CASE WHEN conv_id % 5 = 0 THEN 'Saved' ELSE reverse(arg_min(text, (CAST(text <> title AS INT), turn)) FILTER (WHERE length(text) < 400 AND turn > 0))[1:160] END) AS title_md5
FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS title FROM conversations) GROUP BY conv_id""",
    "single_title": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS title, count(*) AS n FROM orders GROUP BY o_custkey",
    "glossary_groups": """
SELECT CAST(n_nationkey * 7 % 3 + 1 AS BIGINT) AS place, ['person', 'place', 'title'][n_nationkey * 7 % 3 + 1] AS kind, count(*) AS n, array_to_string(list(n_name ORDER BY n_name)[1:3], ',') AS shown FROM nation GROUP BY 1, 2""",
    "spine_order": """
SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25""",
    "book_states": """
SELECT k AS o_orderkey, CASE WHEN s = 'done' AND k % 2 = 0 THEN 'Livro ' ELSE 'Book ' END || k AS title,
       CAST(CASE s WHEN 'done' THEN 4 WHEN 'translating' THEN CASE WHEN k % 4 = 0 THEN 3 ELSE 2 END WHEN 'queued' THEN 1 ELSE CASE WHEN k % 5 > 0 THEN 2 ELSE 1 END END AS BIGINT) AS stage,
       CASE s WHEN 'done' THEN 'pronto' WHEN 'ready' THEN NULL ELSE 'traduzindo' END AS ad
FROM (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'translating' WHEN o_orderkey % 3 = 1 THEN 'queued' ELSE 'ready' END AS s FROM orders)""",
    "credit_check": """
SELECT l_orderkey, CAST(ceil(words * k / 1000.0::DOUBLE) AS BIGINT) AS needed, l_orderkey % 40 AS available, CAST(floor(l_orderkey % 40 * 1000 / k::DOUBLE) AS BIGINT) AS cover_words, CAST(l_orderkey % 40 * 1000 >= k * 50 AS INT) AS partial
FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) * 100 AS words, CASE WHEN l_orderkey % 2 = 0 THEN 6 ELSE 1 END AS k FROM lineitem GROUP BY l_orderkey) WHERE l_orderkey % 40 * 1000 < words * k""",
    "cost_ranges": f"""
SELECT doc_id, (t * f * 0.8::DOUBLE * 0.75::DOUBLE + t * 1.25::DOUBLE * 3.75::DOUBLE) / 1e6 AS low, (t * f * 1.3::DOUBLE * 0.75::DOUBLE + t * 2.4::DOUBLE * 3.75::DOUBLE) / 1e6 AS high
FROM (SELECT doc_id, w * 1.4::DOUBLE AS t, CASE WHEN w >= 1000 THEN 2.6::DOUBLE ELSE 1.8::DOUBLE END AS f FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents))""",
    "wallet_refresh": """
WITH m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1, 2),
l AS (SELECT *, max(day) OVER (PARTITION BY o_custkey) AS now, min(month) OVER (PARTITION BY o_custkey) AS f FROM m),
b AS (SELECT o_custkey, CAST(count(*) FILTER (WHERE month + INTERVAL 2 MONTH > now) * 5000 + max(CASE WHEN f + INTERVAL 12 MONTH > now THEN 15000 ELSE 0 END) AS BIGINT) AS available,
             count(*) FILTER (WHERE month + INTERVAL 2 MONTH <= now) AS expired FROM l GROUP BY o_custkey)
SELECT *, least(available, 12000) AS reserved FROM b""",
    "valid_terms": "SELECT n_nationkey, n_name AS term, lower(n_name) AS translation, CASE WHEN n_nationkey % 2 = 0 THEN 'place' ELSE 'other' END AS kind FROM nation WHERE n_nationkey % 3 <> 0",
    "nested_sums": """
SELECT l_orderkey, CAST(sum(l_quantity * l_linenumber) AS BIGINT) AS weighted, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS failed FROM lineitem GROUP BY l_orderkey""",
    "entry_lookup": """
SELECT c_custkey, coalesce(max(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT'), max(o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW'), -1) AS entry FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
}
