"""Requests as texts, failures and quotas of services, quotes, previews and normal forms."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quirespark.functions import markup as mk
from quirespark.plans.costs import RUN_SQL, runs
from quirespark.session import table


def glossary_block(entries: Column) -> Column:
    """Lines of an array of (term, translation, kind, note)."""
    line = lambda e: F.concat(F.lit("- "), e["term"], F.lit(" → "), e["translation"], F.lit(" ("), e["kind"], F.lit(")"), F.coalesce(F.concat(F.lit(" — "), e["note"]), F.lit("")))
    return F.array_join(F.transform(entries, line), "\n")


def user_prompt(glossary: Column, story: Column, title: Column, summary: Column, preceding: Column, segments: Column, task: Column) -> Column:
    """A request's text: what the service should know, then its task and the segments (id, text); parts that are empty are left out."""
    within = lambda tag, text: F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>"))
    quoted = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    about = F.coalesce(F.concat(F.lit("\n"), summary, F.lit("\n")), F.lit(""))
    parts = F.array(
        F.lit("<context>"),
        F.when(F.size(glossary) > 0, within("glossary", glossary_block(glossary))),
        F.when(F.size(story) > 0, within("story_so_far", F.array_join(story, "\n"))),
        F.concat(F.lit('<current_chapter title="'), quoted, F.lit('">'), about, F.lit("</current_chapter>")),
        F.when(F.size(preceding) > 0, within("preceding_translation", F.array_join(preceding, "\n\n"))),
        F.lit("</context>"),
        F.lit(""),
        task,
        F.array_join(F.transform(segments, lambda s: F.concat(F.lit('<seg id="'), s["id"].cast("string"), F.lit('">'), s["text"], F.lit("</seg>"))), "\n"),
    )
    return F.array_join(F.array_compact(parts), "\n")


def request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each user's turn: the five turns before it as the story, the last two answers, the turn's lines as segments, its longest word as a term."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    w = Window.partitionBy("conv_id").orderBy("turn")
    head = F.concat(F.lit("- "), F.left(F.split("text", "\n", -1)[0], F.lit(40)))
    answers = F.array_compact(F.collect_list(F.when(F.col("role") != "user", F.left("text", F.lit(100)))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = c.select(
        "conv_id", "turn", "role", "text", F.collect_list(head).over(w.rowsBetween(-5, -1)).alias("story"), F.slice(F.reverse(answers), 1, 2).alias("last")
    ).where("role = 'user'")
    lines = F.split("text", "\n", -1)
    segments = F.transform(lines, lambda s, i: F.struct((i + 1).alias("id"), s.alias("text")))
    word = F.element_at(F.array_sort(F.transform(F.regexp_extract_all("text", F.lit(r"[a-z]+"), F.lit(0)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), 1)["w"]
    entry = F.struct(word.alias("term"), F.upper(word).alias("translation"), F.lit("term").alias("kind"), F.when(F.length(word) > 8, F.lit("long")).alias("note"))
    glossary = F.when(F.regexp_count("text", F.lit(r"[a-z]+")) > 0, F.array(entry)).otherwise(F.array_except(F.array(entry), F.array(entry)))
    prompt = user_prompt(glossary, F.col("story"), F.concat(F.lit('Turn "'), F.col("turn").cast("string"), F.lit('"')), F.lit(None).cast("string"), F.reverse("last"), segments, F.lit("Translate these segments into pt-BR:"))
    return rows.select("conv_id", "turn", F.md5(prompt).alias("prompt_md5"))


def failure_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each failure is noted: an exhausted quota of a free service with the quotas, of a paid one nowhere, anything else with the breakers."""
    code = F.when(F.col("value") > 80, "quota").when(F.col("value") > 60, "auth").otherwise("server")
    free = F.col("event_type") != "purchase"
    sink = F.when((code == "quota") & free, "quota").when(code != "quota", "breaker")
    failures = table(spark, sf_dir, "events").where("value > 40").select("event_id", "event_type", code.alias("code"), sink.alias("sink"))
    return failures.where("sink is not null")


def quota_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until when each user's services are exhausted, those of one provider cleared by the beginning of their key, as one map a user."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("|", "event_type", F.when(F.col("n") % 2 == 0, "large").otherwise("small"))
    until = F.when(F.col("n") >= 5, F.date_format("at", "yyyy-MM-dd"))
    kept = F.when(~(key.startswith("view|") | (key == "view")), until)
    pairs = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), kept.alias("until")))).alias("pairs"))
    quotas = F.map_from_entries("pairs")
    return pairs.select("user_id", F.to_json(F.map_filter(quotas, lambda _, v: v.isNotNull())).alias("exhausted"), F.cardinality(quotas).cast("long").alias("services"))


def quote_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders may begin with the customer's credits, wholly or for what they cover; urgent ones lie outside the plan of customers in machinery."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    credits, available = F.ceil(F.col("o_totalprice") / 50), F.greatest(F.lit(0), F.floor("c_acctbal"))
    outside = (F.col("o_orderpriority") == "1-URGENT") & (F.col("c_mktsegment") == "MACHINERY")
    whole = ~outside & (available >= credits)
    return o.select("o_orderkey", whole.cast("int").alias("whole"), (whole | (~outside & (available > 0))).cast("int").alias("partial"))


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def normal_form(text: Column) -> Column:
    """How texts are compared: composed letters, plain quotation marks, apostrophes and hyphens, single blanks, lower case."""
    plain = F.translate(_composed(text), "“”„«»‘’`—–‐", '"""""' + "'''" + "---")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def normal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: how many lines of each language's documents have one normal form."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.concat("text", F.lit("\n“Café” — d’ici")), "\n", -1)).alias("line"))
    return lines.select("lang", F.md5(normal_form(F.col("line"))).alias("form_md5")).groupBy("lang", "form_md5").agg(F.count(F.lit(1)).alias("lines"))


def preview_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: the turns 1 to 3 of each conversation beside what answers them, as a page's HTML."""
    none = F.array().cast("array<struct<k:int,name:string,opening:string,void:boolean>>")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("out")).where("turn >= 1 and turn < 4")
    html = lambda col: mk.rendered(col, none)["html"]
    return c.select("conv_id", "turn", "role", F.md5(html(F.col("text"))).alias("src_md5"), F.md5(html(F.col("out"))).alias("out_md5"))


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's requests up to the one at which its cost passes four fifths of what its quantity is worth, that one too: requests, those of models without a price, cost, and where it stopped."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "words", F.coalesce("model", F.lit(""))).rowsBetween(Window.unboundedPreceding, 0)
    spent = runs(spark, sf_dir).withColumn("c", F.coalesce("cost", F.lit(0.0)).cast("decimal(18,8)")).withColumn("spent", F.sum("c").over(w))
    ceiling = (F.sum(F.col("words").cast("double")).over(Window.partitionBy("l_orderkey")) * F.lit(0.00004)).cast("decimal(18,8)") * F.lit("0.8").cast("decimal(2,1)")
    over = spent.withColumn("over", (F.col("spent") > ceiling).cast("int"))
    before = F.coalesce(F.max("over").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ran = over.withColumn("before", before).where("before = 0")
    return ran.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.coalesce(F.col("model"), F.lit("")) == "").alias("unpriced"), F.sum("c").cast("double").alias("cost"), F.max(F.when(F.col("over") == 1, F.col("l_linenumber"))).cast("long").alias("stopped_at")
    )


QUERIES = {f.__name__: f for f in (request_prompts, failure_routes, quota_maps, quote_gates, normal_lines, preview_pairs, run_ledger)}
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLES = {
    "request_prompts": r"""
WITH c AS (SELECT *, list('- ' || left(split_part(text, chr(10), 1), 40)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS story,
       list(left(text, 100)) FILTER (WHERE role <> 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM conversations WHERE text IS NOT NULL),
w AS (SELECT *, coalesce(said, [])[greatest(1, len(coalesce(said, [])) - 1):] AS last, list_sort(list_transform(regexp_extract_all(text, '[a-z]+'), lambda x: {'n': -length(x), 'w': x}))[1].w AS word, string_split(text, chr(10)) AS l FROM c WHERE role = 'user')
SELECT conv_id, turn, md5(array_to_string(list_filter(['<context>', '<glossary>' || chr(10) || '- ' || word || ' → ' || upper(word) || ' (term)' || CASE WHEN length(word) > 8 THEN ' — long' ELSE '' END || chr(10) || '</glossary>',
  CASE WHEN len(story) > 0 THEN '<story_so_far>' || chr(10) || array_to_string(story, chr(10)) || chr(10) || '</story_so_far>' END, '<current_chapter title="Turn &quot;' || turn || '&quot;"></current_chapter>',
  CASE WHEN len(last) > 0 THEN '<preceding_translation>' || chr(10) || array_to_string(last, chr(10) || chr(10)) || chr(10) || '</preceding_translation>' END, '</context>', '', 'Translate these segments into pt-BR:',
  array_to_string(list_transform(l, lambda x, i: '<seg id="' || i || '">' || x || '</seg>'), chr(10))], lambda x: x IS NOT NULL), chr(10))) AS prompt_md5 FROM w""",
    "failure_routes": """
SELECT event_id, event_type, code, CASE WHEN code = 'quota' THEN 'quota' ELSE 'breaker' END AS sink
FROM (SELECT event_id, event_type, CASE WHEN value > 80 THEN 'quota' WHEN value > 60 THEN 'auth' ELSE 'server' END AS code FROM events WHERE value > 40) WHERE code <> 'quota' OR event_type <> 'purchase'""",
    "quota_maps": """
WITH k AS (SELECT user_id, event_type || '|' || CASE WHEN count(*) % 2 = 0 THEN 'large' ELSE 'small' END AS key, CASE WHEN count(*) >= 5 AND event_type <> 'view' THEN strftime(max(ts), '%Y-%m-%d') END AS until FROM events GROUP BY user_id, event_type)
SELECT user_id, '{' || coalesce(string_agg('"' || key || '":"' || until || '"', ',' ORDER BY key) FILTER (WHERE until IS NOT NULL), '') || '}' AS exhausted, count(*) AS services FROM k GROUP BY user_id""",
    "quote_gates": """
SELECT o_orderkey, CAST(NOT x AND a >= c AS INTEGER) AS whole, CAST(NOT x AND (a >= c OR a > 0) AS INTEGER) AS partial
FROM (SELECT o_orderkey, ceil(o_totalprice / 50) AS c, greatest(0, floor(c_acctbal)) AS a, o_orderpriority = '1-URGENT' AND c_mktsegment = 'MACHINERY' AS x FROM orders JOIN customer ON c_custkey = o_custkey)""",
    "normal_lines": r"""
SELECT lang, md5(lower(trim(regexp_replace(translate(nfc_normalize(line), '“”„«»‘’`—–‐', repeat('"', 5) || repeat('''', 3) || '---'), '\s+', ' ', 'g')))) AS form_md5, count(*) AS lines
FROM (SELECT lang, unnest(string_split(text || chr(10) || '“Cafe' || chr(769) || '” — d’ici', chr(10))) AS line FROM documents) GROUP BY ALL""",
    "preview_pairs": f"""
SELECT conv_id, turn, role, md5({_ESCAPED.format('text')}) AS src_md5, md5({_ESCAPED.format('out')}) AS out_md5
FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations) WHERE turn >= 1 AND turn < 4""",
    "run_ledger": f"""
WITH s AS (SELECT *, CAST(coalesce(cost, 0) AS DECIMAL(18,8)) AS c, sum(CAST(coalesce(cost, 0) AS DECIMAL(18,8))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, words, coalesce(model, '') ROWS UNBOUNDED PRECEDING) AS spent,
       CAST(sum(words::DOUBLE) OVER (PARTITION BY l_orderkey) * 0.00004::DOUBLE AS DECIMAL(18,8)) * CAST(0.8 AS DECIMAL(2,1)) AS top FROM {RUN_SQL}),
b AS (SELECT *, coalesce(bool_or(spent > top) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, words, coalesce(model, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM s)
SELECT l_orderkey, count(*) AS requests, count(*) FILTER (WHERE model IS NULL) AS unpriced, CAST(sum(c) AS DOUBLE) AS cost, CAST(max(CASE WHEN spent > top THEN l_linenumber END) AS BIGINT) AS stopped_at FROM b WHERE NOT before GROUP BY l_orderkey""",
}
