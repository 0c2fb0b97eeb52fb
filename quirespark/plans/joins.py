"""Interval, containment, precedence and dedup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import text as tx
from quirespark.operators import glossary as gl
from quirespark.operators import intervals as iv
from quirespark.operators import language as lg
from quirespark.plans.text import sql_words
from quirespark.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "src"))
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), "src")


def _splits(lines: DataFrame) -> DataFrame:
    """Lines of at most 3 words are the table of contents."""
    return lines.where((tx.word_count(F.col("src")) <= 3) & tx.has_meaning(F.col("src"))).select(
        "doc_id", F.col("i").alias("start"), F.col("src").alias("title"), (F.length("src") % 3).cast("long").alias("depth"), F.col("i").alias("pos")
    )


def chapter_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, W6."""
    lines = _lines(spark, sf_dir)
    return iv.build_intervals(_splits(lines), lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id")


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and segments of each chapter; cuts are lines, so one sort does without the join."""
    src = F.col("src")
    lines = _lines(spark, sf_dir).select("doc_id", "i", tx.word_count(src).alias("words"), (tx.has_meaning(src) & (F.length(src) % 3 <= 1)).alias("fit"))
    inside = iv.sections(lines, "doc_id", "i", F.col("fit") & (F.col("words") <= 3))
    return inside.groupBy("doc_id", "start").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("segments"))


def asof_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last purchase before or at it."""
    events = table(spark, sf_dir, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return iv.carry_forward(events, "user_id", ["ts", "event_id"], "bought", "last_purchase").select("event_id", "user_id", "last_purchase")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary: the first two words of each benchmark item, of every third its first word, as they stand there, by the first item that has it."""
    size = F.when(F.col("item_id") % 3 == 0, 0).otherwise(1)
    words = F.array_join(F.regexp_extract_all(F.regexp_extract("text", r"\p{L}{3,} +\p{L}{3,}", 0), F.lit(r"\p{L}+"), F.lit(0)), " ")
    term = F.when(size == 0, F.substring_index(words, " ", 1)).otherwise(words)
    first = table(spark, sf_dir, "benchmark").select(term.alias("term"), F.col("item_id").alias("pos"))
    once = first.where("term <> ''").groupBy("term").agg(F.min("pos").alias("pos"))
    return once.withColumn("origin", F.when(F.col("pos") % 4 == 0, "user").otherwise("auto"))


def _all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary: all words of three letters or more of each benchmark item and all two such neighbours, as they stand there, by the first item that has it."""
    runs = F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+(?: +\p{L}+)*"), F.lit(0)), lambda r: F.split(r, " +"))
    long = lambda w: F.length(w) >= 3
    both = lambda a, b: F.when(long(a) & long(b), F.concat(a, F.lit(" "), b))
    two = F.flatten(F.transform(runs, lambda ws: F.zip_with(ws, F.slice(ws, 2, F.size(ws)), both)))
    words = F.concat(F.filter(F.flatten(runs), long), F.filter(two, F.isnotnull))
    found = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term"), F.col("item_id").alias("pos"))
    return found.groupBy("term").agg(F.min("pos").alias("pos")).withColumn("origin", F.when(F.col("pos") % 4 == 0, "user").otherwise("auto"))


def glossary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, J5, J6."""
    found = gl.matches(table(spark, sf_dir, "documents"), _all_terms(spark, sf_dir), "doc_id")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.max("score").alias("score"))


def glossary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5."""
    found = gl.matches(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), "doc_id")
    return gl.top_entries(found, "doc_id", 5).select("doc_id", "rank", "term", "score")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where("c_acctbal < 2000").select(
        F.concat(F.lit("  "), F.upper("c_name")).alias("term"), F.col("c_mktsegment").alias("translation"), F.lit("auto").alias("origin")
    )


def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, U7."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("term"), F.col("c_mktsegment").alias("translation"), F.col("c_custkey").alias("pos"))
    twice = c.unionByName(c.select(F.upper("term").alias("term"), "translation", (F.col("pos") + 1_000_000).alias("pos")))
    return gl.merge_candidates(_entries(spark, sf_dir), twice).select("key", "term", "pos")


def glossary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, H6."""
    changes = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("term"), F.lit("changed").alias("translation"))
    return gl.upsert(_entries(spark, sf_dir), changes)


def toc_label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the list first, names of other keys after them."""
    part = table(spark, sf_dir, "part")
    labels = part.where("p_size <= 25").select("p_partkey", F.upper("p_name").alias("label"))
    rest = part.select("p_partkey", F.col("p_name").alias("label")).join(labels.select("p_partkey"), "p_partkey", "left_anti")
    return labels.unionByName(rest)


def fill_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document rebuilt with its translated lines, the source where there is none."""
    lines = _lines(spark, sf_dir).withColumn("out", F.when(F.col("i") % 2 == 0, F.concat(F.lit("» "), "src")))
    parts = F.array_sort(F.collect_list(F.struct("i", F.coalesce("out", "src").alias("t"))))
    return lines.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), "\n")).alias("text_md5"))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document with each text stands for the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return docs.join(first, "h").select("doc_id", "first_id", "copies")


def repeated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal outputs (whole lines, white space and case apart) of at least two different documents."""
    lines = _lines(spark, sf_dir).select("doc_id", F.lower(F.regexp_replace(F.regexp_replace("src", r"^\s+|\s+$", ""), r"\s+", " ")).alias("out"))
    groups = lines.where(F.length("out") >= 20).groupBy(F.md5("out").alias("out_md5")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("sources"))
    return groups.where("sources >= 2").select("out_md5", (F.col("rows") - 1).alias("cases"), "sources")


def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first service in each user's order that is not blocked, else when the first one is free again."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    now = events.agg(F.max("us").alias("now"))
    last = events.groupBy("user_id", "event_type").agg(F.max("us").alias("at"), F.count(F.lit(1)).alias("n"))
    until = last.join(F.broadcast(now)).select(  # one row
        "user_id", "event_type", (F.col("at") + F.col("n") * 3_600_000_000).alias("until"), "now"
    )
    free = F.col("until") <= F.col("now")
    routed = until.groupBy("user_id").agg(
        F.min_by("event_type", F.when(free, F.struct("event_type"))).alias("provider"), F.min(F.when(~free, F.col("until"))).alias("retry_us")
    )
    return routed.select("user_id", "provider", F.when(F.col("provider").isNull(), F.col("retry_us")).alias("retry_us"))


def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words vote for a language; the declared one wins ties."""
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    votes = docs.select("doc_id", "lang", *(_votes(words, ws).alias(code) for code, ws in FUNCTION_WORDS.items()))
    best = F.greatest(*FUNCTION_WORDS)
    guess = F.when(best == 0, F.col("lang"))
    for code in FUNCTION_WORDS:
        guess = guess.when((F.col("lang") == code) & (F.col(code) == best), code)
    for code in FUNCTION_WORDS:
        guess = guess.when(F.col(code) == best, code)
    return votes.select("doc_id", "lang", guess.alias("guess"), best.cast("long").alias("votes"))


#: Function words of each language; enough to tell these four apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu den dem des auf sich".split(),
    "en": "the and of to is that it was for with as be this are on".split(),
    "es": "el los las que del se con por para una su al como no es".split(),
    "fr": "le les des et est dans une du que pour pas sur au par qui".split(),
}


def _votes(words, known):
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def ngram_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4, Q12: benchmark items whose 6-word runs a document repeats, with the covered share of runs."""
    # a run is two hashes of its words, 128 bits; the benchmark's runs are few, so Spark sends them to the documents when they are small,
    # and what repeats is merged among the hits, not within the texts
    run = ", ".join(f"t[i + {k}]" for k in range(6))
    grams = lambda least: F.expr(f"transform(array(w), t -> if(size(t) < {least}, array(), transform(sequence(0, size(t) - 6), i -> struct(xxhash64({run}) AS a, xxhash64(7, {run}) AS b))))[0]")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")
    items = table(spark, sf_dir, "benchmark").select("item_id", words).select("item_id", F.explode(grams(12)).alias("gram")).distinct()
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", words).select("doc_id", F.explode(grams(6)).alias("gram"))
    hits = docs.join(items, "gram").distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "item_id")
    return hits.where(F.col("shared") * 2 >= F.col("n")).select("doc_id", "item_id", "shared", "n")


def language_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All languages for each document by trigram distance, from profiles counted over all documents."""
    docs = table(spark, sf_dir, "documents")
    return lg.ranked(docs, lg.profiles(docs)).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"), "distance", F.round("score", 9).alias("score"))


def language_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 200 characters or more by their trigrams, others by what they declare."""
    docs = table(spark, sf_dir, "documents")
    found = lg.detected(docs, lg.profiles(docs), F.col("lang")).withColumnRenamed("doc_id", "id")
    return docs.join(found, F.col("doc_id") == F.col("id")).select("doc_id", "lang", "language")


def offer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every service level for each customer nation, a small cross product."""
    levels = spark.createDataFrame([("gratis", 1), ("padrao", 2), ("premium", 3)], "level string, factor long")
    nations = table(spark, sf_dir, "nation")
    return nations.crossJoin(F.broadcast(levels)).select("n_nationkey", "level", (F.col("n_nationkey") * F.col("factor")).cast("long").alias("words"))  # three rows


def last_in_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters numbered within their document, and which is the last."""
    chapters = chapter_intervals(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("start")
    return chapters.select("doc_id", "start", F.row_number().over(w).cast("long").alias("number"), F.lead("start").over(w).isNull().cast("int").alias("is_last"))


QUERIES = {
    f.__name__: f
    for f in (
        chapter_intervals, interval_join, asof_block, glossary_match, glossary_topk, glossary_merge, glossary_upsert, toc_label_precedence,
        fill_skeleton, dedup_first, repeated_outputs, provider_route, language_guess, language_ranking, language_detected, ngram_echo, offer_rows, last_in_doc,
    )
}
_L = "(SELECT doc_id, unnest(l) AS src, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_CH = rf"""lines AS (SELECT * FROM {_L}), sizes AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
cuts AS (SELECT doc_id, i AS start, src AS title, CAST(length(src) % 3 AS BIGINT) AS depth FROM lines
         WHERE {sql_words('src')} <= 3 AND regexp_matches(src, '[\p{{L}}\p{{N}}]') AND length(src) % 3 <= 1),
allcuts AS (SELECT * FROM cuts UNION ALL SELECT doc_id, 0, NULL, 0 FROM sizes WHERE doc_id NOT IN (SELECT doc_id FROM cuts WHERE start = 0)),
ch AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS "end", title, depth FROM allcuts JOIN sizes USING (doc_id))"""
_FOLD = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"
_TERMS = r"""terms AS (SELECT t AS term, min(item_id) AS pos
  FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN split_part(w, ' ', 1) ELSE w END AS t
        FROM (SELECT item_id, regexp_replace(regexp_extract(text, '\p{L}{3,} +\p{L}{3,}', 0), ' +', ' ') AS w FROM benchmark)) WHERE t <> '' GROUP BY 1)"""
_ALL_TERMS = r"""runs AS (SELECT item_id, string_split_regex(run, ' +') AS w FROM (SELECT item_id, unnest(regexp_extract_all(text, '\p{L}+(?: +\p{L}+)*')) AS run FROM benchmark)),
terms AS (SELECT t AS term, min(item_id) AS pos FROM (SELECT item_id, unnest(list_filter(w, lambda x: length(x) >= 3)) AS t FROM runs
  UNION ALL SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM runs) WHERE length(w[i]) >= 3 AND length(w[i + 1]) >= 3) GROUP BY 1)"""
#: Words between blanks, of two neighbours the end of the first and the beginning of the second; joined to terms by equality.
_MATCH = rf"""{_TERMS}, ends AS (SELECT term, pos, lower(split_part(term, ' ', 1)) AS one, lower(split_part(term, ' ', 2)) AS two FROM terms),
forms AS (SELECT term, pos, one || s AS one, '' AS two FROM ends, (VALUES (''), ('s'), ('es')) AS f(s) WHERE two = ''
          UNION ALL SELECT term, pos, one, two || s FROM ends, (VALUES (''), ('s'), ('es')) AS f(s) WHERE two <> ''),
parts AS (SELECT doc_id, string_split({_FOLD.format('text')}, ' ') AS p FROM documents),
near AS (SELECT DISTINCT doc_id, regexp_extract(p[i], '([\p{{L}}\p{{N}}]+)$', 1) AS one, regexp_extract(p[i + 1], '^([\p{{L}}\p{{N}}]+)', 1) AS two FROM (SELECT *, unnest(range(1, len(p))) AS i FROM parts)),
word AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS one, '' AS two FROM documents),
named AS (SELECT term, pos, unnest(string_split(term, ' ')) AS name FROM terms),
own AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS name FROM documents),
hit AS (SELECT doc_id, term, pos, 3 AS s FROM near JOIN forms USING (one, two) WHERE one <> '' AND two <> '' UNION ALL SELECT doc_id, term, pos, 3 FROM word JOIN forms USING (one, two)
        UNION ALL SELECT doc_id, term, pos, 2 FROM own JOIN named USING (name) WHERE length(name) >= 4 AND regexp_matches(name, '^\p{{Lu}}') AND lower(name) NOT IN ({", ".join(f"'{w}'" for w in gl.STOP)})),
found AS (SELECT doc_id, term, pos, CAST(max(s) + CAST(pos % 4 = 0 AS INT) AS BIGINT) AS score FROM hit GROUP BY doc_id, term, pos)"""
_VOTE = {c: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in ws) + ")))" for c, ws in FUNCTION_WORDS.items()}
_GRAMS = r"""t AS (SELECT doc_id, lang, length(text) AS chars, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ' AS s FROM documents),
g AS (SELECT doc_id, lang, substr(s, i, 3) AS gram FROM (SELECT doc_id, lang, s, unnest(range(1, length(s) - 1)) AS i FROM t WHERE length(s) > 2)),
own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS place FROM g GROUP BY doc_id, gram QUALIFY place <= 300),
prof AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS place FROM g WHERE lang <> '' GROUP BY lang, gram QUALIFY place <= 300),
d AS (SELECT doc_id, l.lang, CAST(sum(coalesce(abs(own.place - prof.place), 300)) AS BIGINT) AS distance, count(*) AS n
      FROM own CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof ON prof.lang = l.lang AND prof.gram = own.gram GROUP BY doc_id, l.lang),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS rank, min(distance) OVER (PARTITION BY doc_id) AS least FROM d)"""
ORACLES = {
    "language_ranking": f"""WITH {_GRAMS} SELECT doc_id, lang, rank, distance, CASE WHEN n * 300 = least THEN 1 ELSE round(1 - (distance - least)::DOUBLE / (n * 300 - least), 9) END AS score FROM r""",
    "language_detected": f"""WITH {_GRAMS} SELECT t.doc_id, t.lang, CASE WHEN chars >= 200 THEN coalesce(r.lang, t.lang) ELSE t.lang END AS language
FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND rank = 1""",
    "chapter_intervals": f'WITH {_CH} SELECT doc_id, start, "end", title, depth FROM ch',
    "interval_join": f"""WITH {_CH} SELECT ch.doc_id, start, CAST(sum({sql_words('src')}) AS BIGINT) AS words, count(*) AS segments
FROM lines JOIN ch ON lines.doc_id = ch.doc_id AND i >= start AND i < "end" GROUP BY ALL""",
    "asof_block": """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""",
    "glossary_match": f"WITH {_MATCH.replace(_TERMS, _ALL_TERMS)} SELECT term, count(*) AS docs, max(score) AS score FROM found GROUP BY term",
    "glossary_topk": f"WITH {_MATCH} SELECT doc_id, rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM found) WHERE rank <= 5",
    "glossary_merge": f"""
WITH e AS (SELECT {_FOLD.format("upper(c_name)")} AS key FROM customer WHERE c_acctbal < 2000),
c AS (SELECT c_name AS term, c_custkey AS pos FROM customer UNION ALL SELECT upper(c_name), c_custkey + 1000000 FROM customer)
SELECT {_FOLD.format('term')} AS key, arg_min(term, pos) AS term, min(pos) AS pos FROM c WHERE {_FOLD.format('term')} NOT IN (SELECT key FROM e) GROUP BY 1""",
    "glossary_upsert": f"""
SELECT coalesce(o.key, n.key) AS key, coalesce(o.term, n.term) AS term, coalesce(n.translation, o.translation) AS translation, CASE WHEN n.key IS NOT NULL THEN 'user' ELSE 'auto' END AS origin
FROM (SELECT {_FOLD.format("upper(c_name)")} AS key, '  ' || upper(c_name) AS term, c_mktsegment AS translation FROM customer WHERE c_acctbal < 2000) o
FULL JOIN (SELECT {_FOLD.format("c_name")} AS key, c_name AS term, 'changed' AS translation FROM customer WHERE c_mktsegment = 'BUILDING') n ON o.key = n.key""",
    "toc_label_precedence": "SELECT p_partkey, CASE WHEN p_size <= 25 THEN upper(p_name) ELSE p_name END AS label FROM part",
    "fill_skeleton": f"SELECT doc_id, md5(string_agg(CASE WHEN i % 2 = 0 THEN '» ' || src ELSE src END, chr(10) ORDER BY i)) AS text_md5 FROM {_L} GROUP BY doc_id",
    "dedup_first": "SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)",
    "repeated_outputs": """
SELECT md5(out) AS out_md5, count(*) - 1 AS cases, count(DISTINCT doc_id) AS sources
FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(src, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS out FROM """ + _L + """) WHERE length(out) >= 20 GROUP BY out HAVING count(DISTINCT doc_id) >= 2""",
    "provider_route": """
WITH u AS (SELECT user_id, event_type, epoch_us(max(ts)) + count(*) * 3600000000 AS until, (SELECT epoch_us(max(ts)) FROM events) AS now FROM events GROUP BY ALL)
SELECT user_id, min(event_type) FILTER (WHERE until <= now) AS provider,
       CASE WHEN count(*) FILTER (WHERE until <= now) = 0 THEN min(until) END AS retry_us FROM u GROUP BY user_id""",
    "language_guess": f"""
SELECT doc_id, lang, CASE WHEN b = 0 THEN lang WHEN (lang = 'de' AND de = b) OR (lang = 'en' AND en = b) OR (lang = 'es' AND es = b) OR (lang = 'fr' AND fr = b) THEN lang
       WHEN de = b THEN 'de' WHEN en = b THEN 'en' WHEN es = b THEN 'es' ELSE 'fr' END AS guess, CAST(b AS BIGINT) AS votes
FROM (SELECT *, greatest(de, en, es, fr) AS b FROM (SELECT doc_id, lang, {', '.join(f'{v} AS {c}' for c, v in _VOTE.items())} FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents)))""",
    "ngram_echo": r"""
WITH i AS (SELECT item_id, list_distinct(list_transform(range(1, CAST(len(w) - 4 AS BIGINT)), lambda k: array_to_string(w[k:k + 5], ' '))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 12),
d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, CAST(len(w) - 4 AS BIGINT)), lambda k: array_to_string(w[k:k + 5], ' ')))) AS gram FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) WHERE len(w) >= 6)
SELECT doc_id, item_id, count(*) AS shared, n FROM d JOIN (SELECT item_id, CAST(len(g) AS BIGINT) AS n, unnest(g) AS gram FROM i) USING (gram) GROUP BY doc_id, item_id, n HAVING count(*) * 2 >= n""",
    "offer_rows": "SELECT n_nationkey, level, CAST(n_nationkey * f AS BIGINT) AS words FROM nation, (VALUES ('gratis', 1), ('padrao', 2), ('premium', 3)) AS l(level, f)",
    "last_in_doc": f"WITH {_CH} SELECT doc_id, start, row_number() OVER w AS number, CAST(lead(start) OVER w IS NULL AS INT) AS is_last FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY start)",
}
