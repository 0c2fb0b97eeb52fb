"""What a reader's shelf and its forms show: ids, labels, set-ups, services, samples, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import markup as mk
from quirespark.functions import text as tx
from quirespark.operators import intervals as iv
from quirespark.operators import samples
from quirespark.plans.text import sql_words
from quirespark.session import table

#: Names of the documents' languages.
LANGUAGES = {"en": "Inglês", "de": "Alemão", "es": "Espanhol", "fr": "Francês"}


def local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation that wait for an answer, numbered from 1, and back."""
    waiting = table(spark, sf_dir, "conversations").where("role = 'user'")
    return waiting.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("id"), "turn")


def foreign_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: of each order's suppliers those that are known and in business but of another nation than the customer; unknown ones pass."""
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    home = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    known = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select("s_suppkey", "s_nationkey")
    found = asked.join(known, F.col("l_suppkey") == F.col("s_suppkey")).join(home, F.col("l_orderkey") == F.col("o_orderkey")).where("s_nationkey <> c_nationkey")
    return found.select("l_orderkey", "l_suppkey")


def excluded_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: the services that each user's events have ruled out so far, by a value above 90."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.array_sort(F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).over(w))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(gone, ",").alias("excluded"))


def brl(amount: Column) -> Column:
    """Reais as Brazil writes them, with a space that doesn't break."""
    number = F.translate(F.format_number(F.abs(amount), 2), ",.", ".,")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("R$ "), number)


def credit_count(n: Column) -> Column:
    return F.concat(F.translate(F.format_number(n, 0), ",", "."), F.when(n == 1, " crédito").otherwise(" créditos"))


def money_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as money, as prices (nothing is without cents) and as credits."""
    v = F.when(F.col("c_acctbal").between(0, 100), 0.0).otherwise(F.col("c_acctbal"))
    price = F.when(v == 0, F.lit("R$ ") + "0" if False else F.lit("R$ 0")).otherwise(brl(v))
    return table(spark, sf_dir, "customer").select("c_custkey", brl(F.col("c_acctbal")).alias("money"), price.alias("price"), credit_count(F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100)).cast("long")).alias("credits"))


def shelf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each source's books of a language: the line of languages, how many they are, and what is read out of the first one."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.lit(None).cast("string").alias("author"), F.left(F.split("text", "\n", -1)[0], F.lit(30)).alias("title"), (F.col("n_chars") > 1000).alias("done"))
    languages = lambda arrow: F.concat(F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("Idioma original")), F.lit(arrow), F.lit("Português (Brasil)"))
    n = F.count(F.lit(1))
    shelf = d.groupBy("source", "lang").agg(n.alias("n"), F.min_by(F.struct("title", "done"), "doc_id").alias("first"))
    count = F.when(F.col("n") == 1, "Um livro na estante.").otherwise(F.concat(F.col("n").cast("string"), F.lit(" livros na estante.")))
    state = F.when(F.col("first.done"), "Concluído").otherwise("Em tradução, 50%")
    aria = F.concat(F.col("first.title"), F.lit(". "), state, F.lit(". "), languages(" para "), F.lit(". Ver detalhes e ações."))
    return shelf.select("source", "lang", languages(" → ").alias("languages"), count.alias("count_line"), F.md5(aria).alias("aria_md5"))


def applied_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as books, open ones not begun yet: urgent ones ask for German, high ones for a language that isn't known; with a new language the preview's unedited lines go."""
    asked = F.when(F.col("o_orderpriority") == "1-URGENT", "de").when(F.col("o_orderpriority") == "2-HIGH", "tlh")
    known = asked.isin(*LANGUAGES)
    book = table(spark, sf_dir, "orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & known, asked).otherwise("pt-BR").alias("target"))
    changed = F.col("target") != "pt-BR"
    preview = (F.col("l_linenumber") <= 2) & (F.col("l_returnflag") != "R")
    lines = table(spark, sf_dir, "lineitem").join(book, F.col("l_orderkey") == F.col("o_orderkey"))
    left = F.count_if(~(changed & preview))
    return lines.groupBy("o_orderkey", "target").agg(left.alias("outs")).select("o_orderkey", "target", "outs", (F.col("target") == "pt-BR").cast("int").alias("has_preview"))


def reasoning_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a model's think tags stand in replies made of turns; those within a segment are the book's."""
    text = F.replace("text", F.lit("<"), F.lit("("))
    reply = F.concat(F.lit("<think>"), text, F.lit("</THINK><seg id=1>a <think>b</think> c</seg>"), text, F.lit("<think><seg id=2></think>"))
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", mk.reasoning_marks(reply).alias("m"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select("conv_id", "turn", joined(F.col("m.open")).alias("open"), joined(F.col("m.close")).alias("close"))


def provider_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: every service for each user with what is left of three requests on the user's last day, and the suggested one: free, with requests left, else the first."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    users = e.groupBy("user_id").agg(F.max("day").alias("day"))
    services = e.agg(F.collect_set("event_type").alias("services"))  # one row, a name for each service
    used = e.groupBy("user_id", "day", "event_type").agg(F.count(F.lit(1)).alias("used"))
    rows = users.join(F.broadcast(services)).select("user_id", "day", F.explode("services").alias("event_type")).join(used, ["user_id", "day", "event_type"], "left")
    left = F.greatest(F.lit(0), 3 - F.coalesce("used", F.lit(0)))
    rows = rows.select("user_id", F.col("event_type").alias("service"), (F.col("event_type") == "purchase").alias("paid"), left.cast("long").alias("left"))
    own = Window.partitionBy("user_id")
    first = F.min(F.when(~F.col("paid") & (F.col("left") > 0), F.col("service"))).over(own)
    return rows.select("user_id", "service", F.col("paid").cast("int").alias("paid"), "left", (F.col("service") == F.coalesce(first, F.min("service").over(own))).cast("int").alias("suggested"))


def analysis_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of each document's chapters within the budget of an analysis."""
    src = F.col("src")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "src"))
    lines = lines.select("doc_id", F.col("i").cast("long").alias("i"), "src", tx.word_count(src).alias("words"), (tx.has_meaning(src) & (F.length(src) % 3 <= 1)).alias("fit"))
    inside = iv.sections(lines, "doc_id", "i", F.col("fit") & (F.col("words") <= 3))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "src"))), lambda x: x["src"]), "\n\n")
    chapters = inside.groupBy("doc_id", "start").agg(F.sum("words").alias("words"), text.alias("text"))
    found = samples.analysis_sample(chapters, "doc_id", "start", "words", "text")
    return found.select("doc_id", "start", F.md5("sample").alias("sample_md5"))


def wallet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three expiries and the last twelve movements of each supplier's wallet, whose lots are its lines."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    lots = l.where("l_returnflag <> 'R'").select("l_suppkey", F.struct(day.alias("day"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.floor("l_quantity").cast("long").alias("n")).alias("lot"))
    moves = l.select("l_suppkey", F.struct(day.alias("day"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.concat_ws(":", day, "l_returnflag", F.floor("l_quantity").cast("string")).alias("s")).alias("move"))

    def most(rows: DataFrame, column: str, n: int, last: bool) -> DataFrame:
        w = Window.partitionBy("l_suppkey").orderBy(F.desc(column) if last else F.asc(column))
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)

    expiring = most(lots, "lot", 3, False).groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("lot")), lambda x: F.concat_ws(":", x["day"], x["n"].cast("string"))), ",").alias("expiring"))
    recent = most(moves, "move", 12, True).groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "move"))), lambda x: x["move"]["s"]), ",").alias("recent"))
    return recent.join(expiring, "l_suppkey", "left").select("l_suppkey", F.coalesce("expiring", F.lit("")).alias("expiring"), "recent")


def hand_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: turns as segments that the next turn translates; a reader has written the first lines of the longer ones anew, a blank one is left out, the rest is to be translated again."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    segments = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("out"), F.lit(False).alias("edited"), F.col("role").alias("by"), (F.length("text") < 50).alias("failed"))
    edits = segments.where(F.length("text") > 200).select("conv_id", "turn", F.split("text", "\n", -1)[0].alias("text")).unionAll(segments.where(F.length("text") <= 200).select("conv_id", "turn", F.lit(" \n").alias("text")))
    done = samples.to_retranslate(samples.hand_edited(segments, edits, ["conv_id", "turn"]))
    return done.select("conv_id", "turn", F.md5("out").alias("out_md5"), F.col("edited").cast("int").alias("edited"), "by", F.col("failed").cast("int").alias("failed"))


QUERIES = {
    f.__name__: f
    for f in (
        local_ids, foreign_services, excluded_services, money_labels, shelf_lines, applied_setup, reasoning_marks, provider_list, analysis_sample,
        wallet_summary, hand_edits,
    )
}
_LANG = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " ELSE 'Idioma original' END"
_BRL = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{{:,.2f}}', abs({0})), ',.', '.,')"
_L = "(SELECT doc_id, unnest(l) AS src, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
ORACLES = {
    "local_ids": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, turn FROM conversations WHERE role = 'user'",
    "foreign_services": """
SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE s_acctbal >= 0 AND s_nationkey <> c_nationkey""",
    "excluded_services": """
SELECT event_id, array_to_string(list_sort(list_distinct(coalesce(list(event_type) FILTER (WHERE value > 90) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), []))), ',') AS excluded FROM events""",
    "money_labels": f"""
SELECT c_custkey, {_BRL.format('c_acctbal')} AS money, CASE WHEN v = 0 THEN 'R$ 0' ELSE {_BRL.format('v')} END AS price,
       replace(format('{{:,}}', n), ',', '.') || CASE WHEN n = 1 THEN ' crédito' ELSE ' créditos' END AS credits
FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal BETWEEN 0 AND 100 THEN 0 ELSE c_acctbal END AS v, CAST(greatest(0, floor(c_acctbal / 100)) AS BIGINT) AS n FROM customer)""",
    "shelf_lines": f"""
SELECT source, lang, {_LANG} || ' → Português (Brasil)' AS languages, CASE WHEN n = 1 THEN 'Um livro na estante.' ELSE n || ' livros na estante.' END AS count_line,
       md5(f.t || '. ' || CASE WHEN f.d THEN 'Concluído' ELSE 'Em tradução, 50%' END || '. ' || {_LANG} || ' para Português (Brasil). Ver detalhes e ações.') AS aria_md5
FROM (SELECT source, lang, count(*) AS n, arg_min({{'t': left(split_part(text, chr(10), 1), 30), 'd': n_chars > 1000}}, doc_id) AS f FROM documents GROUP BY source, lang)""",
    "applied_setup": """
SELECT o_orderkey, target, CAST(count(*) FILTER (WHERE target = 'pt-BR' OR l_linenumber > 2 OR l_returnflag = 'R') AS BIGINT) AS outs, CAST(target = 'pt-BR' AS INTEGER) AS has_preview
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'de' ELSE 'pt-BR' END AS target FROM orders) JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
    "reasoning_marks": """
SELECT conv_id, turn, '0,' || (2 * n + 51) AS open, (n + 7) || ',' || (2 * n + 68) AS close FROM (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE text IS NOT NULL)""",
    "provider_list": """
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events), u AS (SELECT user_id, max(day) AS day FROM e GROUP BY user_id), s AS (SELECT DISTINCT event_type FROM events),
r AS (SELECT u.user_id, s.event_type AS service, s.event_type = 'purchase' AS paid, greatest(0, 3 - (SELECT count(*) FROM e WHERE e.user_id = u.user_id AND e.day = u.day AND e.event_type = s.event_type)) AS l FROM u, s)
SELECT user_id, service, CAST(paid AS INTEGER) AS paid, CAST(l AS BIGINT) AS left,
       CAST(service = coalesce(min(service) FILTER (WHERE NOT paid AND l > 0) OVER (PARTITION BY user_id), min(service) OVER (PARTITION BY user_id)) AS INTEGER) AS suggested FROM r""",
    "analysis_sample": rf"""
WITH lines AS (SELECT * FROM {_L}), sizes AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
cuts AS (SELECT doc_id, i AS start FROM lines WHERE {sql_words('src')} <= 3 AND regexp_matches(src, '[\p{{L}}\p{{N}}]') AND length(src) % 3 <= 1),
allcuts AS (SELECT * FROM cuts UNION SELECT doc_id, 0 FROM sizes),
ch AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS stop FROM allcuts JOIN sizes USING (doc_id)),
c AS (SELECT ch.doc_id, start, sum({sql_words('src')}) AS words, left(string_agg(src, chr(10) || chr(10) ORDER BY i), 3500) AS t FROM ch JOIN lines ON lines.doc_id = ch.doc_id AND i >= start AND i < stop GROUP BY ALL),
f AS (SELECT *, bool_or(words >= 300) OVER (PARTITION BY doc_id) AS a FROM c),
b AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE words >= 300 OR NOT a)
SELECT doc_id, start, md5(t) AS sample_md5 FROM b WHERE before < 16000""",
    "wallet_summary": """
WITH l AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey AS o, l_linenumber AS n, CAST(floor(l_quantity) AS BIGINT) AS q, l_returnflag AS f FROM lineitem),
e AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY day, o, n, q) AS r FROM l WHERE f <> 'R'),
m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY day DESC, o DESC, n DESC, day || ':' || f || ':' || q DESC) AS r FROM l)
SELECT m.l_suppkey, coalesce((SELECT string_agg(day || ':' || q, ',' ORDER BY r) FROM e WHERE e.l_suppkey = m.l_suppkey AND r <= 3), '') AS expiring, string_agg(day || ':' || f || ':' || q, ',' ORDER BY r) AS recent FROM m WHERE r <= 12 GROUP BY m.l_suppkey""",
    "hand_edits": """
SELECT conv_id, turn, CASE WHEN e THEN md5(split_part(text, chr(10), 1)) END AS out_md5, CAST(e AS INTEGER) AS edited, CAST(NULL AS VARCHAR) AS by, 0 AS failed
FROM (SELECT conv_id, turn, text, coalesce(length(text) > 200 AND trim(split_part(text, chr(10), 1)) <> '', false) AS e FROM conversations)""",
}
