"""Paths, declarations and rendering of a book's documents, acceptance of outputs, wallets as event folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import labels as lb
from quirespark.functions import markup as mk
from quirespark.functions import quality as qa
from quirespark.functions.package import declared_utf8, in_language, resolved_path, short_hash
from quirespark.operators import folds
from quirespark.plans.quality import dealt
from quirespark.session import table


def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the entries that the links and images of each page name, from the folder of its own path."""
    p = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r"\b(?:href|src)=\"([^\"]*)\""), F.lit(1))
    folder = F.regexp_extract("url", r"://[^/]*/(?:(.*)/)?", 1)
    each = p.select("page_id", folder.alias("folder"), F.explode(F.array_distinct(hrefs)).alias("href"))
    return each.select("page_id", "href", resolved_path(F.col("folder"), F.col("href")).alias("path"))


def short_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the short hash of each url, over its UTF-16 units."""
    return table(spark, sf_dir, "pages").select("page_id", short_hash(F.concat("url", F.lit("é€😀"))).alias("hash"))


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages declared as UTF-8 and in the language of their path's first part."""
    language = F.coalesce(F.nullif(F.regexp_extract("url", r"://[^/]*/([a-z]{2})/", 1), F.lit("")), F.lit("pt-BR"))
    html = F.regexp_replace(F.col("html"), r"(?i)<html\b[^>]*>", "<html dir='ltr' lang='xx'>")
    source = F.concat(F.lit("<?xml version='1.0' encoding='latin-1'?>"), html)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(in_language(declared_utf8(source), language)).alias("html_md5"))


def accepted_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's next one as its output: repaired, breaks put back, stray marks taken out, then judged."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = dealt(spark, sf_dir).select("conv_id", "turn", "text", F.lead("text").over(w).alias("next")).where("next is not null")
    marked = lambda t: F.concat(F.lit("<em_1>"), t, F.lit("</em_1><br_2/>end"))
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<em_1>"), "next", F.lit("</em_1>\nend"))).otherwise(F.concat(F.lit("**"), "next", F.lit("** end")))
    fixed = c.select("conv_id", "turn", marked(F.col("text")).alias("src"), answer.alias("out")).withColumn("f", mk.repair("out", "src"))
    strict = lb.without_stray_markup(F.col("f.markup"))
    broken = lambda t: qa.verdict(F.col("src"), t, F.lit("pt-BR"))
    judged = fixed.select("conv_id", "turn", "src", "f", broken(F.col("f.markup")).alias("hard"), strict.alias("strict")).withColumn("again", F.when(F.col("hard") == "stray-tag", broken(F.col("strict"))))
    reason = F.when(F.size("f.missing") > 0, "tags").when(F.col("hard") == "stray-tag", F.coalesce("again", F.lit("ok"))).otherwise(F.coalesce("hard", F.lit("ok")))
    return judged.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("outputs"))


def rendered_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns as a book's XHTML and as a page's HTML, with crossing tags and a repeated id."""
    tags = [(1, "i", '<i id="a">', False), (2, "span", '<span id="a" class="bold">', False), (3, "br", "<br/>", True), (4, "img", '<img src="x"/>', True)]
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(o).alias("opening"), F.lit(v).alias("void")) for k, n, o, v in tags))
    markup = F.concat(F.lit("<i_1>"), F.replace("text", F.lit("<"), F.lit(" ")), F.lit("<span_2>b</i_1>c</span_2><br_3/><img_4/><z_9>d</z_9>"))
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", mk.rendered(markup, known).alias("r"))
    return r.select("conv_id", "turn", F.md5("r.xhtml").alias("xhtml_md5"), F.md5("r.html").alias("html_md5"))


def edited_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns rendered for a reader's page and read back, with emphasis and a break that the reader has added."""
    tags = [(1, "i", '<i id="a">', False), (2, "span:x", '<span id="a">', False), (3, "br", "<br/>", True), (4, "img", '<img src="x"/>', True)]
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(o).alias("opening"), F.lit(v).alias("void")) for k, n, o, v in tags))
    markup = F.concat(F.lit("<i_1>"), F.replace("text", F.lit("<"), F.lit(" ")), F.lit("<span_2>b</span_2></i_1><br_3/><img_4/>"))
    page = F.concat(mk.rendered(markup, known)["html"], F.lit("<div><em>x <b>y &lt; z</b></em></div><strong></strong><br>"))
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", mk.edited(page, known).alias("e"))
    return r.select("conv_id", "turn", F.md5("e.markup").alias("markup_md5"), F.array_join(F.transform("e.added", lambda t: F.concat_ws(":", t["k"].cast("string"), t["name"])), ",").alias("added"))


def wallet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance and free credits of each user after every grant, reservation, capture and release."""
    what = F.when(F.col("event_type") == "signup", "grant").when(F.col("event_type") == "purchase", "reserve").when(F.col("event_type") == "error", "release").otherwise("capture")
    n = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", what.alias("action"), F.when(what == "grant", n * 10 + 500).otherwise(n).alias("n"))
    return folds.wallet(e, "user_id", ["us", "event_id"], "action", "n")


def wallet_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same wallets with lots that expire by days, a welcome lot, a daily one, and reservations closed by a restart."""
    what = F.when(F.col("event_type") == "signup", "grant").when(F.col("event_type") == "purchase", "reserve").when(F.col("value") > 60, "restart").when(F.col("event_type") == "error", "release").otherwise("capture")
    n = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    at = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(at).alias("us"), "event_id", F.unix_date(at.cast("date")).cast("long").alias("day"), what.alias("action"), n.alias("n"))
    return folds.wallet_lots(e, "user_id", ["us", "event_id"], "day", "action", "n", (15, 11), (5, 1), 3)


QUERIES = {f.__name__: f for f in (archive_paths, short_hashes, page_headers, accepted_outputs, rendered_markup, edited_markup, wallet_events, wallet_lots)}
ORACLES = {
    # an archive has no parent folder, so what leads above it begins again at the top
    "archive_paths": r"""
WITH RECURSIVE h AS (SELECT page_id, regexp_extract(url, '://[^/]*/(?:(.*)/)?', 1) AS folder, unnest(list_distinct(regexp_extract_all(html, '\b(?:href|src)="([^"]*)"', 1))) AS href FROM pages),
p AS (SELECT page_id, href, list_filter(string_split(CASE WHEN folder = '' THEN '' ELSE folder || '/' END || url_decode(replace(regexp_extract(href, '^[^?#]*', 0), '+', '%2B')), '/'), lambda x: x NOT IN ('', '.')) AS w FROM h),
f AS (SELECT page_id, href, w, 0 AS i, CAST([] AS VARCHAR[]) AS done FROM p UNION ALL
      SELECT page_id, href, w, i + 1, CASE WHEN w[i + 1] = '..' THEN done[:greatest(len(done) - 1, 0)] ELSE list_append(done, w[i + 1]) END FROM f WHERE i < len(w))
SELECT page_id, href, array_to_string(done, '/') AS path FROM f WHERE i = len(w)""",
    "short_hashes": r"""
WITH RECURSIVE c AS (SELECT page_id, unnest(string_split(url || 'é€😀', '')) AS c, unnest(range(len(string_split(url || 'é€😀', '')))) AS k FROM pages),
u AS (SELECT page_id, list(x ORDER BY k, j) AS u FROM (
  SELECT page_id, k, unnest(CASE WHEN n < 65536 THEN [n] ELSE [55296 + ((n - 65536) >> 10), 56320 + ((n - 65536) & 1023)] END) AS x, unnest(CASE WHEN n < 65536 THEN [0] ELSE [0, 1] END) AS j
  FROM (SELECT page_id, k, CAST(unicode(c) AS BIGINT) AS n FROM c)) GROUP BY page_id),
f AS (SELECT page_id, u, 0 AS i, 2166136261::HUGEINT AS a, xor(16777619, len(u))::HUGEINT AS b FROM u UNION ALL
      SELECT page_id, u, i + 1, (xor(a::BIGINT, u[i + 1])::HUGEINT * 16777619) % 4294967296, (xor(b::BIGINT, u[i + 1])::HUGEINT * 1540483477) % 4294967296 FROM f WHERE i < len(u))
SELECT page_id, left(lpad(lower(to_hex(a::BIGINT)), 8, '0') || lpad(lower(to_hex(b::BIGINT)), 8, '0'), 12) AS hash FROM f WHERE i = len(u)""",
    "page_headers": r"""
SELECT page_id, md5('<?xml version=''1.0'' encoding="utf-8"?>' || regexp_replace(html, '(?i)<html\b[^>]*>', '<html dir=''ltr'' xml:lang="' || l || '" lang="' || l || '">', 'g')) AS html_md5
FROM (SELECT page_id, html, coalesce(nullif(regexp_extract(url, '://[^/]*/([a-z]{2})/', 1), ''), 'pt-BR') AS l FROM pages)""",
    "rendered_markup": """
SELECT conv_id, turn, md5('<i id="a">' || t || '<span class="bold">b</span></i>c<br/><img src="x"/>d') AS xhtml_md5,
  md5('<em data-k="1">' || t || '<span data-k="2" class="bd">b</span></em>c<br data-k="3"><span data-k="4" data-v="1" class="inline-object" contenteditable="false"></span>d') AS html_md5
FROM (SELECT conv_id, turn, replace(replace(replace(text, '<', ' '), '&', '&amp;'), '>', '&gt;') AS t FROM conversations)""",
    "edited_markup": r"""
SELECT conv_id, turn, md5(trim(regexp_replace('<i_1>' || t || '<span-x_2>b</span-x_2></i_1><br_3/><img_4/><em_6>x <strong_5>y &lt; z</strong_5></em_6><br_7/>', '\s+', ' ', 'g'))) AS markup_md5, '5:strong,6:em,7:br' AS added
FROM (SELECT conv_id, turn, replace(replace(replace(text, '<', ' '), '&', '&amp;'), '>', '&gt;') AS t FROM conversations)""",
    "wallet_events": """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type AS k, CAST(floor(coalesce(value, 0)) AS BIGINT) AS v FROM events),
s AS (SELECT *, CASE WHEN k = 'signup' THEN v * 10 + 500 ELSE v END AS n, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM e),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS us, -1::BIGINT AS event_id, 0::BIGINT AS rn, 0::BIGINT AS balance, 0::BIGINT AS held, 0::BIGINT AS taken, 0::BIGINT AS moved FROM e
  UNION ALL SELECT user_id, us, event_id, rn, balance + CASE WHEN k = 'signup' THEN moved WHEN k NOT IN ('purchase', 'error') THEN -moved ELSE 0 END,
    CASE WHEN k = 'error' THEN 0 WHEN k = 'purchase' AND held = 0 THEN moved ELSE held END, CASE WHEN k = 'error' THEN 0 WHEN k NOT IN ('signup', 'purchase') THEN taken + moved ELSE taken END, moved
  FROM (SELECT s.user_id, s.us, s.event_id, s.rn, s.k, f.balance, f.held, f.taken,
    CASE WHEN s.k = 'signup' THEN s.n WHEN s.k = 'purchase' THEN CASE WHEN f.held = 0 THEN least(f.balance, s.n) ELSE 0 END WHEN s.k = 'error' THEN f.taken ELSE least(s.n, f.held - f.taken) END AS moved
    FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1))
SELECT user_id, us, event_id, balance, balance - (held - taken) AS free, moved FROM f WHERE rn > 0""",
    "wallet_lots": """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS p, CAST(floor(coalesce(value, 0)) AS BIGINT) AS n,
       CASE WHEN event_type = 'signup' THEN 'grant' WHEN event_type = 'purchase' THEN 'reserve' WHEN value > 60 THEN 'release' WHEN event_type = 'error' THEN 'release' ELSE 'capture' END AS k FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM e),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS us, -1::BIGINT AS event_id, 0::BIGINT AS rn, -1::BIGINT AS day, CAST([] AS STRUCT(e BIGINT, m BIGINT)[]) AS lots, 0::BIGINT AS held, 0::BIGINT AS taken, 0::BIGINT AS moved, 0::BIGINT AS expired, 0::BIGINT AS granted FROM e
  UNION ALL SELECT user_id, us, event_id, rn, p,
    CASE k WHEN 'grant' THEN list_sort(list_append(l1, {'e': p + 3, 'm': n}))
           WHEN 'capture' THEN list_filter(list_transform(l1, lambda x, i: {'e': x.e, 'm': x.m - greatest(0, least(x.m, moved - CAST(coalesce(list_sum(list_transform(l1[:i - 1], lambda y: y.m)), 0) AS BIGINT)))}), lambda x: x.m > 0) ELSE l1 END,
    CASE WHEN k = 'release' THEN 0 WHEN k = 'reserve' AND held = 0 THEN moved ELSE held END, CASE WHEN k = 'release' THEN 0 WHEN k = 'capture' THEN taken + moved ELSE taken END, moved, expired, granted
  FROM (SELECT *, CASE k WHEN 'grant' THEN n WHEN 'reserve' THEN CASE WHEN held = 0 THEN least(CAST(coalesce(list_sum(list_transform(l1, lambda x: x.m)), 0) AS BIGINT), n) ELSE 0 END WHEN 'capture' THEN least(n, held - taken) ELSE taken END AS moved
    FROM (SELECT s.user_id, s.us, s.event_id, s.rn, s.p, s.k, s.n, f.held, f.taken,
      CAST(coalesce(list_sum(list_transform(list_filter(f.lots, lambda x: x.e < s.p), lambda x: x.m)), 0) AS BIGINT) AS expired, CASE WHEN f.day = -1 THEN 20 WHEN f.day <> s.p THEN 5 ELSE 0 END AS granted,
      list_sort(list_concat(list_filter(f.lots, lambda x: x.e >= s.p), CASE WHEN f.day = -1 THEN [{'e': s.p + 11, 'm': 15::BIGINT}, {'e': s.p + 1, 'm': 5::BIGINT}] WHEN f.day <> s.p THEN [{'e': s.p + 1, 'm': 5::BIGINT}] ELSE [] END)) AS l1
      FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)))
SELECT user_id, us, event_id, b AS balance, greatest(0, b - (held - taken)) AS free, moved, expired, granted FROM (SELECT *, CAST(coalesce(list_sum(list_transform(lots, lambda x: x.m)), 0) AS BIGINT) AS b FROM f WHERE rn > 0)""",
}
