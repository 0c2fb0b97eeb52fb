"""Labels, titles, cleaned texts and language codes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions import labels as lb
from quirespark.functions import text as tx
from quirespark.plans.text import sql_words
from quirespark.session import table

#: Languages of this deployment and their ISO 639-3 codes.
LANGUAGES = {"de": "deu", "en": "eng", "es": "spa", "fr": "fra", "it": "ita", "nb": "nob", "pt-br": "por", "pt-pt": "por", "zh": "cmn"}


def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F39."""
    seconds = F.when(F.col("event_id") % 50 != 0, F.col("event_id") * 7 % 20000)
    return table(spark, sf_dir, "events").select("event_id", lb.duration(seconds).alias("label"))


def quota_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F40."""
    i = F.col("event_id")
    until = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    q = lb.quota_text(i % 3, F.when(i % 7 != 0, i % 15), F.lit(20).cast("long"), until, F.lit("2024-01-10").cast("date"))
    return table(spark, sf_dir, "events").select("event_id", q.alias("q")).select("event_id", "q.text", "q.tone")


def chapter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F31."""
    i = F.col("doc_id") % 4
    title = F.when(i == 0, " XIV. ").when(i == 1, F.col("doc_id").cast("string")).otherwise(F.substring_index("text", "\n", 1))
    return table(spark, sf_dir, "documents").select("doc_id", lb.chapter_label(title).alias("label"))


def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated title, first heading or file name of each page."""
    i = F.col("page_id")
    meta = F.when(i % 4 == 0, "Untitled 3").when(i % 4 == 1, "letter.docx").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    heading = F.when(i % 8 != 0, F.nullif(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), F.lit("")))
    name = F.concat(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), F.lit("_v.1.PDF"))
    return table(spark, sf_dir, "pages").select("page_id", lb.document_title(meta, heading, name).alias("title"), lb.file_title(name).alias("file_title"))


def clean_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F34."""
    t = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("ha"), F.lit("h­a"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(lb.clean_text(t)).alias("text_md5"))


def stray_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F36."""
    t = F.concat(F.lit('&lt;em class="x"&gt;'), "text", F.lit("&lt;/em&gt;&lt;br/&gt; **bold**  end "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(lb.without_stray_markup(t)).alias("text_md5"))


def translatable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: characters of each text that are to be translated."""
    t = F.concat(F.lit("<code_3>x = 1</code_3>"), "text", F.lit(" doi: 10.1000/xyz123 see https://a.example/b ISBN 978-0-306-40615-7 end"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(lb.translatable(t)).alias("text_md5"))


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: every line of the documents that is a bibliographic reference; some lines are given an ending that makes one."""
    i = F.length("line") % 6
    tail = F.when(i == 0, " (1998)").when(i == 1, " see pp. 23").when(i == 2, " et al.").when(i == 3, " New York: Random House, 1998").otherwise("")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(lb.is_reference(F.concat("line", tail))).select("doc_id", "line_no")


def reply_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replies say after their last segment."""
    reply = F.concat(F.lit("<think>a</seg>b</think><seg id=\"1\">"), "text", F.lit("</SEG>I cannot go on "), F.col("turn").cast("string"), F.lit("<new_terms>\n- a => b"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lb.after_last_segment(reply).alias("tail"))


def elided_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings and ends of long texts."""
    t = lb.middle_elided(F.col("text"), 2800, 2100, 700)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("text_md5"))


def first_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link to each anchor of a page."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs).alias("i", "href"))
    to = F.concat("href", F.when(F.col("i") % 4 == 3, "").otherwise(F.concat(F.lit("#s%20"), (F.col("i") % 3).cast("string"))))
    return links.select("page_id", "i", lb.fragment(to).alias("anchor")).where("anchor is not null").groupBy("page_id", "anchor").agg(F.min("i").cast("long").alias("first_i"))


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known languages that loosely written codes mean, with their three-letter codes."""
    i = F.col("doc_id") % 6
    code = F.when(i == 0, "pt_BR").when(i == 1, " zh-Hant ").when(i == 2, "nn").when(i == 3, "xx").when(i == 4, "pt-PT").otherwise(F.concat(F.upper("lang"), F.lit("_at")))
    iso3 = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    d = table(spark, sf_dir, "documents").select(code.alias("code"), lb.language_code(code, list(LANGUAGES)).alias("language"))
    return d.groupBy("code", "language", iso3[F.col("language")].alias("iso3")).agg(F.count(F.lit(1)).alias("docs"))


def ad_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers found in pasted code; which pages may show an advertisement."""
    i = F.col("page_id")
    code = F.when(i % 3 == 0, F.concat(F.lit('<ins data-ad-slot="'), (i + 1000000).cast("string"), F.lit('">'))).when(i % 3 == 1, (i + 7000000).cast("string")).otherwise("x")
    client = F.when(i % 2 == 0, F.concat(F.lit("client=CA-pub-"), F.lpad(i.cast("string"), 16, "9"))).otherwise("pub-12")
    p = table(spark, sf_dir, "pages").select("page_id", lb.slot_id(code).alias("slot"), lb.publisher_id(client).alias("client"), lb.safe_url(F.col("url")).alias("link"))
    shown = F.col("slot").isNotNull() & F.col("client").isNotNull() & F.coalesce(F.when(i % 5 == 0, False), F.lit(True))
    return p.select("page_id", "slot", "client", F.col("link").isNotNull().cast("int").alias("safe"), shown.cast("int").alias("shown"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level of headings that occurs 2 to 400 times splits a document; its chapters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    h = lines.select("doc_id", "i", tx.word_count(F.col("line")).alias("w")).withColumn("level", F.when(F.col("w").between(1, 3), F.col("w")))
    w = Window.partitionBy("doc_id")
    n = [F.count_if(F.col("level") == k).over(w) for k in (1, 2, 3)]
    chosen = F.coalesce(*(F.when(x.between(2, 400), k) for k, x in zip((1, 2, 3), n, strict=True)), F.lit(0)).cast("long")
    split = h.withColumn("chosen", chosen).withColumn("splits", F.coalesce(F.col("level") <= F.col("chosen"), F.lit(False)))
    return split.groupBy("doc_id", "chosen").agg((F.count_if("splits") + F.count_if((F.col("i") == 0) & ~F.col("splits"))).alias("chapters"))


QUERIES = {
    f.__name__: f
    for f in (
        duration_labels, quota_labels, chapter_labels, file_titles, clean_pdf_text, stray_markup, translatable_text, reference_lines,
        reply_tails, elided_texts, first_anchors, language_lookup, ad_slots, heading_levels,
    )
}


def _chain(text: str, patterns) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return text


_LINE = "split_part(text, chr(10), 1)"
_CLASS = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{c}'" for c, p in ((c, p.replace("'", "''")) for c, p in lb.TOKENS.items()))
_MARKS = "|".join(f"(?:{p})" for p in lb.MARKS.values())
_UNLIGATED = "text"
for _a, _b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("­", "")):
    _UNLIGATED = f"replace({_UNLIGATED}, '{_a}', '{_b}')"
ORACLES = {
    "duration_labels": """
SELECT event_id, CASE WHEN s IS NULL THEN 'calculando…' WHEN s < 60 THEN '< 1 min' WHEN m < 60 THEN '~' || m || ' min'
       WHEN m % 60 > 0 THEN '~' || m // 60 || ' h ' || m % 60 || ' min' ELSE '~' || m // 60 || ' h' END AS label
FROM (SELECT *, CAST(floor(s / 60.0::DOUBLE + 0.5) AS BIGINT) AS m FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN event_id * 7 % 20000 END AS s FROM events))""",
    "quota_labels": """
SELECT event_id, CASE WHEN u IS NOT NULL THEN 'Cota de hoje esgotada · volta ' || CASE WHEN d = 0 THEN strftime(u, 'hoje às %H:%M') WHEN d = 1 THEN strftime(u, 'amanhã às %H:%M') ELSE strftime(u, '%d/%m, %H:%M') END
       WHEN r IS NOT NULL THEN r || ' de 20 pedidos grátis restantes hoje' WHEN n = 1 THEN '1 pedido usado hoje' WHEN n > 0 THEN n || ' pedidos usados hoje' ELSE 'Nenhum pedido usado hoje' END AS text,
       CASE WHEN u IS NOT NULL THEN 'out' WHEN r <= 3 THEN 'low' ELSE 'ok' END AS tone
FROM (SELECT *, date_diff('day', DATE '2024-01-10', CAST(u AS DATE)) AS d FROM (SELECT event_id, event_id % 3 AS n, CASE WHEN event_id % 7 <> 0 THEN event_id % 15 END AS r,
      CASE WHEN event_type = 'error' THEN ts + INTERVAL 6 HOUR END AS u FROM events))""",
    "chapter_labels": rf"""
SELECT doc_id, CASE WHEN regexp_matches(t, '{lb.CHAPTER_NUMBER}') THEN 'Capítulo ' || rtrim(t, '.') ELSE t END AS label
FROM (SELECT doc_id, regexp_replace(CASE doc_id % 4 WHEN 0 THEN 'XIV.' WHEN 1 THEN CAST(doc_id AS VARCHAR) ELSE {_LINE} END, '^\s+|\s+$', '', 'g') AS t FROM documents)""",
    "file_titles": r"""
SELECT page_id, coalesce(CASE WHEN m <> '' AND page_id % 4 > 1 AND NOT regexp_matches(m, '(?i)^(?:untitled|microsoft word|document|sem título)|\.(?:docx?|pdf|indd)$') THEN m END,
       CASE WHEN page_id % 8 <> 0 THEN nullif(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '') END, f || '_v.1') AS title,
       trim(regexp_replace(regexp_replace(f || '_v.1', '[._]+', ' ', 'g'), '\s+', ' ', 'g')) AS file_title
FROM (SELECT page_id, html, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^\s+|\s+$', '', 'g') AS m, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS f FROM pages)""",
    "clean_pdf_text": rf"SELECT conv_id, turn, md5(regexp_replace({_UNLIGATED}, '{lb.WIDE_SPACE}', ' ', 'g')) AS text_md5 FROM conversations",
    "stray_markup": rf"""
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text || '  bold  end', '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM conversations""",
    "translatable_text": f"SELECT doc_id, md5({_chain(chr(39) + ' ' + chr(39) + ' || text || ' + chr(39) + ' doi: 10.1000/xyz123 see https://a.example/b ISBN 978-0-306-40615-7 end' + chr(39), lb.VERBATIM)}) AS text_md5 FROM documents",
    "reference_lines": f"""
SELECT doc_id, line_no FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE regexp_matches(list_aggregate(list_transform(list_filter(regexp_split_to_array(line || CASE length(line) % 6 WHEN 0 THEN ' (1998)' WHEN 1 THEN ' see pp. 23' WHEN 2 THEN ' et al.' WHEN 3 THEN ' New York: Random House, 1998' ELSE '' END, '\\s+'),
  lambda x: x <> ''), lambda x: CASE {_CLASS} ELSE 'x' END), 'string_agg', ''), '{_MARKS}')""",
    "reply_tails": "SELECT conv_id, turn, 'I cannot go on ' || turn AS tail FROM conversations",
    "elided_texts": """
SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS text_md5 FROM (SELECT doc_id, CASE WHEN length(text) > 2800 THEN text[1:2100] || chr(10) || '[…]' || chr(10) || text[length(text) - 699:] ELSE text END AS t FROM documents)""",
    "first_anchors": """
SELECT page_id, 's ' || i % 3 AS anchor, min(i) AS first_i FROM (SELECT page_id, unnest(range(len(h))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))
WHERE i % 4 <> 3 GROUP BY 1, 2""",
    "language_lookup": """
SELECT code, language, CASE language WHEN 'pt-br' THEN 'por' WHEN 'pt-pt' THEN 'por' WHEN 'zh' THEN 'cmn' WHEN 'nb' THEN 'nob' WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' END AS iso3, count(*) AS docs
FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'pt_BR' WHEN 1 THEN ' zh-Hant ' WHEN 2 THEN 'nn' WHEN 3 THEN 'xx' WHEN 4 THEN 'pt-PT' ELSE upper(lang) || '_at' END AS code,
             CASE doc_id % 6 WHEN 0 THEN 'pt-br' WHEN 1 THEN 'zh' WHEN 2 THEN 'nb' WHEN 3 THEN NULL WHEN 4 THEN 'pt-pt' ELSE lang END AS language FROM documents) GROUP BY code, language""",
    "ad_slots": r"""
SELECT page_id, slot, client, safe, CAST(slot IS NOT NULL AND client IS NOT NULL AND page_id % 5 <> 0 AS INT) AS shown
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN CAST(page_id + 1000000 AS VARCHAR) WHEN 1 THEN CAST(page_id + 7000000 AS VARCHAR) END AS slot,
             CASE WHEN page_id % 2 = 0 THEN 'ca-pub-' || lpad(CAST(page_id AS VARCHAR), 16, '9') END AS client,
             CAST(coalesce(regexp_matches(url, '(?i)^https?://[^/?#\s]*[^/?#\s.]\.[^/?#\s]+'), FALSE) AS INT) AS safe FROM pages)""",
    "heading_levels": f"""
WITH h AS (SELECT doc_id, i, CASE WHEN w BETWEEN 1 AND 3 THEN w END AS level FROM (SELECT doc_id, i, {sql_words('line')} AS w
           FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))),
n AS (SELECT doc_id, level FROM h WHERE level IS NOT NULL GROUP BY doc_id, level HAVING count(*) BETWEEN 2 AND 400),
c AS (SELECT h.*, coalesce((SELECT min(level) FROM n WHERE n.doc_id = h.doc_id), 0) AS chosen FROM h)
SELECT doc_id, chosen, count(*) FILTER (WHERE level <= chosen) + count(*) FILTER (WHERE i = 0 AND NOT coalesce(level <= chosen, FALSE)) AS chapters FROM c GROUP BY doc_id, chosen""",
}
