"""Text scalars, filters and line segments over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import text as tx
from quirespark.session import table

#: The word pattern and count as RE2 has them.
SQL_WORD = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"


def sql_words(text: str) -> str:
    """DuckDB's word count of a text without unspaced scripts."""
    return f"CAST(len(regexp_extract_all(coalesce({text}, ''), '{SQL_WORD}')) AS BIGINT)"


def word_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, A3."""
    docs = table(spark, sf_dir, "documents").select("lang", tx.word_count(F.col("text")).alias("w"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), F.max("w").alias("longest"))


def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.collapse(F.col("text"))).alias("text_md5"))


def truncate_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, L12, F32."""
    first = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.truncate(first, 40).alias("title"), tx.cover_title(first, 30).alias("cover"), tx.title_fit(first).alias("fit")
    )


def meaningful_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7, P8."""
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(
        F.count_if(tx.has_meaning(F.col("text"))).alias("meaningful"), F.count_if(tx.has_words(F.col("text"))).alias("with_words"), F.count(F.lit(1)).alias("turns")
    )


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14 on plain lines: segments with their index, words and role."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "src"))
    words = tx.word_count(F.col("src"))
    role = F.when(~tx.has_meaning(F.col("src")), "ornament").when(words <= 3, "heading").otherwise("paragraph")
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), F.length("src").cast("long").alias("chars"), words.alias("words"), role.alias("role"))


def strip_markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text between a page's tags, scripts and styles left out."""
    t = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(?:script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    t = F.trim(tx.collapse(t))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("text_md5"))


def tag_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that a page opens and how many of them it never closes."""
    opened = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))))
    closed = F.array_distinct(F.regexp_extract_all("html", F.lit(r"</([a-z][a-z0-9]*)"), F.lit(1)))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(opened, ",").alias("opened"), F.array_join(F.array_sort(F.array_except(opened, closed)), ",").alias("missing")
    )


def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F9."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(tx.escape_xml(F.col("html"), attribute=True)).alias("attr_md5"), F.md5(tx.escape_xml(F.col("html"))).alias("text_md5")
    )


def bare_ampersands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages whose html changes when stray ampersands are escaped."""
    fixed = tx.escape_ampersands(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", (F.length(fixed) - F.length("html")).cast("long").alias("added"))


def format_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return table(spark, sf_dir, "pages").select("page_id", tx.format_bytes(F.octet_length("html").cast("long") * 37).alias("size"))


def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable hash of a name and the shape slots it selects."""
    h = tx.fnv1a(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", h.alias("hash"), (h % 4).alias("scale_slot"), (F.shiftright(h, 4) % 4).alias("ratio_slot"))


def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.slug(F.substring_index("text", "\n", 1)).alias("slug"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed field of loose JSON, null where it can't be read."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("with_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def id_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of 24 lower-case hex digits."""
    key = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 24)
    mixed = F.when(F.col("doc_id") % 3 == 0, F.upper(key)).when(F.col("doc_id") % 5 == 0, F.concat(key, F.lit("0"))).otherwise(key)
    return table(spark, sf_dir, "documents").select("doc_id", mixed.rlike("^[a-f0-9]{24}$").cast("int").alias("valid"))


QUERIES = {
    f.__name__: f
    for f in (
        word_count_by_lang, whitespace_collapse, truncate_title, meaningful_filter, line_segments, strip_markup_text, tag_keys,
        xml_escape, bare_ampersands, format_sizes, fnv_hash, slug_names, json_props, id_validation,
    )
}
_FIRST = "split_part(text, chr(10), 1)"
ORACLES = {
    # an & is stray unless an entity's name or number and a semicolon follow
    "bare_ampersands": r"""
SELECT page_id, CAST(4 * (len(p) - 1 - len(list_filter(p[2:], lambda x: regexp_matches(x, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);')))) AS BIGINT) AS added
FROM (SELECT page_id, string_split(html, '&') AS p FROM pages)""",
    "word_count_by_lang": f"SELECT lang, count(*) AS docs, CAST(sum(w) AS BIGINT) AS words, max(w) AS longest FROM (SELECT lang, {sql_words('text')} AS w FROM documents) GROUP BY lang",
    "whitespace_collapse": r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS text_md5 FROM documents",
    "truncate_title": rf"""
SELECT doc_id, CASE WHEN length(f) <= 40 THEN f ELSE regexp_replace(f[1:39], '\s+$', '') || '…' END AS title,
       CASE WHEN length(f) <= 30 THEN f ELSE regexp_replace(CASE WHEN contains(c, ' ') AND s > 18.0 THEN c[1:s] ELSE c END, '[\s,;:.\-–—]+$', '') || '…' END AS cover,
       CASE WHEN length(f) > 60 OR w > 14 THEN 'xlong' WHEN length(f) > 30 OR w > 10 THEN 'long' ELSE 'normal' END AS fit
FROM (SELECT *, length(c) - strpos(reverse(c), ' ') AS s, list_max(list_transform(regexp_split_to_array(f, '\s+'), lambda x: length(x))) AS w
      FROM (SELECT doc_id, {_FIRST} AS f, {_FIRST}[1:30] AS c FROM documents))""",
    "meaningful_filter": r"SELECT role, count(*) FILTER (WHERE regexp_matches(text, '[\p{L}\p{N}]')) AS meaningful, count(*) FILTER (WHERE regexp_matches(text, '\p{L}')) AS with_words, count(*) AS turns FROM conversations GROUP BY role",
    "line_segments": rf"""
SELECT doc_id, i, CAST(length(src) AS BIGINT) AS chars, {sql_words('src')} AS words,
       CASE WHEN NOT regexp_matches(src, '[\p{{L}}\p{{N}}]') THEN 'ornament' WHEN {sql_words('src')} <= 3 THEN 'heading' ELSE 'paragraph' END AS role
FROM (SELECT doc_id, unnest(l) AS src, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "strip_markup_text": r"""
SELECT page_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '[ \t\n\r\f]+', ' ', 'g'), ' ') AS t FROM pages)""",
    "tag_keys": r"""
SELECT page_id, array_to_string(o, ',') AS opened, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(c, x))), ',') AS missing
FROM (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS o, list_distinct(regexp_extract_all(html, '</([a-z][a-z0-9]*)', 1)) AS c FROM pages)""",
    "xml_escape": """
SELECT page_id, md5(replace(t, '"', '&quot;')) AS attr_md5, md5(t) AS text_md5 FROM (SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM pages)""",
    "format_sizes": """
SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(round(n / 1024.0) AS BIGINT) || ' KB'
       ELSE replace(printf('%.1f', n / 1048576.0), '.', ',') || ' MB' END AS size FROM (SELECT page_id, CAST(strlen(html) * 37 AS BIGINT) AS n FROM pages)""",
    "fnv_hash": """
SELECT c_custkey, h AS hash, h % 4 AS scale_slot, (h >> 4) % 4 AS ratio_slot FROM (
  SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
         lambda h, c: (CAST(xor(CAST(h AS BIGINT), CAST(c AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296) AS BIGINT) AS h FROM customer)""",
    "json_props": """
SELECT event_type, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""",
    "id_validation": """
SELECT doc_id, CAST(regexp_full_match(CASE WHEN doc_id % 3 = 0 THEN upper(k) WHEN doc_id % 5 = 0 THEN k || '0' ELSE k END, '[a-f0-9]{24}') AS INT) AS valid
FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR))[1:24] AS k FROM documents)""",
}
