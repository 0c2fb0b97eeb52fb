"""The thin contract queries; each gets its rows through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import content_sort, divergence, hard_negatives, line_dedup, packing, ranking, simhash, substring_dedup, surrogates, toxicity, url_filter, warc, wu_manber
from quirespark.llm.common import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxic_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, labels))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.numbered(_table(spark, sf_dir, "pages"))
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(warc.plan_records(pages), warc.chunked(pages), folder)
    chunks = warc.read_archives(manifest, folder, with_data=False)
    return chunks.where("last").select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_sort_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return ranking.score_quality(docs, ranking.fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


#: (action, host, path), as the contract fixes them.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate lines of all documents: (doc_id, line_no) and the earliest line within one word edit in 20, below 5 words an equal one."""
    found = line_dedup.duplicate_lines(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("first_doc").alias("first_doc_id"),
        F.col("first_line").cast("long").alias("first_line_no"),
    )


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data: (doc_id, text, n_entities, n_distinct)."""
    found = surrogates.replace_pii(_table(spark, sf_dir, "documents"), key="quire")
    return found.select("doc_id", "text", "n_entities", "n_distinct")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows with vec_id divisible by 100; where it is divisible by 7, the label is the next one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language from one another, and each source's ten foremost terms."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that start in an earlier one."""
    found = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_toxic_chain": op1_toxic_chain,
    "op2_warc_chunks": op2_warc_chunks,
    "op3_content_sort": op3_content_sort,
    "op4_pairwise_quality": op4_pairwise_quality,
    "op5_binary_packing": op5_binary_packing,
    "op6_redirect_equivalence": op6_redirect_equivalence,
    "op7_wu_manber": op7_wu_manber,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_surrogates": op10_surrogates,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLES = {
    "op2_warc_chunks": """
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM (SELECT page_id, h, n, max(page_id) OVER (PARTITION BY h) AS m
      FROM (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages))""",
    "op6_redirect_equivalence": r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, split_part(url, '#', 1) AS node,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS canonical,
         regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) AS refresh
  FROM pages),
e AS (SELECT node AS a, split_part(replace(t, '&amp;', '&'), '#', 1) AS b FROM (SELECT node, unnest([canonical, refresh]) AS t FROM p WHERE contains(url, '://')) WHERE contains(t, '://')),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM reach r JOIN s ON r.b = s.a),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
n AS (SELECT DISTINCT b, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM reach),
na AS (SELECT b, arg_max(action, length(rhost || rpath)) AS action FROM n JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY b),
spread AS (SELECT a, CASE WHEN bool_or(action = 'allow') THEN 'allow' ELSE 'block' END AS v FROM reach JOIN na USING (b) GROUP BY a),
own AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, v, 'allow') AS verdict FROM p LEFT JOIN own USING (page_id) LEFT JOIN spread ON node = a""",
    "op7_wu_manber": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM bm)),
gram AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
         FROM (SELECT doc_id, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM dw, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
hit AS (SELECT doc_id, gram.m, i, item_id FROM gram JOIN pat ON gram.m = pat.m AND gram.g = pat.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_content_sort": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op11_hard_negatives": """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 10""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS of_lang FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(of_lang)::HUGEINT AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
m AS (SELECT g.lang, g.source, kept.term, kept.of_lang, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT m.*, 1 + 1000000000::HUGEINT * (m.n + 2) // ((sum(m.n) OVER (PARTITION BY m.lang, m.source))::HUGEINT + 2 * v.v) AS p,
             1 + 1000000000::HUGEINT * (of_lang + 2) // (v.n + 2 * v.v) AS q FROM m JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
           ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
term AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 10""",
    "op13_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (s) WHERE doc_id > least),
gone AS (SELECT doc_id, list(p) AS ps FROM cut GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
         FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d SEMI JOIN gone USING (doc_id)) ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
