"""Streamed answers, loose and strict JSON, sealed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import contracts as ct
from quirespark.session import table
from quirespark.sources import event_lines


def streamed_bodies(conversations: DataFrame) -> DataFrame:
    """(stream, body): each turn as a service streams it, 40 characters an event; users' turns in one layout, the others' in the other."""
    size = F.greatest(F.ceil(F.length("text") / 40).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(F.col("text"), i * 40 + 1, F.lit(40)))
    data = lambda json: F.concat(F.lit("data: "), json)
    user = F.col("role") == "user"
    say = F.transform(
        pieces,
        lambda p: F.when(
            user, data(F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(p.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))))
        ).otherwise(data(F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices"))))),
    )
    n = F.length("text").cast("long")
    end = F.when(
        user,
        F.array(data(F.to_json(F.struct(F.array(F.struct(F.lit("STOP").alias("finishReason"))).alias("candidates"), F.struct(n.alias("promptTokenCount"), F.col("turn").alias("candidatesTokenCount")).alias("usageMetadata"))))),
    ).otherwise(
        F.array(
            data(F.to_json(F.struct(F.array(F.struct(F.lit("length").alias("finish_reason"))).alias("choices")))),
            data(F.to_json(F.struct(F.struct(n.alias("prompt_tokens"), F.col("turn").alias("completion_tokens")).alias("usage")))),
            F.lit("data: [DONE]"),
        )
    )
    body = F.array_join(F.concat(F.array(F.lit(": begins")), say, end), "\r\n\n")
    return conversations.where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("stream"), body.alias("body"))


def event_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn put together again from the event lines of its stream."""
    bodies = streamed_bodies(table(spark, sf_dir, "conversations"))
    r = event_lines.replies(event_lines.lines_of(bodies, "stream", "body"))
    return r.select("stream", F.md5("text").alias("text_md5"), "stop_reason", "input_tokens", "output_tokens", "error")


def loose_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's JSON properties hold, and what is left of them when their first character is lost."""
    v, cut = ct.loose(F.col("props")), ct.error_of(F.substring("props", 2, 2**31 - 1))
    return table(spark, sf_dir, "events").select(
        "event_id", F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.k.x", "string").alias("none"), cut["message"].alias("rest"), cut["code"].alias("code")
    )


def error_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as their services report them: by type of the user's event an object, a text, a list, or no JSON."""
    e = table(spark, sf_dir, "events")
    text, code = F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"')), F.col("value").cast("string")
    said = F.concat(F.lit('{"message":'), text, F.lit(',"code":'), code, F.lit("}"))
    body = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"error":'), said, F.lit("}")))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"error":'), text, F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"errors":['), said, F.lit("]}")))
        .when(F.col("event_type") == "signup", said)
        .otherwise(F.concat(F.lit("busy "), "props"))
    )
    r = ct.error_of(body)
    return e.where("value is not null").select("event_id", r["message"].alias("message"), r["code"].cast("double").alias("code"))


#: What a request made of an event has to be.
REQUEST = [
    ct.Field("$.action", "STRING", required=True, enum=("click", "view", "purchase")),
    ct.Field("$.value", "DOUBLE", required=True, least=1, most=90),
    ct.Field("$.options", "OBJECT"),
    ct.Field("$.options.k", "BIGINT", required=True, most=50),
    ct.Field("$.at", "STRING", most_chars=25),
]


def request_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a request made of an event breaks."""
    e = table(spark, sf_dir, "events")
    body = F.concat(
        F.lit('{"action":"'), "event_type", F.lit('","value":'), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit(',"at":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('","options":'), "props",
        F.when(F.col("value") > 95, "").otherwise("}"),
    )
    return ct.violations(e.select("event_id", body.alias("body")), "body", REQUEST)


def signed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token for each customer, and who may still come in with it at the end of 2024; those in debt have changed a character."""
    c = table(spark, sf_dir, "customer")
    payload = F.concat(F.lit('{"id":'), F.col("c_custkey").cast("string"), F.lit(',"name":"'), "c_name", F.lit('","exp":'), (F.lit(1_735_689_600_000) + F.floor(F.col("c_acctbal") - 5000).cast("long") * 1000).cast("string"), F.lit("}"))
    token = ct.sealed(payload, F.lit("secret"))
    shown = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("x"), token)).otherwise(token)
    return c.select("c_custkey", token.alias("token"), ct.opened(shown, F.lit("secret"), F.lit(1_735_689_600_000)).alias("payload"))


QUERIES = {f.__name__: f for f in (event_replies, loose_props, error_layouts, request_violations, signed_tokens)}
ORACLES = {
    "loose_props": """
SELECT event_id, CASE WHEN props IS NOT NULL THEN 'OBJECT<k: BIGINT>' END AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS none, substr(props, 2) AS rest, CAST(NULL AS VARCHAR) AS code FROM events""",
    "error_layouts": """
SELECT event_id, CASE WHEN event_type IN ('error', 'click', 'view', 'signup') THEN props ELSE 'busy ' || props END AS message, CASE WHEN event_type IN ('error', 'view', 'signup') THEN value END AS code FROM events WHERE value IS NOT NULL""",
    "request_violations": """
SELECT event_id, '$' AS path, 'json' AS rule FROM events WHERE value > 95
UNION ALL SELECT event_id, '$.action', 'enum' FROM events WHERE NOT coalesce(value > 95, false) AND event_type NOT IN ('click', 'view', 'purchase')
UNION ALL SELECT event_id, '$.value', 'type' FROM events WHERE value IS NULL
UNION ALL SELECT event_id, '$.value', 'range' FROM events WHERE value < 1 OR (value > 90 AND value <= 95)
UNION ALL SELECT event_id, '$.options.k', 'range' FROM events WHERE NOT coalesce(value > 95, false) AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 50
UNION ALL SELECT event_id, '$.at', 'length' FROM events WHERE NOT coalesce(value > 95, false)""",
    "signed_tokens": """
WITH p AS (SELECT c_custkey, c_acctbal, 1735689600000 + CAST(floor(c_acctbal - 5000) AS BIGINT) * 1000 AS exp, '{"id":' || c_custkey || ',"name":"' || c_name || '","exp":' || (1735689600000 + CAST(floor(c_acctbal - 5000) AS BIGINT) * 1000) || '}' AS payload FROM customer),
b AS (SELECT *, rtrim(translate(to_base64(encode(payload)), '+/', '-_'), '=') AS coded FROM p)
SELECT c_custkey, coded || '.' || sha256(unhex('2F393F2E3928' || repeat('5C', 58)) || unhex(sha256(unhex('455355445342' || repeat('36', 58)) || encode('sim:' || coded)))) AS token,
       CASE WHEN c_acctbal >= 0 AND exp > 1735689600000 THEN payload END AS payload FROM b""",
    "event_replies": """
SELECT conv_id || '-' || turn AS stream, md5(text) AS text_md5, CASE role WHEN 'user' THEN 'end' ELSE 'max_tokens' END AS stop_reason,
       length(text) AS input_tokens, turn AS output_tokens, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE text IS NOT NULL""",
}
