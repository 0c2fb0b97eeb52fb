"""Contracts of JSON texts: error bodies in several layouts as VARIANT (N7, N8), request schemas with a row for each violation (P26), sealed tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loose(body: Column) -> Column:
    """A JSON text as VARIANT; null where it is none."""
    return F.try_parse_json(body)


def error_of(body: Column) -> Column:
    """(message, code) of an error body: an ``error`` that is a text or an object, the first of ``errors``, or the body's own; a body that is no JSON is the message, 500 characters of it at most."""
    v = loose(body)
    at = lambda path: F.try_variant_get(v, path, "string")
    nested = F.schema_of_variant(F.try_variant_get(v, "$.error", "variant")).startswith("OBJECT")
    text = F.when(~F.coalesce(nested, F.lit(False)), at("$.error"))
    message = F.coalesce(text, at("$.error.message"), at("$.errors[0].message"), at("$.message"), F.left(body, F.lit(500)))
    return F.struct(message.alias("message"), F.coalesce(at("$.error.code"), at("$.errors[0].code"), at("$.code")).alias("code"))


@dataclass(frozen=True)
class Field:
    """What a request may say at a path such as ``$.options.instructions``; ``kind`` is a type as VARIANT names it (STRING, BOOLEAN, BIGINT, DOUBLE, OBJECT, ARRAY)."""

    path: str
    kind: str
    required: bool = False
    nullable: bool = False
    enum: tuple[str, ...] = ()
    most_chars: int | None = None
    least: float | None = None
    most: float | None = None


def _broken(v: Column, field: Field) -> list[tuple[str, Column]]:
    """(rule, does the document break it) for one field; a value of the wrong type breaks no other rule."""
    value = F.try_variant_get(v, field.path, "variant")
    kind = F.schema_of_variant(value)
    parent = field.path.rpartition(".")[0]
    inside = F.lit(True) if parent == "$" else F.coalesce(F.schema_of_variant(F.try_variant_get(v, parent, "variant")).startswith("OBJECT"), F.lit(False))
    missing, null = value.isNull(), F.coalesce(kind == "VOID", F.lit(False))
    wide = {"DOUBLE": "^(?:DOUBLE|FLOAT|BIGINT|DECIMAL)"}.get(field.kind, f"^{field.kind}")
    typed = F.coalesce(kind.rlike(wide), F.lit(False))
    text, number = F.try_variant_get(v, field.path, "string"), F.try_variant_get(v, field.path, "double")
    rules = [("type", inside & ~missing & ~typed & (~null if field.nullable else F.lit(True)))]
    if field.required:
        rules.insert(0, ("required", inside & missing))
    if field.enum:
        rules.append(("enum", typed & ~text.isin(*field.enum)))
    if field.most_chars is not None:
        rules.append(("length", typed & (F.length(text) > field.most_chars)))
    if field.least is not None or field.most is not None:
        low, high = (number < field.least if field.least is not None else F.lit(False)), (number > field.most if field.most is not None else F.lit(False))
        rules.append(("range", typed & (low | high)))
    return rules


def violations(requests: DataFrame, body: str, fields: list[Field]) -> DataFrame:
    """The requests' other columns with (path, rule), one row for each rule that a request breaks.

    A body that is no JSON object breaks ``json`` at ``$`` and no other rule. What a
    request says beyond the fields is ignored.
    """
    rest = [c for c in requests.columns if c != body]
    parsed = requests.select(*(F.col(c) for c in rest), loose(F.col(body)).alias("request"))
    v = F.col("request")
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = [F.when(~good, F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule")))]
    for f in fields:
        found += [F.when(good & F.coalesce(broken, F.lit(False)), F.struct(F.lit(f.path).alias("path"), F.lit(rule).alias("rule"))) for rule, broken in _broken(v, f)]
    return parsed.select(*rest, F.explode(F.array_compact(F.array(*found))).alias("v")).select(*rest, "v.path", "v.rule")


#: The block of SHA-256 and the bytes that HMAC fills its two keys with.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def _padded(key: Column, fill: int) -> Column:
    """The key, hashed if it is longer than a block, filled up with zeros and XORed byte by byte."""
    short = F.when(F.octet_length(key) > BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    digits = F.rpad(F.hex(short), BLOCK * 2, "0")
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(fill))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 (RFC 2104) of two binary columns, as bare lower-case hex digits."""
    inner = F.unhex(F.sha2(F.concat(_padded(key, INNER), message), 256))
    return F.sha2(F.concat(_padded(key, OUTER), inner), 256)


def _base64url(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(data), r"\s", ""), "+/", "-_"), "=+$", "")


def sealed(payload: Column, key: Column, purpose: str = "sim:") -> Column:
    """A token: the JSON payload in base64url, a dot, and the signature of purpose and payload."""
    coded = _base64url(F.encode(payload, "UTF-8"))
    return F.concat(coded, F.lit("."), hmac_sha256(F.encode(key, "UTF-8"), F.encode(F.concat(F.lit(purpose), coded), "UTF-8")))


def opened(token: Column, key: Column, now_ms: Column, purpose: str = "sim:") -> Column:
    """A token's payload; null where the signature is another's, the payload is no JSON or its ``exp`` (milliseconds) isn't later than now."""
    parts = F.split(token, r"\.", -1)
    coded, signature = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    right = hmac_sha256(F.encode(key, "UTF-8"), F.encode(F.concat(F.lit(purpose), coded), "UTF-8")) == signature
    filled = F.rpad(F.translate(coded, "-_", "+/"), F.length(coded) + F.pmod(-F.length(coded), F.lit(4)), "=")
    payload = F.try_to_binary(filled, F.lit("base64")).cast("string")
    exp = F.try_variant_get(loose(payload), "$.exp", "double")
    return F.when(right & (exp > now_ms), payload)
