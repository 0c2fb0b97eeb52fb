"""Text scalars as native column expressions.

String positions and lengths count code points (not UTF-16 units), which is
the same on BMP text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word, and the scripts that are written without spaces.
WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
DENSE = r"[぀-ヿ㐀-鿿가-힯]"
#: Special spaces and apostrophes that compare as plain ones.
APOSTROPHES, SPACES = "’‘ʼ`´", "     "


def word_count(text: Column) -> Column:
    """Words of a text; null counts as none. Unspaced scripts count round(chars / 1.5)."""
    t = F.coalesce(text, F.lit(""))
    dense = F.regexp_count(t, F.lit(DENSE)).cast("long")
    plain = F.regexp_count(t, F.lit(WORD)).cast("long")
    spaced = F.regexp_count(F.regexp_replace(t, DENSE, " "), F.lit(WORD)).cast("long")
    ascii_only = F.octet_length(t) == F.length(t)  # spares most texts the search for unspaced scripts
    return F.when(ascii_only | (dense == 0), plain).otherwise(F.floor(dense / F.lit(1.5) + F.lit(0.5)).cast("long") + spaced)


def has_meaning(text: Column) -> Column:
    """Any letter or digit."""
    return text.rlike(r"[\p{L}\p{N}]")


def has_words(text: Column) -> Column:
    """Any letter."""
    return text.rlike(r"\p{L}")


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}")).cast("long")


def alnum(text: Column) -> Column:
    """Letters and digits, the size by which lengths are compared."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")).cast("long")


def collapse(text: Column) -> Column:
    """Runs of ASCII white space become one space; other spaces stay."""
    return F.regexp_replace(text, r"[ \t\n\r\f]+", " ")


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something is cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"(?U)\s+$", ""), F.lit("…")))


def cover_title(title: Column, most: int = 78) -> Column:
    """Cut at a word where the last space lies beyond 60 % of the room, without trailing punctuation."""
    cut = F.substring(title, 1, most)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    at_word = F.when((F.instr(cut, " ") > 0) & (space > most * 0.6), F.left(cut, space)).otherwise(cut)
    return F.when(F.length(title) <= most, title).otherwise(F.concat(F.regexp_replace(at_word, r"[\s,;:.\-–—]+$", ""), F.lit("…")))


def title_fit(title: Column) -> Column:
    """normal, long or xlong, by the title's and its longest word's length."""
    longest = F.array_max(F.transform(F.split(title, r"\s+", -1), F.length))
    return F.when((F.length(title) > 60) | (longest > 14), "xlong").when((F.length(title) > 30) | (longest > 10), "long").otherwise("normal")


def format_bytes(n: Column) -> Column:
    kb, mb = 1024.0, 1024.0 * 1024
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.concat(F.round(n / kb).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.replace(F.format_string("%.1f", n / mb), F.lit("."), F.lit(",")), F.lit(" MB")))
    )


def escape_xml(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def escape_ampersands(text: Column) -> Column:
    """An & that begins no entity is escaped."""
    return F.regexp_replace(text, r"&(?!(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def folded_term(text: Column) -> Column:
    """A term as it is compared: plain apostrophes and spaces, lower case, single spaces."""
    plain = F.translate(F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES)), SPACES, " " * len(SPACES))
    return F.regexp_replace(F.lower(F.trim(plain)), r"\s+", " ")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over characters, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF))


def strip_markup(markup: Column) -> Column:
    """Text of compact inline markup (<em_1>, </em_1>, <br_2/>) with basic entities decoded."""
    t = F.regexp_replace(markup, r"</?[a-zA-Z][a-zA-Z0-9]*_\d+/?>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def tag_ids(markup: Column) -> Column:
    """Distinct marker numbers of compact inline markup, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(markup, F.lit(r"<[a-zA-Z][a-zA-Z0-9]*_(\d+)/?>"), F.lit(1)))


@F.pandas_udf(StringType())
def slug(text: pd.Series) -> pd.Series:
    """ASCII words joined by hyphens, at most 60 characters; ``livro`` where nothing is left. NFKD has no built-in."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ")
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in plain).split()
        return "-".join(words)[:60] or "livro"

    return text.map(one)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
