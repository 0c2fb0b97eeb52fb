"""Column expressions on a book's package: entry paths, declarations, contents lists and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved_path(folder: Column, href: Column) -> Column:
    """The archive entry that a reference from ``folder`` names: decoded, without query and fragment, dot segments worked out."""
    bare = F.regexp_extract(href, r"(?s)^[^?#]*", 0)
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit(".")), decoded), "/"), lambda x: ~x.isin("", "."))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    return F.array_join(kept, "/")


def declared_utf8(source: Column) -> Column:
    """An XML declaration that names an encoding names UTF-8."""
    return F.regexp_replace(source, r"(?i)^(\s*<\?xml\b[^>]*\bencoding\s*=\s*)(?:\"[^\"]*\"|'[^']*')", "$1\"utf-8\"")


def in_language(source: Column, language: Column) -> Column:
    """The html element's lang and xml:lang name ``language``; the element's other attributes stay."""
    tag = F.regexp_extract(source, r"(?i)<html\b[^>]*>", 0)
    bare = F.regexp_replace(tag, r"(?i)\s(?:xml:)?lang\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")
    named = F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(' xml:lang="'), language, F.lit('" lang="'), language, F.lit('">'))
    return F.when(tag == "", source).otherwise(F.replace(source, tag, named))


#: Offsets and multipliers of the two 32-bit halves of a short hash.
_FIRST, _SECOND = (0x811C9DC5, 0x01000193), (0x01000193, 0x5BD1E995)


def short_hash(text: Column) -> Column:
    """Twelve hex digits over a text's UTF-16 units."""
    units = F.transform(F.sequence(F.lit(1), F.length(F.hex(F.encode(text, "UTF-16BE"))), F.lit(4)), lambda i: F.conv(F.substring(F.hex(F.encode(text, "UTF-16BE")), i, F.lit(4)), 16, 10).cast("long"))

    def half(units: Column, start: Column, factor: int) -> Column:
        # a product of 32 bits each is taken in two parts, as 64 signed bits may not hold it
        low, high = factor & 0xFFFF, factor >> 16
        times = lambda h: F.pmod(h * low + F.shiftleft(F.pmod(h * high, F.lit(1 << 16)), 16), F.lit(1 << 32))
        return F.aggregate(units, start.cast("long"), lambda h, u: times(h.bitwiseXOR(u)))

    def both(u: Column) -> Column:
        digits = lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")
        n = F.size(u).cast("long")
        return F.left(F.concat(digits(half(u, F.lit(_FIRST[0]), _FIRST[1])), digits(half(u, F.lit(_SECOND[0]).cast("long").bitwiseXOR(n), _SECOND[1]))), F.lit(12))

    return F.transform(F.array(F.when(F.length(text) > 0, units).otherwise(F.array().cast("array<bigint>"))), both)[0]


def _plain(xml: Column) -> Column:
    """Text of XML: the five named entities and blanks."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        xml = F.replace(xml, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(xml, r"\s+", " "))


def _as_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _cut(xml: Column) -> Column:
    """Tags, each with the text behind it; comments and scripts stay whole where they hold no tag."""
    return F.split(xml, r"(?=<[A-Za-z/!?])", -1)


def _name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"^<(?:[\w.-]+:)?([A-Za-z][\w.-]*)", 1))


def relabelled(xml: Column, labels: Column, tags: list[str], inside: str | None = None) -> Column:
    """Elements named in ``tags`` whose whole text is a key of ``labels`` get its value; with ``inside`` only where that element opens right before.

    An element with elements of its own keeps its text.
    """

    def renamed(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            head = F.regexp_extract(piece, r"^<[^>]*>", 0)
            body = F.substring(piece, F.length(head) + 1, F.length(piece))
            label = F.try_element_at(labels, _plain(body))
            fits = _name(piece).isin(*tags) & F.coalesce(F.get(pieces, i + 1), F.lit("")).startswith("</")
            fits = fits & (_name(F.get(pieces, i - 1)) == inside) if inside else fits
            return F.when(fits & label.isNotNull(), F.concat(head, _as_xml(label))).otherwise(piece)

        return F.array_join(F.transform(pieces, one), "")

    return F.transform(F.array(_cut(xml)), renamed)[0]


def with_text(xml: Column, tag: str, text: Column, drop_others: bool = False) -> Column:
    """The first element named ``tag``, whatever its prefix, with ``text``; the others can go. Without such an element nothing changes."""
    parts = F.split(xml, rf"(?i)(?=<(?:[\w.-]+:)?{tag}[\s>/])", 2)
    whole = rf"(?is)<((?:[\w.-]+:)?{tag})(?:\s[^>]*)?(?:/>|>.*?</\1\s*>)"
    own = F.regexp_extract(parts[1], rf"(?is)^{whole[5:]}", 0)
    opening = F.regexp_replace(F.regexp_extract(own, r"^<[^>]*>", 0), r"\s*/?>$", ">")
    new = F.concat(opening, _as_xml(text), F.lit("</"), F.regexp_extract(own, r"^<([^\s>/]+)", 1), F.lit(">"))
    rest = F.substring(parts[1], F.length(own) + 1, F.length(parts[1]))
    rest = F.regexp_replace(rest, whole, "") if drop_others else rest
    return F.when((F.size(parts) > 1) & (own != ""), F.concat(parts[0], new, rest)).otherwise(xml)


def package_document(opf: Column, language: Column, title: Column, now: Column) -> Column:
    """A package document in its new language: one language, the title if there is a new one, and when it was changed for EPUB 3."""
    tag = r"(?i)<(?:[\w.-]+:)?package\b[^>]*>"
    opening = F.regexp_extract(opf, tag, 0)
    named = F.concat_ws("", F.regexp_replace(opening, r"(?s)(\sxml:lang\s*=\s*)(?:\"[^\"]*\"|'[^']*').*$", "$1"), F.lit('"'), language, F.lit('"'), F.regexp_extract(opening, r"(?s)\sxml:lang\s*=\s*(?:\"[^\"]*\"|'[^']*')(.*)$", 1))
    xml = F.when(opening.rlike(r"\sxml:lang\s*="), F.replace(opf, opening, named)).otherwise(opf)
    at_end = lambda x: F.split(x, r"(?i)(?=</(?:[\w.-]+:)?metadata\s*>)", 2)
    added = lambda x, element: F.when(F.size(at_end(x)) > 1, F.concat(at_end(x)[0], element, at_end(x)[1])).otherwise(x)
    has_language = xml.rlike(r"(?i)<(?:[\w.-]+:)?language[\s>/]")
    xml = F.when(has_language, with_text(xml, "language", language, drop_others=True)).otherwise(added(xml, F.concat(F.lit("<dc:language>"), _as_xml(language), F.lit("</dc:language>"))))
    xml = F.when(title.isNotNull(), with_text(xml, "title", F.coalesce(title, F.lit("")))).otherwise(xml)
    modified = r"(?is)(<meta\s[^>]*property\s*=\s*[\"']dcterms:modified[\"'][^>]*>)[^<]*"
    third = F.regexp_extract(opening, r"(?i)\sversion\s*=\s*[\"'](\d)", 1) == "3"
    stamped = F.when(xml.rlike(modified), F.regexp_replace(xml, modified, F.concat(F.lit("$1"), now))).otherwise(added(xml, F.concat(F.lit('<meta property="dcterms:modified">'), now, F.lit("</meta>"))))
    return F.when(third, stamped).otherwise(xml)
