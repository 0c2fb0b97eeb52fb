"""Compact inline markup and model replies: repair, parsing, limits."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from itertools import count

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

_TAG = re.compile(r"<\s*(/?)\s*([A-Za-z][\w-]*)_(\d+)\s*(/?)\s*>")
#: A line end, written plainly or as an escaped tag, with the blanks around it.
_LINE_END = re.compile(r"[ \t]*(?:\r\n|\r|\n|&lt;br */?&gt;)[ \t]*", re.I)
REPAIRED = StructType([StructField("markup", StringType()), StructField("missing", ArrayType(IntegerType())), StructField("issues", IntegerType())])


def _escaped(text: str) -> str:
    return html.unescape(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _closings(marks: list[tuple[int, bool]]) -> list[int | None]:
    """For each mark (number, is it a closing one) the place at which it ends: of an opening one the mark that closes it.

    A closing mark ends the last open one of its number and all that were opened
    since. What is left open ends behind the last mark; a closing mark without an
    open one has None.
    """
    ends: list[int | None] = [None] * len(marks)
    still: list[int] = []
    for place, (number, closing) in enumerate(marks):
        if not closing:
            still.append(place)
            continue
        depth = max((d for d, opened in enumerate(still) if marks[opened][0] == number), default=len(still))
        for opened in still[depth:]:
            ends[opened] = place
        if depth < len(still):
            ends[place] = still[depth]
        still = still[:depth]
    for opened in still:
        ends[opened] = len(marks)
    return ends


def repaired(markup: str, names: dict[int, str], voids: set[int]) -> tuple[str, list[int], int]:
    """Valid nesting of the known tags: (markup, tags that are lost, repairs).

    First each opening mark is given its end, then the text is written with every
    tag closed there, the innermost first. Unknown marks go, void tags close
    themselves.
    """
    found = list(_TAG.finditer(markup))
    paired = [m for m in found if int(m[3]) in names and int(m[3]) not in voids and not (m[4] and not m[1])]
    ends = _closings([(int(m[3]), bool(m[1])) for m in paired])
    place = {m.start(): i for i, m in enumerate(paired)}
    closes: dict[int, list[int]] = {}
    for i, m in enumerate(paired):
        if not m[1]:
            closes.setdefault(ends[i], []).insert(0, i)
    tag = lambda i: f"{names[int(paired[i][3])]}_{int(paired[i][3])}"
    # a tag that another's end or the end of the text closes is a repair, as is a mark that stands for nothing
    issues = sum(1 for i, m in enumerate(paired) if (not m[1] and (ends[i] == len(paired) or ends[ends[i]] != i)) or (m[1] and ends[i] is None))
    parts, upto = [], 0
    for m in found:
        parts.append(_escaped(markup[upto : m.start()]))
        upto, number, i = m.end(), int(m[3]), place.get(m.start())
        if i is not None:
            parts += [f"</{tag(j)}>" for j in closes.get(i, [])] if m[1] else [f"<{tag(i)}>"]
        elif number in voids and number in names:
            parts += [] if m[1] else [f"<{names[number]}_{number}/>"]
        else:
            issues += 1
    parts.append(_escaped(markup[upto:]))
    parts += [f"</{tag(j)}>" for j in closes.get(len(paired), [])]
    kept = {int(m[3]) for m in found if not m[1] and (m.start() in place or int(m[3]) in voids)}
    return "".join(parts).strip(), [k for k in names if k not in kept], issues


def with_breaks(markup: str, missing: list[int], names: dict[int, str]) -> tuple[str, list[int]]:
    """Lost line breaks put between the text's lines, if it has one more than breaks are lost; else nothing changes."""
    lost = [f"<br_{k}/>" for k in missing if names[k] == "br"]
    lines = _LINE_END.split(markup)
    if not lost or len(lines) != len(lost) + 1:
        return markup, missing
    return "".join(line + tag for line, tag in zip(lines, [*lost, ""], strict=True)), [k for k in missing if names[k] != "br"]


#: Inline elements of a reader's page for those of the book.
SHOWN = {
    "em": "em", "i": "em", "cite": "em", "dfn": "em", "var": "em", "strong": "strong", "b": "strong", "u": "u", "ins": "u", "s": "s", "strike": "s", "del": "s",
    "sup": "sup", "sub": "sub", "small": "small", "q": "q", "code": "code", "kbd": "code", "tt": "code",
}
#: Class of a span by the beginnings of words in its own tag that speak of italics, bold or small capitals.
LOOKS = {"it": ("ital", "em"), "bd": ("bold", "strong"), "sc": ("small-caps", "smallcaps")}


def look_of(opening: str) -> str | None:
    """The first look that an opening tag names; ``sc`` alone is a name too."""
    words = re.findall(r"[\w-]+", opening.lower())
    parts = [*words, *(part for w in words for part in w.split("-"))]
    return next((look for look, names in LOOKS.items() if any(p.startswith(names) for p in parts) or look in ("sc",) and "sc" in parts), None)


def safe_name(name: str) -> str:
    """A name of ASCII letters, digits and hyphens that doesn't begin with one."""
    return "".join(c if c.isascii() and c.isalnum() else "-" for c in name).lstrip("-") or "x"


def _spelled(markup: str, known: set[int], voids: set[int], opened, closed, void) -> str:
    """Markup with each known tag written by one of three functions of its number; every tag that opens is closed."""
    marks = [m for m in _TAG.finditer(markup) if int(m[3]) in known]
    nested = [m for m in marks if int(m[3]) not in voids and not (m[4] and not m[1])]
    ends = _closings([(int(m[3]), bool(m[1])) for m in nested])
    numbers = [int(m[3]) for m in nested]
    place = {m.start(): i for i, m in enumerate(nested)}
    written, upto = [], 0

    def close(at: int) -> None:
        written.extend(closed(numbers[i]) for i in reversed(range(min(at, len(nested)))) if ends[i] == at and not nested[i][1])

    for m in _TAG.finditer(markup):
        written.append(_escaped(markup[upto : m.start()]))
        upto, number, i = m.end(), int(m[3]), place.get(m.start())
        if i is not None and m[1]:
            close(i)
        elif i is not None:
            written.append(opened(number))
        elif number in voids and number in known and not m[1]:
            written.append(void(number))
    written.append(_escaped(markup[upto:]))
    close(len(nested))
    return "".join(written)


def xhtml(markup: str, tags: dict[int, tuple[str, str, bool]], ids: set[str]) -> str:
    """The book's own tags (name, opening tag, void) in place of the numbered ones; an id that ``ids`` holds already goes."""

    def own(number: int) -> str:
        tag = tags[number][1]
        found = re.search(r'\sid="([^"]*)"', tag)
        if found and found[1] in ids:
            return tag.replace(found[0], "")
        ids.update(found.groups() if found else ())
        return tag

    voids = {k for k, t in tags.items() if t[2]}
    return _spelled(markup, set(tags), voids, own, lambda k: f"</{tags[k][0]}>", own)


def safe_html(markup: str, tags: dict[int, tuple[str, str, bool]]) -> str:
    """For a reader's page: known inline elements without the book's attributes, each with its number, so that edits can be read back."""
    element = {k: SHOWN.get(name.lower(), "span") for k, (name, _, _) in tags.items()}

    def opened(k: int) -> str:
        look = look_of(tags[k][1]) if element[k] == "span" else None
        return f'<{element[k]} data-k="{k}"' + (f' class="{look}">' if look else ">")

    def void(k: int) -> str:
        line = f'<br data-k="{k}">'
        return line if tags[k][0] == "br" else f'<span data-k="{k}" data-v="1" class="inline-object" contenteditable="false"></span>'

    return _spelled(markup, set(tags), {k for k, t in tags.items() if t[2]}, opened, lambda k: f"</{element[k]}>", void)


RENDERED = StructType([StructField("xhtml", StringType()), StructField("html", StringType())])


@F.arrow_udf(RENDERED)
def rendered(markup: pa.Array, tags: pa.Array) -> pa.Array:
    """``markup`` as the book's XHTML and as a page's HTML; ``tags`` is an array of (k, name, opening, void)."""
    rows = []
    for text, known in zip(markup.to_pylist(), tags.to_pylist(), strict=True):
        by = {t["k"]: (t["name"], t["opening"], t["void"]) for t in known or []}
        rows.append(None if text is None else {"xhtml": xhtml(text, by, set()), "html": safe_html(text, by)})
    return pa.array(rows, pa.struct([("xhtml", pa.string()), ("html", pa.string())]))


@F.arrow_udf(REPAIRED)
def repair(markup: pa.Array, source: pa.Array) -> pa.Array:
    """An output's markup against its source's tags, with line breaks and then other lost void tags put back."""
    rows = []
    for out, src in zip(markup.to_pylist(), source.to_pylist(), strict=True):
        if out is None:
            rows.append(None)
            continue
        names, voids = {}, set()
        for m in _TAG.finditer(src or ""):
            names.setdefault(int(m[3]), m[2])
            if m[4]:
                voids.add(int(m[3]))
        text, missing, issues = repaired(out, names, voids)
        text, missing = with_breaks(text, missing, names)
        text += "".join(f"<{names[k]}_{k}/>" for k in missing if k in voids and names[k] != "br")
        rows.append({"markup": text, "missing": missing, "issues": issues})
    return pa.array(rows, pa.struct([("markup", pa.string()), ("missing", pa.list_(pa.int32())), ("issues", pa.int32())]))


class _EditReader(HTMLParser):
    """A page's edited HTML as a tree: texts, breaks, numbered elements of the book, and what the reader has added."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree: list[dict] = []
        self.open: list[tuple[str, list[dict]]] = [("", self.tree)]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        number = given.get("data-k") or ""
        node: dict = {"c": []}
        if number.isascii() and number.isdigit():
            node["k"] = int(number)
        elif tag == "br":
            node = {"br": True}
        elif tag in ("em", "i", "strong", "b"):
            node["f"] = SHOWN[tag]
        self.open[-1][1].append(node)
        if tag not in ("br", "img", "hr", "wbr", "input"):
            self.open.append((tag, node.setdefault("c", [])))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1][1].append({"x": data})


def edit_tree(page: str) -> list[dict]:
    """The edit tree of a page's HTML: nodes with ``x`` (text), ``br``, ``k`` (number of a tag of the book) or ``f`` (em or strong), children in ``c``."""
    reader = _EditReader()
    reader.feed(page)
    reader.close()
    return reader.tree


#: Fixed value: levels below the first that an edit may have.
EDIT_DEPTH = 20


def from_edit(tree: list[dict], tags: dict[int, tuple[str, str, bool]]) -> tuple[str, dict[int, tuple[str, str, bool]]]:
    """Markup of an edit tree, and the tags it has added, numbered on from the largest.

    Unknown numbers and other nodes give their children; elements left without
    content go; what lies deeper than ``EDIT_DEPTH`` is cut; white space collapses.
    """
    added: dict[int, tuple[str, str, bool]] = {}
    numbers = count(max(tags, default=0) + 1)
    written: list[str] = []
    # a stack of what is still to be written: a node with its depth, or an element to be closed with where it was opened
    todo: list[tuple[dict | str, int]] = [(n, 0) for n in reversed(tree)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str):
            name, new = node.split("|")
            if len(written) == depth + 1:
                written.pop()
            else:
                label = name
                if new:  # numbers of added elements are dealt when they end, inner ones first
                    number = next(numbers)
                    added[number] = (name, f"<{name}>", False)
                    label = f"{name}_{number}"
                written[depth] = f"<{label}>"
                written.append(f"</{label}>")
            continue
        if isinstance(node.get("x"), str):
            if node["x"]:
                written.append(html.escape(node["x"], quote=False))
            continue
        k, f = node.get("k"), node.get("f")
        tag = tags.get(k) if isinstance(k, int) and not isinstance(k, bool) else None
        if node.get("br"):
            number = next(numbers)
            added[number] = ("br", "<br/>", True)
            written.append(f"<br_{number}/>")
            continue
        if tag is not None and tag[2]:
            written.append(f"<{safe_name(tag[0])}_{k}/>")
            continue
        element = f"{safe_name(tag[0])}_{k}|" if tag is not None else f"{f}|new" if not isinstance(k, int) and f in ("em", "strong") else None
        if element:
            todo.append((element, len(written)))
            written.append("")
        if depth < EDIT_DEPTH:
            todo += [(n, depth + 1) for n in reversed(node.get("c") or [])]
    return " ".join("".join(written).split()), added


EDITED = StructType(
    [
        StructField("markup", StringType()),
        StructField("added", ArrayType(StructType([StructField("k", IntegerType()), StructField("name", StringType()), StructField("opening", StringType()), StructField("void", BooleanType())]))),
    ]
)


@F.arrow_udf(EDITED)
def edited(page: pa.Array, tags: pa.Array) -> pa.Array:
    """A page's edited HTML back as markup, with the tags that the edit has added; ``tags`` is an array of (k, name, opening, void)."""
    rows = []
    for text, known in zip(page.to_pylist(), tags.to_pylist(), strict=True):
        if text is None:
            rows.append(None)
            continue
        markup, added = from_edit(edit_tree(text), {t["k"]: (t["name"], t["opening"], t["void"]) for t in known or []})
        rows.append({"markup": markup, "added": [{"k": k, "name": n, "opening": o, "void": v} for k, (n, o, v) in sorted(added.items())]})
    kind = pa.struct([("k", pa.int32()), ("name", pa.string()), ("opening", pa.string()), ("void", pa.bool_())])
    return pa.array(rows, pa.struct([("markup", pa.string()), ("added", pa.list_(kind))]))


def without_reasoning(text: Column) -> Column:
    """Everything up to the last closing think tag before the first segment goes."""
    return F.regexp_replace(text, r"(?is)^(?:(?!<seg\s+id).)*</think>", "")


def reply_segments(text: Column) -> Column:
    """Array of (id, body) of a reply; a body ends at its closing tag or at the next segment."""
    found = F.regexp_extract_all(without_reasoning(text), F.lit(r"(?s)<seg\s+id\s*=\s*[\"']?\d+[\"']?\s*>.*?(?:</seg\s*>|(?=<seg\s+id\s*=|<new_terms>))"), F.lit(0))
    body = lambda s: F.regexp_replace(F.regexp_replace(s, r"(?s)^<seg[^>]*>\s*", ""), r"(?s)\s*</seg\s*>$", "")
    return F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"(\d+)", 1).cast("long").alias("id"), body(s).alias("body")))


#: What gives a reply its structure.
_MARK = r"(?i)<seg\s+id\s*=[^>]*>|</seg\s*>|<new_terms>|</new_terms>|</?think>"


def reasoning_marks(text: Column) -> Column:
    """(open, close): where think tags stand, counted from 0, but for those between a segment's own tags, which are the book's."""
    pieces, marks = F.split(text, _MARK, -1), F.transform(F.regexp_extract_all(text, F.lit(_MARK), F.lit(0)), F.lower)

    def placed(s: Column) -> Column:
        p, m = s["p"], s["m"]
        # where each mark begins: all pieces up to it and all marks before it
        at = F.aggregate(
            F.sequence(F.lit(0), F.size(m)),
            F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
            lambda acc, i: F.struct((acc["n"] + F.coalesce(F.length(F.get(p, i)), F.lit(0)) + F.coalesce(F.length(F.get(m, i)), F.lit(0))).alias("n"), F.array_append(acc["at"], acc["n"] + F.coalesce(F.length(F.get(p, i)), F.lit(0))).alias("at")),
            lambda acc: acc["at"],
        )
        other = lambda x: ~F.contains(x, F.lit("think"))
        before = lambda i: F.try_element_at(F.filter(F.slice(m, F.lit(1), i), other), F.lit(-1))
        after = lambda i: F.get(F.filter(F.slice(m, i + 2, F.size(m)), other), F.lit(0))
        inside = lambda i: F.coalesce(before(i).startswith("<seg") & after(i).startswith("</seg"), F.lit(False))
        of = lambda tag: F.array_compact(F.transform(m, lambda x, i: F.when((x == tag) & ~inside(i), F.get(at, i))))
        return F.struct(of("<think>").alias("open"), of("</think>").alias("close"))

    return F.transform(F.array(F.struct(pieces.alias("p"), marks.alias("m"))), placed)[0]


def new_terms(text: Column, source: Column | None = None) -> Column:
    """Array of (term, translation, kind) lines of a reply's block of new terms, at most 20; with ``source`` only terms that it mentions."""
    from quirespark.operators.glossary import mentions

    block = F.regexp_extract(without_reasoning(text), r"(?s)<new_terms>(.*?)</new_terms>", 1)
    line = r"^\s*[-*]?\s*(.+?)\s*=>\s*([^|]+?)\s*(?:\|\s*([A-Za-z]+))?\s*$"
    kind = lambda s: F.lower(F.regexp_extract(s, line, 3))
    parsed = F.transform(
        F.filter(F.split(block, "\n"), lambda s: s.rlike(line)),
        lambda s: F.struct(
            F.regexp_extract(s, line, 1).alias("term"),
            F.regexp_extract(s, line, 2).alias("translation"),
            F.when(kind(s).isin("character", "place", "organization", "term"), kind(s)).otherwise("other").alias("kind"),
        ),
    )
    fits = F.filter(parsed, lambda t: (F.length(t["term"]) <= 80) & (F.length(t["translation"]) <= 120))
    if source is not None:
        fits = F.filter(fits, lambda t: mentions(source, t["term"]))
    return F.slice(fits, 1, 20)


def limit_daily(message: Column) -> Column:
    return message.rlike(r"(?i)per day|\bTPD\b|\bRPD\b|ByDay|86400\s*s|daily")


def limit_wait_ms(message: Column) -> Column:
    """Milliseconds that a service asks to wait (``try again in 1h2m3.5s``, ``wait 39 seconds``), or null."""
    t = F.regexp_extract(message, r"(?i)try again in\s+((?:\d+h)?(?:\d+m)?(?:[\d.]+s)?|[\d.]+ms)", 1)
    part = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, p, 1), F.lit("")), F.lit("999999999.999")).cast("double"), F.lit(0.0))
    spelt = (part(r"(\d+)h") * 3600 + part(r"(\d+)m(?!s)") * 60 + part(r"(\d+(?:\.\d+)?)s")) * 1000
    plain = F.nullif(F.regexp_extract(message, r"(?i)wait\s+(\d+)\s*seconds", 1), F.lit("")).cast("double") * 1000
    return F.nullif(F.ceil(F.coalesce(plain, F.when(t != "", spelt))).cast("long"), F.lit(0).cast("long"))
