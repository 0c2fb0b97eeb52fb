"""Text segments of HTML pages.

The markup is tolerant (unclosed tags, scripts with markup in strings), which
patterns cannot follow, so pages pass through the standard parser inside the
scan; all that follows is plain columns.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Block tags that hold a segment, with its role.
ROLES = {"p": "paragraph", "li": "list", "td": "cell", "th": "cell", "blockquote": "quote", "figcaption": "caption", "caption": "caption", "dt": "list", "dd": "list", "pre": "paragraph", "footer": "paragraph", "div": "paragraph", "title": "title"}
ROLES |= {f"h{n}": "heading" for n in range(1, 7)}
SKIPPED = {"script", "style", "noscript", "template"}
_INLINE = {"b", "i", "em", "strong", "a", "span", "sup", "sub", "u", "small", "q", "cite", "code"}
_SCHEMA = "page_id long, i long, tag string, role string, level long, src string"


class _Walk(HTMLParser):
    """Collects segments; inline tags become numbered markers so that their place survives."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.tag, self.parts, self.skip, self.open, self.n = [], "p", [], 0, [], 0

    def close_segment(self):
        src = " ".join("".join(self.parts).split())
        if src:
            level = int(self.tag[1]) if ROLES[self.tag] == "heading" else None
            self.found.append((self.tag, ROLES[self.tag], level, src))
        self.parts, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ROLES:
            self.close_segment()
            self.tag = tag
        elif tag == "br":
            self.n += 1
            self.parts.append(f"<br_{self.n}/>")
        elif tag in _INLINE:
            self.n += 1
            self.open.append((tag, self.n))
            self.parts.append(f"<{tag}_{self.n}>")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ROLES:
            self.close_segment()
            self.tag = "p"
        elif tag in _INLINE:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.parts.append(f"</{tag}_{self.open.pop(k)[1]}>")
                    break

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data.replace("<", "&lt;").replace(">", "&gt;"))


def segments(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, i, tag, role, level, src) in document order; null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                walk = _Walk()
                walk.feed(text or "")
                walk.close()
                walk.close_segment()
                rows += [(page, i, *s) for i, s in enumerate(walk.found)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "i", "tag", "role", "level", "src"])

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, _SCHEMA)


@F.arrow_udf(StringType())
def decoded(text: pa.Array) -> pa.Array:
    """Character references as characters."""
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())
