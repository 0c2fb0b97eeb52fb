"""EPUB books as tables (S2 to S10), and a minimal writer."""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most entries and unpacked bytes of an archive.
MOST_ENTRIES, MOST_BYTES = 20_000, 600 * 1024 * 1024


def format_of(content: Column) -> Column:
    """epub or pdf by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 1024))
    return F.when(F.substring(F.hex(content), 1, 8) == "504B0304", "epub").when(F.contains(head, F.lit("255044462D")), "pdf")


def decoded_xml(data: bytes) -> str:
    """Text by its byte order mark, else its declared encoding, else UTF-8; bytes that don't fit are replaced."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    declared = re.match(rb"\s*<\?xml[^>]*\bencoding\s*=\s*[\"']([\w.:-]+)", data[:400])
    try:
        return data.decode(declared[1].decode("ascii") if declared else "utf-8", "replace")
    except LookupError:  # an encoding that Python doesn't know
        return data.decode("utf-8", "replace")


def _local(root, name):
    return [e for e in root.iter() if e.tag.rpartition("}")[2] == name]


def _spine(data: bytes):
    """(href, body, label) of each spine document: OPF manifest and spine, labels from nav or else NCX."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
            raise ValueError("archive is too large")
        names = {n.lower(): n for n in z.namelist()}
        read = lambda path: z.read(names.get(path.lower()) or names[unquote(path).lower()])
        opf_path = _local(ElementTree.fromstring(read("META-INF/container.xml")), "rootfile")[0].get("full-path")
        opf, base = ElementTree.fromstring(read(opf_path)), posixpath.dirname(opf_path)
        manifest = {i.get("id"): i for i in _local(opf, "item")}
        at = lambda href: posixpath.normpath(posixpath.join(base, unquote(href)))
        labels: dict[str, str] = {}
        nav = next((i for i in manifest.values() if "nav" in (i.get("properties") or "").split()), None)
        if nav is not None:
            for a in _local(ElementTree.fromstring(read(at(nav.get("href")))), "a"):
                labels.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(at(nav.get("href"))), unquote((a.get("href") or "").split("#")[0]))), "".join(a.itertext()).strip())
        ncx = next((i for i in manifest.values() if (i.get("media-type") or "").endswith("ncx+xml")), None)
        if not labels and ncx is not None:
            for point in _local(ElementTree.fromstring(read(at(ncx.get("href")))), "navPoint"):
                src, text = _local(point, "content"), _local(point, "text")
                if src and text:
                    labels.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(at(ncx.get("href"))), unquote(src[0].get("src").split("#")[0]))), (text[0].text or "").strip())
        for ref in _local(opf, "itemref"):
            item = manifest.get(ref.get("idref"))
            if item is not None and re.search(r"x?html", (item.get("media-type") or "") + item.get("href")):
                path = at(item.get("href"))
                yield path, decoded_xml(read(path)), labels.get(path)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, href, html, label, error): spine documents of all books under ``path``; a broken book is one row with its error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").where(format_of(F.col("content")) == "epub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, i, *r, None) for i, r in enumerate(_spine(data))]
                except Exception as e:  # any malformed archive
                    rows = [(name, None, None, None, None, str(e) or type(e).__name__)]
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "idx", "href", "html", "label", "error"])

    return files.mapInArrow(run, "path string, idx long, href string, html string, label string, error string")


def epub_bytes(title: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """A book of (title, XHTML body) chapters, with nav; mimetype first and stored."""
    buffer = io.BytesIO()
    page = lambda t, body: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{escape(language)}"><head><title>{escape(t)}</title></head><body>{body}</body></html>'
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        names = [f"c{i:04d}.xhtml" for i in range(len(chapters))]
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
        z.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:language>{escape(language)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{refs}</spine></package>')
        links = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
        z.writestr("OEBPS/nav.xhtml", page(title, f"<nav><ol>{links}</ol></nav>"))
        for n, (t, body) in zip(names, chapters, strict=True):
            z.writestr(f"OEBPS/{n}", page(t, body))
    return buffer.getvalue()


def build_epubs(chapters: DataFrame) -> DataFrame:
    """(book_id, epub): one archive for each book of (book_id, idx, title, body, language); a book's chapters meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, language, held = None, "", []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([book], pa.string()), pa.array([epub_bytes(book, language, held)], pa.binary())], ["book_id", "epub"])

        for batch in batches:
            for b, title, body, lang in zip(*(batch.column(c).to_pylist() for c in ("book_id", "title", "body", "language")), strict=True):
                if b != book and held:
                    yield made()
                    held = []
                book, language = b, lang
                held.append((title, body))
        if held:
            yield made()

    cols = chapters.select(F.col("book_id").cast("string"), "idx", "title", "body", "language")
    return cols.repartition("book_id").sortWithinPartitions("book_id", "idx").mapInArrow(run, "book_id string, epub binary")
