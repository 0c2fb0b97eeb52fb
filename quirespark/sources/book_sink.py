"""Translated books (S24): entries with their texts, contents lists and metadata replaced, and a sink that makes them archives.

``translated`` works on entries as rows, a book's being as many as it has files.
The sink is a data source writer: a task streams its rows into archives under a name
of its own attempt; only when all tasks have ended does the driver move them to
theirs, so a failed and repeated task leaves one whole archive and an aborted job none.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quirespark.functions import package as pk

ENTRIES = "book string, n long, entry string, data binary"


def translated(entries: DataFrame, texts: DataFrame, labels: DataFrame, books: DataFrame, now: Column) -> DataFrame:
    """(book, n, entry, data) with a book's language put into all that names it.

    ``entries`` has (book, n, entry, kind, data); kind is chapter, nav, ncx, opf or
    other. ``texts`` (book, entry, text) replaces chapters, ``labels`` (book, label, new)
    the lists' labels, ``books`` (book, language, title) the metadata. Entries of
    books that ``books`` hasn't, and chapters without a text, stay as they are; so do their bytes.
    """
    known = labels.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct(F.trim(F.regexp_replace("label", r"\s+", " ")), "new"))).alias("labels"))
    joined = entries.join(texts.select("book", "entry", "text"), ["book", "entry"], "left").join(known, "book", "left").join(books.select("book", "language", "title"), "book", "left")
    xml, none = F.col("data").cast("string"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    to, title = F.coalesce("labels", none), F.col("title")
    nav = pk.relabelled(xml, to, ["a", "span", "h1", "h2"])
    nav = pk.in_language(F.when(title.isNotNull(), pk.with_text(nav, "title", F.coalesce(title, F.lit("")))).otherwise(nav), F.col("language"))
    ncx = pk.relabelled(xml, to, ["text"], inside="navlabel")
    heading = F.map_from_arrays(F.array(F.regexp_replace(F.trim(F.regexp_extract(xml, r"(?is)<docTitle\b[^>]*>\s*<text\b[^>]*>([^<]*)", 1)), r"\s+", " ")), F.array(title))
    ncx = F.when(title.isNotNull(), pk.relabelled(ncx, heading, ["text"], inside="doctitle")).otherwise(ncx)
    ncx = F.regexp_replace(ncx, r"(?is)(<ncx\b[^>]*\sxml:lang\s*=\s*)(?:\"[^\"]*\"|'[^']*')", F.concat(F.lit('$1"'), F.col("language"), F.lit('"')))
    kind = F.col("kind")
    new = (
        F.when(kind == "chapter", F.col("text"))
        .when(kind == "nav", nav)
        .when(kind == "ncx", ncx)
        .when(kind == "opf", pk.package_document(xml, F.col("language"), title, now))
    )
    return joined.select("book", F.col("n").cast("long").alias("n"), "entry", F.when(F.col("language").isNotNull() & new.isNotNull(), F.encode(new, "UTF-8")).otherwise(F.col("data")).alias("data"))


def by_book(entries: DataFrame) -> DataFrame:
    """Rows as the sink wants them: a book's entries one after the other in one task."""
    return entries.select("book", "n", "entry", "data").repartition("book").sortWithinPartitions("book", "n", "entry")


@dataclass
class Written(WriterCommitMessage):
    """Archives of one task's attempt by the names that they are to have."""

    made: dict[str, str] = field(default_factory=dict)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, root.rstrip("/")


class _Archive:
    """One book as a stream: mimetype first and stored, the rest deflated."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.stream = system.open_output_stream(path, compression=None)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)
        self.names: set[str] = set()
        self.zip.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)

    def add(self, entry: str, data: bytes | None) -> None:
        if entry == "mimetype":
            return
        if entry in self.names:
            raise ValueError(f"two entries are named {entry}")
        self.names.add(entry)
        self.zip.writestr(zipfile.ZipInfo(entry), data or b"", zipfile.ZIP_DEFLATED)

    def close(self) -> None:
        self.zip.close()
        self.stream.close()


class BookWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _folder(self, root: str) -> str:
        return f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _open(self.path)
        task = TaskContext.get()
        mine = f"{self._folder(root)}/{task.taskAttemptId() if task else uuid.uuid4().hex}"
        made: dict[str, str] = {}
        book, archive = None, None
        try:
            for batch in iterator:
                for name, entry, data in zip(*(batch.column(c).to_pylist() for c in ("book", "entry", "data")), strict=True):
                    if archive is None or name != book:
                        if archive is not None:
                            archive.close()
                        if name is None or "/" in name or name.startswith((".", "_")) or name in made:
                            raise ValueError(f"{name!r} is no book's name, or its rows don't stand together")
                        system.create_dir(mine, recursive=True)
                        book, made[name] = name, f"{mine}/{len(made)}.epub"
                        archive = _Archive(system, made[name])
                    archive.add(entry, data)
        finally:
            if archive is not None:
                archive.close()
        return Written(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _open(self.path)
        moves = [m for message in messages if message is not None for m in message.made.items()]
        names = [name for name, _ in moves]
        if len(names) != len(set(names)):
            raise ValueError("a book's rows went to several tasks: use by_book")
        for name, made in moves:
            final = f"{root}/{name}.epub"
            if system.get_file_info(final).type != fs.FileType.NotFound:
                system.delete_file(final)
            system.move(made, final)
        self._clear(system, root)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._folder(root)).type != fs.FileType.NotFound:
            system.delete_dir(self._folder(root))


class Books(DataSource):
    """``format("books")``: rows (book, n, entry, data) as one archive a book under ``path``, replacing those of the same names."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return ENTRIES

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"])
