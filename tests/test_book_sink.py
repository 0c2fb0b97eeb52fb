"""The translated-book sink: round trip, a failed and repeated task, an aborted job, and what is replaced."""

import io
import os
import tempfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirespark.functions import package as pk
from quirespark.sources import book_sink

OPF = (
    '<?xml version="1.0"?><package version="3.0" xml:lang="en" xmlns="x"><metadata><dc:title id="t">Old &amp; grey</dc:title><dc:language>en</dc:language>'
    '<dc:language>fr</dc:language><meta property="dcterms:modified">2001-01-01T00:00:00Z</meta></metadata></package>'
)
NAV = '<html lang="en"><head><title>Old</title></head><body><nav><h1>Contents</h1><a href="a"> One\n day </a><a href="b">Two <i>b</i></a><span>Tom &amp; Ana</span></nav></body></html>'
NCX = '<ncx xml:lang="en"><docTitle><text>Old</text></docTitle><navMap><navPoint><navLabel>\n<text>One day</text></navLabel></navPoint><text>One day</text></navMap></ncx>'


def book(spark, name="b1"):
    rows = [
        (name, 0, "META-INF/container.xml", "other", b"<container/>"), (name, 1, "o/book.opf", "opf", OPF.encode()), (name, 2, "o/nav.xhtml", "nav", NAV.encode()), (name, 3, "o/toc.ncx", "ncx", NCX.encode()),
        (name, 4, "o/c1.xhtml", "chapter", b"<p>one</p>"), (name, 5, "o/c2.xhtml", "chapter", b"<p>two</p>"), (name, 6, "o/i.png", "other", bytes(range(256)) * 50), (name, 7, "mimetype", "other", b"wrong"),
    ]
    return spark.createDataFrame(rows, "book string, n long, entry string, kind string, data binary")


def whole(spark):
    texts = spark.createDataFrame([("b1", "o/c1.xhtml", "<p>um</p>"), ("b2", "o/c1.xhtml", "<p>zwei</p>")], "book string, entry string, text string")
    labels = spark.createDataFrame([("b1", "One day", "Um <dia>"), ("b1", "Tom & Ana", "Tom e Ana"), ("b1", "Contents", "Sumário")], "book string, label string, new string")
    books = spark.createDataFrame([("b1", "pt-BR", "Novo & velho")], "book string, language string, title string")
    return book_sink.translated(book(spark).unionAll(book(spark, "b2")), texts, labels, books, F.lit("2026-01-01T00:00:00Z"))


def test_round_trip(spark):
    spark.dataSource.register(book_sink.Books)
    to = tempfile.mkdtemp(prefix="spark-") + "/out"
    for _ in range(2):  # the second replaces the first
        book_sink.by_book(whole(spark)).write.format("books").mode("append").save(to)
    assert sorted(os.listdir(to)) == ["_SUCCESS", "_temporary", "b1.epub", "b2.epub"] or sorted(os.listdir(to)) == ["_SUCCESS", "b1.epub", "b2.epub"]
    data = open(f"{to}/b1.epub", "rb").read()
    assert data[30:38] == b"mimetype" and data[38:58] == b"application/epub+zip"
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and z.namelist()[0] == "mimetype" and len(z.namelist()) == 8
    read = lambda n: z.read(n).decode()
    assert read("o/c1.xhtml") == "<p>um</p>" and read("o/c2.xhtml") == "<p>two</p>" and z.read("o/i.png") == bytes(range(256)) * 50
    assert read("o/book.opf") == (
        '<?xml version="1.0"?><package version="3.0" xml:lang="pt-BR" xmlns="x"><metadata><dc:title id="t">Novo &amp; velho</dc:title><dc:language>pt-BR</dc:language>'
        '<meta property="dcterms:modified">2026-01-01T00:00:00Z</meta></metadata></package>'
    )
    assert read("o/nav.xhtml") == '<html xml:lang="pt-BR" lang="pt-BR"><head><title>Novo &amp; velho</title></head><body><nav><h1>Sumário</h1><a href="a">Um &lt;dia&gt;</a><a href="b">Two <i>b</i></a><span>Tom e Ana</span></nav></body></html>'
    assert read("o/toc.ncx") == '<ncx xml:lang="pt-BR"><docTitle><text>Novo &amp; velho</text></docTitle><navMap><navPoint><navLabel>\n<text>Um &lt;dia&gt;</text></navLabel></navPoint><text>One day</text></navMap></ncx>'
    other = zipfile.ZipFile(f"{to}/b2.epub")
    assert other.read("o/c1.xhtml") == b"<p>one</p>" and other.read("o/book.opf").decode() == OPF  # no such book is known


def batch(rows):
    return pa.RecordBatch.from_pylist([{"book": b, "n": n, "entry": e, "data": d} for b, n, e, d in rows])


ROWS = [("x", 0, "a", b"1"), ("x", 1, "b", b"2"), ("y", 0, "a", None)]


def test_failed_and_repeated_task():
    to = tempfile.mkdtemp(prefix="spark-")
    writer = book_sink.BookWriter(to)

    def breaks():
        yield batch(ROWS[:1])
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    twice = writer.write(iter([batch(ROWS)]))  # a speculative attempt that isn't committed
    assert not [n for n in os.listdir(to) if n.endswith(".epub")]
    writer.commit([writer.write(iter([batch(ROWS[:1]), batch(ROWS[1:])])), None])
    assert sorted(n for n in os.listdir(to) if n.endswith(".epub")) == ["x.epub", "y.epub"] and twice.made
    assert zipfile.ZipFile(f"{to}/x.epub").namelist() == ["mimetype", "a", "b"] and zipfile.ZipFile(f"{to}/y.epub").read("a") == b""
    assert not os.path.exists(f"{to}/_temporary/{writer.job}")


def test_aborted_job_leaves_the_old_book():
    to = tempfile.mkdtemp(prefix="spark-")
    first = book_sink.BookWriter(to)
    first.commit([first.write(iter([batch(ROWS)]))])
    old = open(f"{to}/x.epub", "rb").read()
    second = book_sink.BookWriter(to)
    second.abort([second.write(iter([batch([("x", 0, "c", b"3")])]))])
    assert open(f"{to}/x.epub", "rb").read() == old and not os.path.exists(f"{to}/_temporary/{second.job}")
    third = book_sink.BookWriter(to)
    with pytest.raises(ValueError):
        third.commit([third.write(iter([batch(ROWS[:1])])), third.write(iter([batch(ROWS[1:2])]))])
    for bad in ([("../z", 0, "a", b"")], [("x", 0, "a", b""), ("x", 1, "a", b"")], [*ROWS, ROWS[0]]):
        with pytest.raises(ValueError):
            third.write(iter([batch(bad)]))


def test_package_parts(spark):
    df = spark.createDataFrame([("<package version='2.0'><metadata>$</metadata></package>",)], "x string")
    got = df.select(pk.package_document(F.col("x"), F.lit("a$1"), F.lit(None).cast("string"), F.lit("now")).alias("p")).first().p
    assert got == "<package version='2.0'><metadata>$<dc:language>a$1</dc:language></metadata></package>"

    def by_hand(text):
        units = text.encode("utf-16-be")
        a, b = 0x811C9DC5, 0x01000193 ^ (len(units) // 2)
        for i in range(0, len(units), 2):
            c = units[i] << 8 | units[i + 1]
            a, b = (a ^ c) * 0x01000193 % 2**32, (b ^ c) * 0x5BD1E995 % 2**32
        return f"{a:08x}{b:08x}"[:12]

    texts = ["", "a", "é😀", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pk.short_hash(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: by_hand(t) for t in texts}
