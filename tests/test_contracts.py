"""Loose JSON, request schemas, sealed tokens, languages and merged lines on cases that the tables don't hold."""

import base64
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from quirespark.functions import contracts as ct
from quirespark.operators import folds
from quirespark.operators import language as lg

SF = "/root/testdata/sf0.01"


def test_error_layouts(spark):
    cases = {
        '{"error":{"message":"a","code":7}}': ("a", "7"),
        '{"error":"b"}': ("b", None),
        '{"errors":[{"code":"x","message":"c"},{"message":"d"}]}': ("c", "x"),
        '{"message":"e","code":1.5}': ("e", "1.5"),
        '{"error":{"code":9},"message":"f"}': ("f", "9"),
        '{"other":1}': ('{"other":1}', None),
        "[1": ("[1", None),
        "x" * 600: ("x" * 500, None),
        "": ("", None),
    }
    df = spark.createDataFrame([(b,) for b in [*cases, None]], "b string")
    got = {r.b: (r.e.message, r.e.code) for r in df.select("b", ct.error_of(F.col("b")).alias("e")).collect()}
    assert got == cases | {None: (None, None)}


FIELDS = [
    ct.Field("$.action", "STRING", required=True, enum=("start", "pause")),
    ct.Field("$.lang", "STRING", nullable=True, most_chars=5),
    ct.Field("$.sure", "BOOLEAN"),
    ct.Field("$.options", "OBJECT"),
    ct.Field("$.options.depth", "BIGINT", required=True, least=0, most=20),
]


@pytest.mark.parametrize(
    ("request_", "want"),
    [
        ({"action": "start"}, []),
        ({"action": "start", "lang": None, "sure": True, "options": {"depth": 3}, "more": [1]}, []),
        ({}, [("$.action", "required")]),
        ({"action": "stop", "lang": "pt-BR-x", "sure": 1}, [("$.action", "enum"), ("$.lang", "length"), ("$.sure", "type")]),
        ({"action": None, "options": None}, [("$.action", "type"), ("$.options", "type")]),
        ({"action": 3, "options": {}}, [("$.action", "type"), ("$.options.depth", "required")]),
        ({"action": "pause", "options": {"depth": 21}}, [("$.options.depth", "range")]),
        ({"action": "pause", "options": {"depth": "2"}}, [("$.options.depth", "type")]),
        ({"action": "pause", "options": [1]}, [("$.options", "type")]),
        ("{oops", [("$", "json")]),
        ([], [("$", "json")]),
        ("", [("$", "json")]),
        (None, [("$", "json")]),
    ],
)
def test_violations(spark, request_, want):
    body = request_ if request_ is None or isinstance(request_, str) else json.dumps(request_)
    df = spark.createDataFrame([(1, body, "kept")], "id int, body string, path_ string")
    got = ct.violations(df, "body", FIELDS).collect()
    assert sorted((r.path, r.rule) for r in got) == sorted(want) and all(r.path_ == "kept" and r.id == 1 for r in got)


def test_hmac_vectors(spark):
    """The test cases of RFC 4231, keys as columns."""
    cases = [
        (b"\x0b" * 20, b"Hi There"), (b"Jefe", b"what do ya want for nothing?"), (b"\xaa" * 20, b"\xdd" * 50), (bytes(range(1, 26)), b"\xcd" * 50), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First"),
        (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm."), (b"", b""), (b"\x00" * 64, b"x"),
    ]
    df = spark.createDataFrame([(i, bytearray(k), bytearray(m)) for i, (k, m) in enumerate(cases)], "i int, k binary, m binary")
    got = [r.h for r in df.orderBy("i").select("i", ct.hmac_sha256(F.col("k"), F.col("m")).alias("h")).collect()]
    assert got[0] == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"
    assert got == [hmac.new(k, m, hashlib.sha256).hexdigest() for k, m in cases]


def test_tokens(spark):
    now = 1000
    payloads = [json.dumps({"id": "é/+" * n, "exp": exp}, ensure_ascii=False) for n in range(4) for exp in (now, now + 1)] + ["{}", "no json"]
    df = spark.createDataFrame([(p,) for p in payloads], "p string").withColumn("t", ct.sealed(F.col("p"), F.lit("key")))
    for r in df.select("p", "t", ct.opened(F.col("t"), F.lit("key"), F.lit(now)).alias("o"), ct.opened(F.col("t"), F.lit("kez"), F.lit(now)).alias("w")).collect():
        coded = base64.urlsafe_b64encode(r.p.encode()).decode().rstrip("=")
        assert r.t == f"{coded}.{hmac.new(b'key', b'sim:' + coded.encode(), hashlib.sha256).hexdigest()}"
        assert r.w is None and r.o == (r.p if '"exp": 1001' in r.p else None)
    bad = spark.createDataFrame([(x,) for x in (None, "", ".", "a", "a.b", "!!.x")], "t string")
    assert all(r.o is None for r in bad.select(ct.opened(F.col("t"), F.lit("key"), F.lit(now)).alias("o")).collect())


def test_language_of_unseen_documents(spark):
    """Profiles from four fifths of the documents, accuracy on the rest by length of text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and length(text) > 0")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = lg.profiles(docs.where(~held))
    assert known.groupBy("lang").count().where("count <> 300").count() == 0
    right = {}
    for n in (40, 100, 1000):
        cut = docs.where(held).where(F.length("text") >= n).withColumn("text", F.substring("text", 1, n))
        first = lg.ranked(cut, known).where("rank = 1").withColumnRenamed("lang", "found")
        right[n] = cut.join(first, "doc_id").agg(F.avg((F.col("lang") == F.col("found")).cast("double"))).first()[0]
    assert right[40] > 0.8 and right[100] > 0.9 and right[1000] > 0.97, right


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", None), (5, "123", "en")], "doc_id long, text string, lang string")
    known = lg.profiles(docs)
    scored = lg.ranked(docs, known)
    assert {(r.doc_id, r.lang, r.score) for r in scored.where("rank = 1").collect()} == {(1, "en", 1.0), (2, "fr", 1.0)}
    judged = {r.doc_id: (r.is_source, r.other) for r in lg.in_language(scored, F.lit("en")).collect()}
    assert judged == {1: (True, None), 2: (False, "fr")}
    found = {r.doc_id: r.language for r in lg.detected(docs, known, F.lit("pt-PT"), least=3).collect()}
    assert found == {1: "en", 2: "fr", 3: "pt-PT", 4: "pt-PT", 5: "pt-PT"}
    assert lg.ranked(docs.limit(0), known).count() == 0 and lg.profiles(docs.limit(0)).count() == 0


def test_merged_lines(spark):
    """Hyphens, styles and paragraphs; long keys over several batches against plain Python."""
    line = lambda *runs: [{"text": t, "italic": i, "bold": b} for t, i, b in runs]
    plain = lambda t: line((t, False, False))
    rows = [
        (1, 0, plain("  the tradu-"), True), (1, 1, plain("ção was "), False), (1, 2, line(("late", True, False), ("-", True, False)), False), (1, 3, line((" night ", True, False), ("B", False, True)), False), (1, 4, [], False),
        (1, 5, plain("Next-"), True), (1, 6, plain("Day -"), False), (1, 7, plain("end"), False), (2, 0, plain("one"), False), (3, 0, None, True),
    ]
    schema = "k int, i int, runs array<struct<text:string,italic:boolean,bold:boolean>>, begins boolean"
    got = {(r.k, r.para): [(x.text, x.italic, x.bold) for x in r.runs] for r in folds.merged_lines(spark.createDataFrame(rows, schema), "k", "i", "runs", "begins").collect()}
    assert got == {
        (1, 0): [("the tradução was ", False, False), ("latenight ", True, False), ("B", False, True)],
        (1, 1): [("Next- Day - end", False, False)],
        (2, 0): [("one", False, False)],
    }
    rng = random.Random(6)
    long = [(7, i, rng.random() < 0.01, rng.choice(["a", "b-", "c"])) for i in range(30_000)]
    df = spark.createDataFrame([(k, i, plain(t), b) for k, i, b, t in long], schema)
    want, held = [], []
    for _, _, begins, t in long:
        if begins and held:
            want.append(" ".join(held).replace("b- ", "b"))
            held = []
        held.append(t)
    want.append(" ".join(held).replace("b- ", "b"))
    assert [r.runs[0].text for r in folds.merged_lines(df, "k", "i", "runs", "begins").orderBy("para").collect()] == want
