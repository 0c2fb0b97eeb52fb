"""The registered queries on the smallest tables: against their SQL where there is one, else against plain Python."""

import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from quirespark.llm import registry, simhash

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels embeddings".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    found = sql.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())


def test_packing_query(spark, sql):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np
    import public_tokenizers

    whole = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces = defaultdict(list)
    for r in registry.op5_binary_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
    docs = sql.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(docs) == len(pieces)
    for i, text in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(ids[at : at + r.length].tobytes()), len(ids))
            at += r.length
        assert at == len(ids)


def test_simhash_query(spark, sql):
    docs = sql.execute("SELECT doc_id, text FROM documents").fetchall()
    fps = {i: simhash.fingerprint(t) for i, t in docs}
    group = {i: i for i in fps}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op8_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", root(i)) for i in fps}


@pytest.mark.parametrize(("name", "label"), [("op1_toxic_chain", "toxic"), ("op4_pairwise_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, max({label}) FROM '{sf}/labels.parquet' GROUP BY 1").fetchall())
    rows = registry.QUERIES[name](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in tested)
    assert len(tested) > 50 and right / len(tested) > 0.93


def test_surrogates_query(spark, sql):
    """Nothing of the plainest kinds stays, and texts without them are the same."""
    kinds = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]{2,}|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b[0-9a-f]{32,}\b")
    texts = dict(sql.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in registry.op10_surrogates(spark, SF).collect():
        before, after = set(kinds.findall(texts[r.doc_id] or "")), set(kinds.findall(r.text or ""))
        assert not before & after
        if not r.n_entities:
            assert r.text == texts[r.doc_id]


def test_pipeline_edge_rows(spark):
    """Null, empty, long and repeated rows and clashing columns pass every stage; an empty table stays one."""
    pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    some = [(r.doc_id, r.text) for r in base.limit(40).collect()]
    rows = [*some, (None, some[0][1]), (900, None), (900, ""), (901, "word " * 30_000), (some[1][0], "one more text\nunder an id that is taken"), some[2]]
    docs = spark.createDataFrame([(i, t, "en", "s", 7, "g", "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `group` string, kept string")
    names = docs.columns
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in pipeline.STAGES[:-1]:
            now = pipeline.written(stage(spark, now, SF), name)
            assert now.columns == names
        packed = pipeline.STAGES[-1][1](spark, now, SF)
        assert (packed.count() > 0) == (now.count() > 0) == (start is docs)


def test_pipeline_judges_rows_not_ids(spark):
    """Rows that share an id, or have none, are decided each by their own text; helper names may be columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, item), (1, "a clean text of its own"), (None, item), (None, "another clean text"), (2, "other")]
    docs = spark.createDataFrame([(i, t, "en", "s", 7, *"abcd") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, _hash string, _hit string, row string")
    kept = pipeline.clean(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["a clean text of its own", "another clean text", "other"]
    near = pipeline.near(spark, docs, SF)
    assert near.columns == docs.columns and near.count() == 4  # of the two equal texts one stays


def test_no_id_is_in_no_test_fold(spark):
    docs = spark.createDataFrame([(None, "some text"), (1, None)], "doc_id long, text string")
    from quirespark.llm.common import held_out

    assert [r.h for r in docs.select(held_out(docs.doc_id).alias("h")).collect()] == [False, zlib.crc32(b"1") % 5 == 0]
