"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from quirespark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple((v is None, str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert got or name in {"ngram_echo", "repeated_outputs", "repeated_edges"}
    if name in registry.ORACLES:
        found = sql.execute(registry.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert plain(got) == plain(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())


def test_entry_without_llm(tmp_path):
    """The rest works where the training-data subpackage has been deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert 'progress_rollup' in e.queries() and not any(n.startswith('op') for n in e.queries() if n[2:3].isdigit())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r").returncode == 0
