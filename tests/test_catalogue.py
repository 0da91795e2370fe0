import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from loomrank import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, data_dir, oracle, name):
    df = catalogue.QUERIES[name](spark, data_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    result = oracle.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= catalogue.K and set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_folder(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_exhaustive' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql(); print('fine')"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert out.stdout.strip().endswith("fine"), out.stderr
