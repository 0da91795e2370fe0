import duckdb
import pytest

from loomrank.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    df = QUERIES[name](spark, data_dir)
    columns = sorted(df.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert sorted(tuple(repr(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(repr(r[i]) for i in at) for r in result.fetchall())
