"""The corpus queries that have SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from quillrank.llm.queries import ORACLES, QUERIES


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    rel = con.execute(ORACLES[name])
    given = [x[0] for x in rel.description]
    assert sorted(given) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in given) for r in df.collect()), key=repr) == want
