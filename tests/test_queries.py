"""Every query with SQL against DuckDB on the same tables, and every other for its rows."""

import duckdb
import pytest

from quillrank.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name in ORACLES:
        rel = duck.execute(ORACLES[name])
        given = [x[0] for x in rel.description]
        assert sorted(given) == names
        at = [given.index(c) for c in names]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    else:
        assert got
