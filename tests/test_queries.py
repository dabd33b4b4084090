"""Every registered query of the library against its DuckDB counterpart on the smallest tables."""

import math

import duckdb
import pytest

from tarnlake.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool):
        return str(v)
    return f"{round(float(v), 5) + 0.0:.5f}" if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name not in ORACLES:
        assert rows
        return
    q = con.sql(ORACLES[name])
    names = list(q.columns)
    assert sorted(names) == sorted(got.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in q.fetchall())
