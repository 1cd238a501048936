"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from lodestrata.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    rows = sorted((_plain(tuple(r)) for r in got.select(*cols).collect()), key=str)
    expected = sorted((_plain(r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
