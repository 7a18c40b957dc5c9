"""Every query against its SQL in DuckDB, at the smallest scale."""

import math
import warnings

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple("~" if v is None else round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and math.isfinite(v) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query(name, spark, sf, duck):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = entry.queries()[name](spark, sf)
    want = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
