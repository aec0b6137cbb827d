"""Every query of the library that has SQL gives the rows of that SQL."""

import math

import duckdb
import pytest

from quarry.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, folder, name):
    got = QUERIES[name](spark, folder)
    expected = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    at = [list(expected.columns).index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=str)
    assert ours == theirs


def test_every_query_is_callable():
    assert set(ORACLE_SQL) <= set(QUERIES)
