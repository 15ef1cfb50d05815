"""Every query that has SQL gives the rows of that SQL."""

import math

import duckdb
import pytest
from paths import SF

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    own.sql("set timezone = 'UTC'")
    for t in TABLES:
        own.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return own


def plain(rows):
    shown = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query(spark, duck, name):
    ours = entry_point.queries()[name](spark, SF)
    theirs = duck.sql(entry_point.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = plain(ours.select(*columns).collect())
    assert got == plain(theirs.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
