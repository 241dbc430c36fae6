"""Every query that SQL can express gives SQL's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from hashloom import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None else v if isinstance(v, (bool, str)) else round(v, 9) if isinstance(v, float) else str(v)


def rows_of(names, rows):
    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    got = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, got.fetchall())


def test_every_query_is_registered():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 93
