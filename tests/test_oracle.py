"""Every query with a SQL twin, compared value by value on the small tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def key(row):
    return tuple((x is not None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(name, spark, sf_dir, duck):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(([tuple(map(plain, r)) for r in df.select(*columns).collect()]), key=key)
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    other = sorted(([tuple(plain(r[i]) for i in order) for r in cur.fetchall()]), key=key)
    assert mine == other


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(name, spark, sf_dir):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
