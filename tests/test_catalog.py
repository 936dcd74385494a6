"""Every catalogue query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import verify
from fraudloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in verify.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(verify.canon(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(catalog.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, res.fetchall())


def test_sql_belongs_to_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["txn_id", "action", "band", "score", "n_hits", "codes"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
