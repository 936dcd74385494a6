import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import verify
from fraudloom.llm import queries


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in verify.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    res = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == Counter(tuple(r[k] for k in at) for r in res.fetchall())
