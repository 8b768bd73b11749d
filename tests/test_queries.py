"""Every core query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from paperloom import queries

DATA = "/root/testdata/sf0.001"
SQL = {n: (m.QUERIES[n], s) for m in queries.modules() for n, s in m.SQL.items()}


def _key(rows):
    return sorted(tuple((v is None, str(round(v, 5) if isinstance(v, float) else v)) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    f, sql = SQL[name]
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    df = f(spark, DATA)
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _key(tuple(r[n] for n in names) for r in df.collect()) == _key(cur.fetchall())
