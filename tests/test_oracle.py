"""Every registered query against its SQL text on the smallest tables, and its plan: on the JVM, no cartesian product."""

import duckdb
import pytest

from check import TABLES, rows_of
from tidemark.catalog import QUERIES

SF = "/root/testdata/sf0.001"
FOLDS = {"cooldown", "sustained_below"}  # greedy folds over thinned candidates, the only Python in batch plans


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert any(x in plan for x in ("Python", "InPandas", "InArrow")) == (name in FOLDS)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == rows_of(cols, cur.fetchall())
