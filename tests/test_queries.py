"""Every registered query against its SQL, or a minimum of rows where it has none."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from shoalmark.catalog import QUERIES
from tools.check import KINDS, TABLES, rows_of
from tools.plans import NEVER, plan_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    plan = plan_of(df)
    assert not [n for n in NEVER if n in plan]  # no cross join, no Python in the plan
    got = [tuple(x) for x in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    assert sorted(cols) == sorted(df.columns)
    for f in df.schema:
        kind = f.dataType.simpleString()
        assert KINDS.get(kind, kind) == KINDS.get(types[f.name], types[f.name]), f.name
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
