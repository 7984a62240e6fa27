"""Every query against its SQL, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from tallyforge import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (Decimal, float)):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([tuple(map(plain, r)) for r in df.select(*cols).collect()], key=str)
    if name not in catalogue.SQL:
        assert got
        return
    cur = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=str)
    assert sorted(names) == cols and got == want


def test_pushdown(spark, sf):
    plan = catalogue.QUERIES["scan_filter_expr"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_partkey" not in plan
