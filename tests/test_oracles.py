"""The registered queries against their SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from panelspark.plans import collected

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(collected()[1])


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "year") else str(v)
    return float(v)


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x if isinstance(x, str) else "", round(x, 3) if isinstance(x, float) else 0.0) for x in r])


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    got, want = ordered([tuple(r) for r in df.collect()], df.columns), ordered(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
