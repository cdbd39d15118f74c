"""Every query with SQL gives the same rows as DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from docloom.plans import semantics  # noqa: F401, adds to the catalog
from docloom.plans.catalog import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else repr(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0


def test_scans_are_pruned(spark):
    plan = QUERIES["calc_part_price"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>" in plan and "Exchange" not in plan and "Python" not in plan


def test_whole_shop_with_orders(spark, duck):
    from docloom.plans import catalog as C

    docs = C.shop(spark, DATA)
    rated = "SELECT o_orderkey AS k, o_totalprice AS t, c_acctbal * 3 AS b, c_acctbal * 10.5::DOUBLE AS a FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 2"
    want = duck.sql(f"SELECT 'order-' || k, greatest(t, b) - t / 4, greatest(t, a) - t / 4 FROM ({rated}) WHERE greatest(t, b) <> greatest(t, a)").fetchall()
    got = [tuple(r) for r in C.rate_changes(docs).where("entity like 'order-%' and field = 'score' and kind = 'FormulaImpact'").select("entity", "before", "after").collect()]
    assert sorted(got) == sorted(want)
    [(n,)] = duck.sql("SELECT count(*) FROM orders").fetchall()
    assert C.described(docs).where("schema = 'orders' and fields = 'customer,score,status,total'").count() == n
    paths = [r["path"] for r in C.output_order(docs).orderBy("place").collect()]
    assert paths == sorted(paths) and sum(p.startswith("order-") for p in paths) == 2 * n
