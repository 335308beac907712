"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""
import re

import pytest

import __spark_entry__ as entry
from gridlake import catalog
from verify import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.build().queries, catalog.build().sql
#: Queries without a row on 200 cells: thresholds, zones and patch sizes that only a larger raster reaches.
EMPTY = {"OUT2_clip_box"}


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


def test_inventory_is_covered():
    have = {re.match(r"(AQ|AL|OUT|[A-Z])0?(\d+)", n).groups() for n in QUERIES}
    last = dict(P=41, A=13, I=10, W=15, F=7, R=7, H=7, C=13, D=5, Y=7, V=9, O=9, L=13, N=8, U=6, J=7, T=7, AQ=7, K=12, G=6, S=8, E=6, X=23, B=7, AL=6, M=12, Z=5, OUT=4)
    assert [(k, i) for k, n in last.items() for i in range(1, n + 1) if (k, str(i)) not in have] == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    problem = compare(df, con.sql(SQL[name]))
    assert problem == ("EMPTY" if name in EMPTY else None), problem
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns_and_pushes_the_date_filter(spark):
    plan = QUERIES["P01_date_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_suppkey", "l_extendedprice", "l_shipdate"}
    assert "GreaterThanOrEqual(l_shipdate" in plan or "l_shipdate" in re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
