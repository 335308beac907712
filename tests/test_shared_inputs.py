"""Inputs that several parts of a query share are made once, and no task holds more as the table grows."""
import re

import pytest

from gridlake.catalog import build, lights
from gridlake.operators import focal
from gridlake.session import tasks_for
from gridlake.sources.fixtures import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    return len(re.findall(r"Relation ?\[l_", plan(df)))


@pytest.mark.parametrize("name, most", [("X14_settlement_index", 1), ("X02_deprivation_index", 1), ("AQ07_air_product", 1), ("T07_transport_product", 0),
                                        ("O09_crop_product", 5)])
def test_observations_are_read_once_for_what_is_shared(spark, name, most):
    assert scans(build().queries[name](spark, FOLDER)) <= most


def test_years_are_broadcast_to_the_layers(spark):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        raster = lights.raster(Tables(spark, FOLDER))
        raster.collect()
    finally:
        spark.conf.unset(limit)
    assert "hashpartitioning(epoch" not in raster._jdf.queryExecution().executedPlan().toString()


def test_more_rows_are_sorted_by_more_tasks(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 0) == own and tasks_for(spark, 500_000 * own + 1) == own + 1


def test_monthly_means_of_the_crop_product_are_made_once(spark):
    assert scans(build().queries["O09_crop_product"](spark, FOLDER)) <= 3


def test_gradient_of_the_smoothed_raster_takes_one_pass(spark):
    """The same to the bit as smoothing and then the gradient, on a raster with gaps and masked cells, without windows."""
    rows = spark.range(9000).selectExpr("id % 2 as yr", "id as cell_id", "int((id div 2) % 67) as x", "int(id div 134) as y",
                                        "case when id % 11 < 2 or id % 1300 < 500 then null else cast(id * 7919 % 1001 as double) end as v").filter("cell_id % 29 > 0")
    one = focal.gaussian_gradient(rows, "v", 3, ["yr"], "g")
    two = focal.sobel_magnitude(focal.gaussian_mean(rows, "v", 3, ["yr"], "_s"), "_s", ["yr"], "g").drop("_s")
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, one.collect()), key=lambda r: r[1])
    assert found == sorted(map(tuple, two.collect()), key=lambda r: r[1])
    assert 1000 < sum(r[-1] is not None for r in found) < 8000
