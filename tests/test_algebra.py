"""Mask and scaling rules, checked on every combination of 0, 1 and NULL."""
import itertools

import pytest
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(itertools.product([0, 1, None], repeat=2)), "a int, b int")


def test_masks_propagate_null(pairs):
    rows = pairs.select("a", "b", A.mask_and(F.col("a"), F.col("b")).alias("both"), A.mask_or(F.col("a"), F.col("b")).alias("any"),
                        A.mask_not(F.col("a")).alias("neg")).collect()
    for r in rows:
        masked = r.a is None or r.b is None
        assert r["both"] == (None if masked else r.a & r.b)
        assert r["any"] == (None if masked else r.a | r.b)
        assert r["neg"] == (None if r.a is None else 1 - r.a)


def test_min_max_do_not_skip_null(pairs):
    for r in pairs.select("a", "b", A.min2(F.col("a"), F.col("b")).alias("lo"), A.max2(F.col("a"), F.col("b")).alias("hi")).collect():
        masked = r.a is None or r.b is None
        assert r.lo == (None if masked else min(r.a, r.b)) and r.hi == (None if masked else max(r.a, r.b))


def test_last_rule_wins_and_null_condition_keeps_value(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    out = [r[0] for r in df.select(A.where_chain(0, (F.col("v") > 0, 1), (F.col("v") > 3, 2))).collect()]
    assert out == [1, 2, 0]


def test_scaling_reversed_range_and_zero_denominator(spark):
    df = spark.createDataFrame([(0.0,), (2500.0,), (4000.0,), (None,)], "v double")
    assert [r[0] for r in df.select(A.norm(F.col("v"), 3000, 2000)).collect()] == [1.0, 0.5, 0.0, None]
    zero = spark.createDataFrame([(1.0, -1.0), (3.0, 1.0)], "a double, b double")
    assert [r[0] for r in zero.select(A.norm_diff(F.col("a"), F.col("b"))).collect()] == [None, 0.5]


def test_expression_replaces_whole_words(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "nir double, n double")
    assert df.select(A.expression("n - R", n="nir", R="n")).first()[0] == -1.0


def test_water_vote_needs_two_and_passes_null(spark):
    df = spark.createDataFrame([(10.0, 1.0, 1.0, 0.0), (1.0, 10.0, 10.0, 10.0), (None, 1.0, 1.0, 1.0)],
                               "green double, nir double, swir1 double, swir2 double")
    assert [r[0] for r in df.select(I.water_vote()).collect()] == [1, 0, None]


def test_rounding_hides_summation_order(spark):
    df = spark.createDataFrame([(0.1 + 0.2, 0.3), (-0.0, 0.0)], "a double, b double")
    assert all(str(r.x) == str(r.y) for r in df.select(A.rounded(F.col("a")).alias("x"), A.rounded(F.col("b")).alias("y")).collect())
