"""Percentiles whose sketch gives another bracket each time it is evaluated, as merging in another order does."""
import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import histogram


@pytest.fixture
def unsteady_sketch(monkeypatch):
    def wider(low, high):
        room = high - low + 1
        return [low - room * random.random(), high + room * random.random()]

    def sketch(column, edges, accuracy):
        return F.udf(wider, "array<double>")(F.min(column), F.max(column))
    monkeypatch.setattr(F, "percentile_approx", sketch)


def test_rows_are_placed_in_one_bracket(spark, unsteady_sketch):
    df = spark.range(30_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.6)).alias("m")).collect()}
    got = {r.k: r.m for r in histogram.percentiles(df, "v", {"m": 0.6}, ["k"]).collect()}
    assert got == pytest.approx(want)


def test_small_keys_are_sorted_without_brackets(spark, monkeypatch):
    df = spark.range(3_000).select((F.col("id") % 500).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(600, None), (601, 4.0)], "k long, v double"))
    points, means = {"m": 0.6, "top": 1.0}, [F.avg("v").alias("mean")]
    want = {r.k: (r.mean, r.m, r.top) for r in df.groupBy("k").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.6)).alias("m"), F.max("v").alias("top")).collect()}
    def found():
        return {r.k: (r.mean, r.m, r.top) for r in histogram.with_percentiles(df, "v", points, means, ["k"]).collect()}
    monkeypatch.setattr(histogram, "SORTED_ROWS", 0)
    brackets = found()
    monkeypatch.setattr(histogram, "SORTED_ROWS", 100_000)
    monkeypatch.setattr(F, "percentile_approx", None)
    small = found()
    assert small == brackets and small.keys() == want.keys()
    assert small[600] == (None, None, None) and small[601] == (4.0, 4.0, 4.0)
    assert all(small[k] == pytest.approx(want[k]) for k in want if None not in want[k])
