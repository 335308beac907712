"""Composites kept up to date: a stored state per cell and year into which new scenes are merged.

The state of a median, and of any percentile, mean, minimum or maximum, is how often each
stored integer was seen. Such counts add up, so new scenes are merged without reading the old
ones again, in any order and in any batches; scenes of a late month change only their year."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.indices import BANDS
from gridlake.operators import temporal

KEYS = ("cell_id", "yr")


def state_of(obs: DataFrame, keys=KEYS, bands=BANDS, bits: int = 24) -> DataFrame:
    """Rows (keys, band, value, n) of the clear observations: n times the value was seen; masked values are not counted."""
    values = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("long").alias("value")) for b in bands])
    return (temporal.cloud_free(obs, bits).select(*keys, F.inline(values)).filter("value is not null")
            .groupBy(*keys, "band", "value").agg(F.count(F.lit(1)).alias("n")))


def merged(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state after further scenes: counts of both added up. ``new`` is a state as well."""
    keys = [c for c in state.columns if c != "n"]
    return state.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))


def composites(state: DataFrame, keys=KEYS, bands=BANDS, method: str = "median") -> DataFrame:
    """Composites of the state, as ``temporal.composite`` makes them from all scenes.

    A group's distinct values are bounded by the range of the stored integers, not by its scenes.
    A group that was only ever masked has no state and no row."""
    def one(band):
        value = F.when(F.col("band") == band, F.col("value"))
        if method == "median":
            return F.percentile(value, F.lit(0.5), F.when(F.col("band") == band, F.col("n")).otherwise(F.lit(0)))
        if method == "mean":
            return F.sum(value * F.col("n")) / F.sum(F.when(F.col("band") == band, F.col("n")))
        if method in ("min", "max"):
            return getattr(F, method)(value)
        raise ValueError(f"unknown composite method: {method}")
    return state.groupBy(*keys).agg(*[one(b).alias(b) for b in bands])


def update_store(spark, path: str, new_obs: DataFrame, target: str, bands=BANDS, bits: int = 24) -> list[int]:
    """Merge new scenes into a state stored by year and write the years they touch to ``target``.

    Years without new scenes are neither read nor written. ``target`` is another folder, so a
    failed job leaves the state as it was and can be run again; a reader takes a year from the
    newest folder that has it. Returns the years (a number of rows bounded by the calendar)."""
    new = state_of(new_obs, bands=bands, bits=bits)
    years = sorted(r.yr for r in new.select("yr").distinct().collect())
    if years:
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("yr").isin(years))
        merged(old, new).repartition("yr", "cell_id").sortWithinPartitions("yr", "cell_id", "band").write.partitionBy("yr").parquet(target)
    return years


def flagged_changes(before: DataFrame, after: DataFrame, value, drop: float, keys=("cell_id",), yr: str = "yr") -> DataFrame:
    """Cells whose yearly value fell by more than ``drop`` through the new scenes: (keys, yr, was, now)."""
    k = [*keys, yr]
    both = before.select(*k, value.alias("was")).join(after.select(*k, value.alias("now")), k)
    return both.filter(F.col("was") - F.col("now") > F.lit(drop))
