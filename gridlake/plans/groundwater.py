"""Water storage, trends and groundwater decomposition."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.operators import temporal


def annual_storage(df: DataFrame, first=None, last=None) -> DataFrame:
    return temporal.calendar_years(df, first, last).groupBy("cell_id", "yr").agg(F.avg("tws_cm").alias("tws_cm"))


def storage_series(df: DataFrame) -> DataFrame:
    """Zone mean, minimum and maximum of the yearly means and the number of scene dates."""
    years = temporal.calendar_years(df)
    cells = years.groupBy("cell_id", "yr").agg(F.avg("tws_cm").alias("v"))
    zone = cells.groupBy("yr").agg(F.avg("v").alias("mean_cm"), F.min("v").alias("min_cm"), F.max("v").alias("max_cm"))
    return zone.join(years.groupBy("yr").agg(F.count_distinct("t").alias("scenes")), "yr")


def month_number(t: str = "t", origin: str = "2002-01-01") -> Column:
    """Whole months since the origin."""
    return F.months_between(F.trunc(t, "month"), F.lit(origin).cast("date"))


def trend(df: DataFrame) -> DataFrame:
    """Least-squares slope (cm per month) and intercept per cell; mergeable aggregates."""
    m = df.withColumn("_m", month_number())
    return m.groupBy("cell_id").agg(F.regr_slope("tws_cm", "_m").alias("slope"), F.regr_intercept("tws_cm", "_m").alias("intercept"))


def soil_moisture(df: DataFrame, layers=("sm1", "sm2", "sm3", "sm4"), first=None, last=None) -> DataFrame:
    total = sum((F.col(c) for c in layers[1:]), F.col(layers[0]))
    return temporal.calendar_years(df, first, last).groupBy("cell_id", "yr").agg((F.avg(total) / F.lit(10.0)).alias("sm_cm"))


def surface_water(df: DataFrame, depth_cm: float = 50.0, first=None, last=None) -> DataFrame:
    return temporal.calendar_years(df, first, last).groupBy("cell_id", "yr").agg(
        (F.avg(A.flag(F.col("water_month") >= 1)) * F.lit(depth_cm)).alias("sw_cm"))


def decomposition(df: DataFrame, ref_first: int = 2004, ref_last: int = 2009) -> DataFrame:
    """Zone means per year of storage, soil-moisture anomaly, surface water and their remainder.

    The three products share keys, so they come from one grouped pass; only the per-cell
    soil baseline is joined back."""
    total = F.col("sm1") + F.col("sm2") + F.col("sm3") + F.col("sm4")
    cells = temporal.calendar_years(df).groupBy("cell_id", "yr").agg(
        F.avg("tws_cm").alias("tws"), (F.avg(total) / F.lit(10.0)).alias("sm"),
        (F.avg(A.flag(F.col("water_month") >= 1)) * F.lit(50.0)).alias("sw"))
    base = cells.filter(F.col("yr").between(ref_first, ref_last)).groupBy("cell_id").agg(F.avg("sm").alias("_b"))
    parts = cells.join(base, "cell_id").withColumn("sma", F.col("sm") - F.col("_b"))
    parts = parts.withColumn("gws", F.col("tws") - F.col("sma") - F.col("sw"))
    return parts.groupBy("yr").agg(*[F.avg(a).alias(b) for a, b in (("tws", "tws_cm"), ("sma", "sm_cm"), ("sw", "sw_cm"), ("gws", "gws_cm"))])


def depletion(trends: DataFrame, zone_cells: DataFrame, key: str, area: Column, threshold: float = -2.0) -> DataFrame:
    """Per known zone: mean and minimum slope and the square metres below the threshold."""
    flagged = trends.withColumn("_a", A.flag(F.col("slope") < threshold) * area)
    return (flagged.join(zone_cells.select(key, "cell_id"), "cell_id").groupBy(key)
            .agg(F.avg("slope").alias("mean_slope"), F.min("slope").alias("min_slope"), F.sum("_a").alias("depleting_m2")))
