"""Rainfall, surface temperature, heat islands and drought."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import AIR_SEASONS, RAIN_MONSOON
from gridlake.operators import temporal, zones
from gridlake.plans.vegetation import seasonal_means

LST_SCALE, LST_OFFSET = 0.02, -273.15


def quality_lst(band: str = "day") -> Column:
    """Stored temperature where the two lowest quality bits are 0."""
    return F.when(A.bits_clear(F.col(f"qc_{band}"), 3), F.col(f"lst_{band}_dn"))


def celsius(dn: Column) -> Column:
    return dn * F.lit(LST_SCALE) + F.lit(LST_OFFSET)


def annual_rain(df: DataFrame, first=None, last=None, value: str = "precip_dmm", per_mm: float = 10.0) -> DataFrame:
    """Per (cell, year) total in mm; stored tenths are summed as integers."""
    return temporal.calendar_years(df, first, last).groupBy("cell_id", "yr").agg((F.sum(value) / F.lit(per_mm)).alias("rain_mm"))


def monthly_rain(df: DataFrame, value: str = "precip_dmm", per_mm: float = 10.0) -> DataFrame:
    return df.groupBy("cell_id", F.year("t").alias("yr"), F.month("t").alias("mo")).agg((F.sum(value) / F.lit(per_mm)).alias("rain_mm"))


def monsoon_rain(df: DataFrame, years=None, value: str = "precip_dmm", per_mm: float = 10.0) -> DataFrame:
    """Zone mean of the per-cell monsoon total per year."""
    cell = temporal.assign_season(df, RAIN_MONSOON, years).groupBy("cell_id", "yr").agg(F.sum(value).alias("s"))
    return cell.groupBy("yr").agg((F.avg("s") / F.lit(per_mm)).alias("monsoon_mm"))


def rain_series(df: DataFrame, keys=("yr",)) -> DataFrame:
    return annual_rain(df).groupBy(*keys).agg(F.avg("rain_mm").alias("mean_mm"), F.max("rain_mm").alias("max_mm"))


def with_baseline(yearly: DataFrame, value: str, first: int, last: int, deviation: bool = False) -> DataFrame:
    """Attach the cell's mean (and deviation) of the yearly values of the reference years.
    The baseline is one aggregate row per cell, joined on the cell."""
    aggs = [F.avg(value).alias("_mean")] + ([F.stddev_pop(value).alias("_std")] if deviation else [])
    base = yearly.filter(F.col("yr").between(first, last)).groupBy("cell_id").agg(*aggs)
    return yearly.join(base, "cell_id")


def rain_anomaly(df: DataFrame, first: int = 1985, last: int = 2015) -> DataFrame:
    return with_baseline(annual_rain(df), "rain_mm", first, last).select(
        "cell_id", "yr", (F.col("rain_mm") - F.col("_mean")).alias("anomaly_mm"))


def annual_lst(df: DataFrame, first=None, last=None, bands=("day", "night")) -> DataFrame:
    """Per (cell, year) mean temperature in Celsius of good observations."""
    return temporal.calendar_years(df, first, last).groupBy("cell_id", "yr").agg(
        *[celsius(F.avg(quality_lst(b))).alias(f"lst_{b}") for b in bands])


def lst_series(df: DataFrame) -> DataFrame:
    return annual_lst(df).groupBy("yr").agg(F.avg("lst_day").alias("day_c"), F.avg("lst_night").alias("night_c"))


def heat_island(lst: DataFrame, cells: DataFrame, centres: DataFrame, urban: Column, inner: Column, outer: Column,
                key: str = "disc", rural_classes=(10, 20, 40)) -> DataFrame:
    """Mean temperature in the urban disc minus the mean in a rural ring, per (centre, year).
    Disc and ring membership are two zone tables united, so temperatures join once."""
    xy = cells.select("cell_id", "x", "y")
    rural = cells.filter(F.col("worldcover").isin(list(rural_classes))).select("cell_id", "x", "y")
    discs = zones.in_discs(xy, centres.withColumn("r", urban)).select(key, "cell_id", F.lit(1).alias("_urban"))
    rings = zones.in_rings(rural, centres, inner, outer).select(key, "cell_id", F.lit(0).alias("_urban"))
    both = lst.select("cell_id", "yr", "lst_day").join(discs.unionByName(rings), "cell_id")
    wide = both.groupBy(key, "yr").agg(F.avg(F.when(F.col("_urban") == 1, F.col("lst_day"))).alias("urban_c"),
                                       F.avg(F.when(F.col("_urban") == 0, F.col("lst_day"))).alias("rural_c"))
    return wide.withColumn("uhi_c", F.col("urban_c") - F.col("rural_c"))


def seasonal_temperature(df: DataFrame, years=None) -> DataFrame:
    return seasonal_means(df, quality_lst("day"), AIR_SEASONS, years, LST_SCALE, LST_OFFSET, "_c")


def drought(df: DataFrame, first: int = 1985, last: int = 2015, lst_first: int = 2000, with_temperature: bool = True) -> DataFrame:
    """(clamped standardised rain - standardised temperature) / 2 per (cell, year); without a
    temperature product the rain term alone."""
    rain = with_baseline(annual_rain(df), "rain_mm", first, last, True)
    term = A.clamp((F.col("rain_mm") - F.col("_mean")) / F.greatest(F.col("_std"), F.lit(50.0)), -2.0, 2.0)
    rain = rain.select("cell_id", "yr", term.alias("_p"))
    if not with_temperature:
        return rain.withColumnRenamed("_p", "drought")
    lst = with_baseline(annual_lst(df, bands=("day",)), "lst_day", max(first, lst_first), last, True)
    heat = (F.col("lst_day") - F.col("_mean")) / F.greatest(F.col("_std"), F.lit(0.5))
    lst = lst.select("cell_id", "yr", heat.alias("_t"))
    return rain.join(lst, ["cell_id", "yr"], "left").select("cell_id", "yr", ((F.col("_p") - F.col("_t")) / F.lit(2.0)).alias("drought"))


def rain_summary(df: DataFrame) -> DataFrame:
    """Per year from monthly layers: sum of monthly means, largest monthly maximum, and the sum
    of the June to September means. Cells at or below zero are no data; absent months are skipped."""
    months = (monthly_rain(df).filter(F.col("rain_mm") > 0).groupBy("yr", "mo")
              .agg(F.avg("rain_mm").alias("m"), F.max("rain_mm").alias("x")))
    return months.groupBy("yr").agg(F.sum("m").alias("annual_mm"), F.max("x").alias("max_mm"),
                                    F.sum(F.when(F.col("mo").between(6, 9), F.col("m"))).alias("monsoon_mm"))


def population_summary(population: DataFrame, area: Column, keys=()) -> DataFrame:
    """Total of the cells above zero and people per km2 of those cells."""
    some = population.filter(F.col("population") > 0).groupBy(*keys).agg(
        F.sum("population").alias("population"), (F.sum(area) / F.lit(1e6)).alias("_k"))
    return some.withColumn("density_km2", F.col("population") / F.col("_k")).drop("_k")
