"""Wetland delineation, filling cycles and period comparison."""
import math
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import EXTREME_FLOOD_YEARS, MONSOON, Grid
from gridlake.operators import focal, temporal, zones
from gridlake.plans.water import WATER_BANDS, classify


def sample_years(first: int = 2000, last: int = 2024, extreme=EXTREME_FLOOD_YEARS):
    return sorted(set(range(first, last + 1, 2)) | {y for y in extreme if first <= y <= last})


def seasonal_water(obs: DataFrame, season=MONSOON, years=None) -> DataFrame:
    tagged = temporal.assign_season(temporal.cloud_free(obs), season, years)
    return classify(temporal.composite(tagged, ["cell_id", "yr"], bands=WATER_BANDS)).select("cell_id", "yr", "water")


def delineate(obs: DataFrame, cells: DataFrame, zone_cells: DataFrame, years, max_elevation: int = 12) -> DataFrame:
    """Cells of each zone that lie low and were monsoon water in any sample year."""
    low = cells.filter(F.col("elevation") <= max_elevation).select("cell_id")
    inside = zone_cells.join(low, "cell_id")
    near = obs.join(inside.select("cell_id").distinct(), "cell_id", "left_semi")
    ever = (seasonal_water(near, MONSOON, (min(years), max(years))).filter(F.col("yr").isin(list(years)))
            .groupBy("cell_id").agg(F.max("water").alias("_ever")).filter(F.col("_ever") == 1))
    return inside.join(ever, "cell_id").drop("_ever")


def area_series(obs: DataFrame, zone_cells: DataFrame, grid: Grid, key: str, season=MONSOON, years=None) -> DataFrame:
    """Despeckled water area per (zone, year). Only cells of zones and their halo are
    composited; the opening runs once for all zones."""
    obs = obs.join(zones.with_halo(zone_cells, grid), "cell_id", "left_semi")
    opened = focal.opening(grid.attach(seasonal_water(obs, season, years)), "water", ["yr"], "_o")
    return (opened.select("cell_id", "yr", "_o", "area_m2").join(zone_cells.select(key, "cell_id"), "cell_id")
            .groupBy(key, "yr").agg(A.km2(F.col("_o"), F.col("area_m2")).alias("area_km2")))


def monthly_cycle(obs: DataFrame, places: DataFrame, zone_cells: DataFrame, grid: Grid, key: str, years) -> DataFrame:
    """12 rows per (zone, year); a month without a clear scene has NULL area."""
    obs = obs.join(zones.with_halo(zone_cells, grid), "cell_id", "left_semi")
    tagged = temporal.between(temporal.cloud_free(obs), date(years[0], 1, 1), date(years[1] + 1, 1, 1)).withColumns(
        {"yr": F.year("t"), "mo": F.month("t")})
    water = classify(temporal.composite(tagged, ["cell_id", "yr", "mo"], bands=WATER_BANDS))
    opened = focal.opening(grid.attach(water), "water", ["yr", "mo"], "_o")
    area = (opened.select("cell_id", "yr", "mo", "_o", "area_m2").join(zone_cells.select(key, "cell_id"), "cell_id")
            .groupBy(key, "yr", "mo").agg(A.km2(F.col("_o"), F.col("area_m2")).alias("area_km2")))
    calendar = (places.select(key).withColumn("yr", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
                .withColumn("mo", F.explode(F.sequence(F.lit(1), F.lit(12)))))
    return calendar.join(area, [key, "yr", "mo"], "left")


def average_cycle(cycle: DataFrame, key: str) -> DataFrame:
    return cycle.groupBy(key, "mo").agg(F.avg("area_km2").alias("mean_km2"), F.count("area_km2").alias("years"))


def compare_periods(places: DataFrame, series: DataFrame, key: str, first, second) -> DataFrame:
    """Mean area of two year ranges, change and percent; the percent is 0 for a base within
    0.01 km2 of zero and NULL when the first range has no data."""
    def mean(span):
        return F.avg(F.when(F.col("yr").between(*span), F.col("area_km2")))
    wide = series.groupBy(key).agg(mean(first).alias("_p1"), mean(second).alias("_p2"))
    p1, p2 = F.coalesce("_p1", F.lit(0.0)), F.coalesce("_p2", F.lit(0.0))
    pct = F.when(F.col("_p1").isNull(), F.lit(None).cast("double")).when(
        F.abs("_p1") > 0.01, (p2 - p1) / F.nullif(p1, F.lit(0.0)) * F.lit(100.0)).otherwise(F.lit(0.0))
    return places.select(key).join(wide, key, "left").select(
        key, p1.alias("period1_km2"), p2.alias("period2_km2"), (p2 - p1).alias("change_km2"), pct.alias("change_pct"))


def plausible(series: DataFrame, places: DataFrame, key: str, radius_m, share: float = 0.01) -> DataFrame:
    """Drop areas that are NULL or below a share of the disc area."""
    floor = F.lit(share * math.pi) * (radius_m / F.lit(1000.0)) * (radius_m / F.lit(1000.0))
    limits = places.select(key, floor.alias("min_km2"))
    return series.join(limits, key).filter(F.col("area_km2") >= F.col("min_km2"))
