"""Seasonal inundation."""
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import DRY_MONSOON, EXTREME_FLOOD_YEARS, Grid
from gridlake.operators import focal, temporal
from gridlake.plans import water
from gridlake.plans.water import WATER_BANDS


def conditional_masks(df: DataFrame, keys, labels: dict, bands=WATER_BANDS, thresholds=(0.0, 0.0, 0.0)) -> DataFrame:
    """Water mask per label as columns, from one grouped pass.

    ``labels`` maps an output name to a row condition; each gets its own conditional
    medians, so several seasons or windows share a single shuffle."""
    wide = df.groupBy(*keys).agg(*[F.percentile(F.when(cond, F.col(b)), F.lit(0.5)).alias(f"_{name}_{b}")
                                   for name, cond in labels.items() for b in bands])
    for name in labels:
        g, n, s1, s2 = (F.col(f"_{name}_{b}") for b in WATER_BANDS)
        reach = [A.flag(index >= F.lit(float(bound))) for index, bound in
                 zip((I.ndwi(g, n), I.mndwi(g, s1), I.awei(g, n, s1, s2)), thresholds)]
        wide = wide.withColumn(name, A.flag(sum(reach[1:], reach[0]) >= 2))
    return wide.select(*keys, *labels)


def seasonal_masks(obs: DataFrame, years=None, seasons=DRY_MONSOON, bits: int = 24, method: str = "fixed",
                   thresholds=(0.0, 0.0, 0.0)) -> DataFrame:
    """(cell_id, yr, dry, monsoon, flood): flood = monsoon and not dry; a missing side masks it.

    otsu finds a threshold per index, year and season, with the given ones where a band is masked."""
    tagged = temporal.assign_season(temporal.cloud_free(obs, bits), seasons, years)
    if method == "fixed":
        masks = conditional_masks(tagged, ["cell_id", "yr"], {s.name: F.col("season") == s.name for s in seasons}, thresholds=thresholds)
    else:
        each = water.classify(temporal.composite(tagged, ["cell_id", "yr", "season"], bands=WATER_BANDS), ["yr", "season"], method, thresholds)
        masks = each.groupBy("cell_id", "yr").agg(*[F.max(F.when(F.col("season") == s.name, F.col("water"))).alias(s.name) for s in seasons])
    return masks.withColumn("flood", A.mask_and(F.col("monsoon"), A.mask_not(F.col("dry"))))


def annual_extents(obs: DataFrame, grid: Grid, years=None, method: str = "fixed") -> DataFrame:
    """Despeckled dry, monsoon and seasonal areas per year.

    The monsoon area is raised to the dry area when smaller (clamped = 1); seasonal_km2
    is their difference, seasonal_mask_km2 the area of the flood mask itself."""
    opened = focal.openings(grid.attach(seasonal_masks(obs, years, method=method)), {f"_{n}": n for n in ("dry", "monsoon", "flood")}, ["yr"])
    areas = opened.groupBy("yr").agg(*[A.km2(F.col(f"_{n}"), F.col("area_m2")).alias(f"_{n}_km2")
                                       for n in ("dry", "monsoon", "flood")])
    dry, monsoon = F.col("_dry_km2"), F.col("_monsoon_km2")
    return areas.select("yr", dry.alias("dry_km2"), A.max2(monsoon, dry).alias("monsoon_km2"),
                        F.col("_flood_km2").alias("seasonal_mask_km2"),
                        (A.max2(monsoon, dry) - dry).alias("seasonal_km2"), A.flag(monsoon < dry).alias("clamped"))


def time_series(obs: DataFrame, grid: Grid, start: int, end: int, step: int = 1, method: str = "fixed") -> DataFrame:
    """annual_extents for start, start+step, ...; other years never enter the shuffle."""
    wanted = list(range(start, end + 1, step))
    reach = temporal.between(obs, date(start - 1, 1, 1), date(end + 1, 1, 1))      # the range reaches the scan
    reach = reach.filter(F.year("t").isin(sorted({y + d for y in wanted for d in (-1, 0)})))
    return annual_extents(reach, grid, (start, end), method).filter(F.col("yr").isin(wanted))


def extreme_year_anomaly(series: DataFrame, extreme=EXTREME_FLOOD_YEARS, reach: int = 5) -> DataFrame:
    """Monsoon area minus the mean of the ordinary years within +-reach; 0 without any.

    The window runs over one row per year."""
    w = Window.partitionBy(F.lit(0)).orderBy("yr").rangeBetween(-reach, reach)
    ordinary = F.when(~F.col("yr").isin(list(extreme)), F.col("monsoon_km2"))
    return (series.withColumn("reference_km2", F.coalesce(F.avg(ordinary).over(w), F.lit(0.0)))
            .withColumn("anomaly_km2", F.col("monsoon_km2") - F.col("reference_km2"))
            .select("yr", "monsoon_km2", "reference_km2", "anomaly_km2"))


def share_by_zone(masks: DataFrame, value: str, zone_cells: DataFrame, grid: Grid) -> DataFrame:
    """Water km2, zone km2 and percentage per (zone, yr)."""
    cells = grid.attach(zone_cells.select("zone", "cell_id"))
    total = cells.groupBy("zone").agg((F.sum("area_m2") / F.lit(1e6)).alias("zone_km2"))
    wet = (masks.select("cell_id", "yr", F.col(value).alias("_v")).join(cells, "cell_id").groupBy("zone", "yr")
           .agg(A.km2(F.col("_v"), F.col("area_m2")).alias("water_km2")))
    return wet.join(total, "zone").withColumn("water_pct", A.ratio(F.col("water_km2"), F.col("zone_km2")) * F.lit(100.0))


def frequency(masks: DataFrame, value: str = "monsoon") -> DataFrame:
    """Share of observed years with water in the monsoon per cell; permanent water has 1."""
    return masks.groupBy("cell_id").agg(F.count(value).alias("years"), F.avg(value).alias("frequency"))


def trend(masks: DataFrame, start: int, end: int, value: str = "monsoon") -> DataFrame:
    """Frequency of the later half minus frequency of the earlier half."""
    mid = (start + end) // 2
    early = F.avg(F.when(F.col("yr").between(start, mid), F.col(value)))
    late = F.avg(F.when(F.col("yr").between(mid + 1, end), F.col(value)))
    return masks.groupBy("cell_id").agg(early.alias("early"), late.alias("late"), (late - early).alias("trend"))
