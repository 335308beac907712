"""Vegetation indices over time, forest layers, cropland."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import NDVI_SEASONS
from gridlake.operators import temporal

SCALE = 1e-4


def good_quality(value: str, qa: str = "summary_qa", limit: int = 1) -> Column:
    return F.when(F.col(qa) <= limit, F.col(value))


def annual_max(df: DataFrame, first=None, last=None, qa_mask: bool = True) -> DataFrame:
    """Per-cell yearly maximum of NDVI and EVI, scaled after the aggregate."""
    years = temporal.calendar_years(df, first, last)
    aggs = [(F.max(good_quality(b) if qa_mask else F.col(b)) * F.lit(SCALE)).alias(n)
            for b, n in (("ndvi_dn", "ndvi"), ("evi_dn", "evi"))]
    return years.groupBy("cell_id", "yr").agg(*aggs)


def annual_mean(df: DataFrame, first=None, last=None, qa_mask: bool = True, value: str = "ndvi_dn") -> DataFrame:
    years = temporal.calendar_years(df, first, last)
    return years.groupBy("cell_id", "yr").agg(
        (F.avg(good_quality(value) if qa_mask else F.col(value)) * F.lit(SCALE)).alias("ndvi"))


def ndvi_series(df: DataFrame, first=None, last=None, keys=("yr",)) -> DataFrame:
    """Zone mean of the per-cell yearly mean and of the per-cell yearly maximum."""
    v = good_quality("ndvi_dn")
    per_cell = temporal.calendar_years(df, first, last).groupBy("cell_id", "yr").agg(F.avg(v).alias("a"), F.max(v).alias("m"))
    return per_cell.groupBy(*keys).agg((F.avg("a") * F.lit(SCALE)).alias("mean_ndvi"), (F.avg("m") * F.lit(SCALE)).alias("max_ndvi"))


def seasonal_means(df: DataFrame, value: Column, seasons, years=None, scale: float = 1.0, offset: float = 0.0,
                   suffix: str = "") -> DataFrame:
    """Per season year one column per season: mean over cells of the per-cell mean.

    Conditional averages per (cell, year) replace a filtered scan per season."""
    tagged = temporal.assign_season(df.withColumn("_v", value), seasons, years)
    per_cell = tagged.groupBy("cell_id", "yr").agg(*[
        F.avg(F.when(F.col("season") == s.name, F.col("_v"))).alias(s.name) for s in seasons])
    return per_cell.groupBy("yr").agg(*[(F.avg(s.name) * F.lit(scale) + F.lit(offset)).alias(f"{s.name}{suffix}") for s in seasons])


def seasonal_ndvi(df: DataFrame, years=None) -> DataFrame:
    return seasonal_means(df, good_quality("ndvi_dn"), NDVI_SEASONS, years, SCALE, suffix="_ndvi")


def forest_layers(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", "treecover", A.flag(F.col("lossyear") > 0).alias("loss"), "gain", "lossyear")


def forest_stats(cells: DataFrame, threshold: int = 30, keys=()) -> DataFrame:
    """Forest, loss and gain km2; loss and gain are not limited to forest."""
    area = F.col("area_m2")
    return cells.groupBy(*keys).agg(
        A.km2_where(F.col("treecover") >= threshold, area).alias("forest_km2"),
        A.km2_where(F.col("lossyear") > 0, area).alias("loss_km2"),
        A.km2_where(F.col("gain") == 1, area).alias("gain_km2"))


def forest_loss_by_year(cells: DataFrame, threshold: int | None = 30, last_code: int = 23) -> DataFrame:
    """km2 lost per year code 1..last; a year without loss gives 0. threshold None = all cells."""
    base = cells if threshold is None else cells.filter(F.col("treecover") >= threshold)
    found = (base.filter(F.col("lossyear").between(1, last_code)).groupBy("lossyear")
             .agg((F.sum("area_m2") / F.lit(1e6)).alias("_k")))
    codes = cells.sparkSession.range(1, last_code + 1).select(F.col("id").cast("int").alias("lossyear"))
    return codes.join(found, "lossyear", "left").select(
        (F.col("lossyear") + 2000).alias("yr"), F.coalesce("_k", F.lit(0.0)).alias("loss_km2"))


def cropland(code: int = 40, column: str = "worldcover") -> Column:
    return A.flag(F.col(column) == code)


def cropland_area(cells: DataFrame, code: int = 40, keys=()) -> DataFrame:
    return cells.groupBy(*keys).agg(A.km2(cropland(code), F.col("area_m2")).alias("cropland_km2"))


def crop_health(composites: DataFrame, vegetation: DataFrame, first: int = 2000, last: int = 2020) -> DataFrame:
    """Composite NDVI minus the long-term mean NDVI of the cell (no quality filter)."""
    base = (temporal.between(vegetation, f"{first}-01-01", f"{last}-12-31").groupBy("cell_id")
            .agg((F.avg("ndvi_dn") * F.lit(SCALE)).alias("_base")))
    return (composites.join(base, "cell_id").withColumn("ndvi_anomaly", I.ndvi() - F.col("_base")).drop("_base"))
