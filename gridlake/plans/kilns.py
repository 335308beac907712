"""Brick-kiln candidates: thermal hotspots, bare-soil signature, emissions."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import KILN_SPECTRAL, KILN_THERMAL
from gridlake.operators import temporal
from gridlake.plans.climate import celsius

# Average kiln footprint in km2, tonnes per kiln and year
KILN_KM2, CO2_TONNES, PM25_TONNES = 0.04, 4600.0, 1.5


def dry_lst(df: DataFrame, years=None) -> DataFrame:
    """Mean day temperature of the kiln season per (cell, year); no quality filter."""
    return temporal.assign_season(df, KILN_THERMAL, years).groupBy("cell_id", "yr").agg(celsius(F.avg("lst_day_dn")).alias("lst_c"))


def season_composite(obs: DataFrame, sensor_of_year: Column, sensor: str = "sensor_no", scene_cloud: int = 20) -> DataFrame:
    """Median of one sensor per season year, scenes below a cloud share, no pixel cloud mask."""
    tagged = temporal.assign_season(obs, KILN_SPECTRAL).filter((F.col("scene_cloud_pct") < scene_cloud) & (F.col(sensor) == sensor_of_year))
    return temporal.composite(tagged, ["cell_id", "yr"], bands=("blue", "red", "nir", "swir1"))


def hotspots(lst: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """1 where the temperature reaches the year's mean plus ``sigmas`` deviations."""
    bound = lst.groupBy("yr").agg((F.avg("lst_c") + F.lit(sigmas) * F.stddev_pop("lst_c")).alias("threshold"))
    return lst.join(F.broadcast(bound), "yr").withColumn("hotspot", A.flag(F.col("lst_c") >= F.col("threshold")))


def hotspot_areas(hot: DataFrame, area: Column) -> DataFrame:
    return hot.groupBy("yr").agg(F.max("threshold").alias("threshold"), A.km2(F.col("hotspot"), area).alias("hotspot_km2"))


def spectral_mask(composites: DataFrame, zone_cells: DataFrame) -> DataFrame:
    """Bare soil > 0.05, swir1/nir > 1 and NDVI < 0.2, set to 0 outside the known discs."""
    signature = A.mask_and(A.flag(I.bare_soil() > 0.05), A.flag(A.ratio(F.col("swir1"), F.col("nir")) > 1.0), A.flag(I.ndvi() < 0.2))
    inside = zone_cells.select("cell_id").distinct().withColumn("_z", F.lit(1))
    return (composites.withColumn("_s", signature).join(inside, "cell_id", "left")
            .select("cell_id", "yr", A.mask_and(F.col("_s"), A.unmask(F.col("_z"))).alias("kiln")))


def candidate_areas(mask: DataFrame, area: Column) -> DataFrame:
    return mask.groupBy("yr").agg(A.km2(F.col("kiln"), area).alias("candidate_km2"))


def density_by_zone(hot: DataFrame, zone_cells: DataFrame, key: str) -> DataFrame:
    return (hot.join(zone_cells.select(key, "cell_id"), "cell_id").groupBy(key, "yr")
            .agg(F.sum("hotspot").alias("hotspot_cells"), F.avg("hotspot").alias("hotspot_share")))


def series(thermal: DataFrame, spectral: DataFrame) -> DataFrame:
    """Both areas per year; a year missing on one side keeps NULL there."""
    return thermal.select("yr", "hotspot_km2").join(spectral, "yr", "full_outer")


def emissions(areas: DataFrame, km2: str = "candidate_km2") -> DataFrame:
    kilns = F.col(km2) / F.lit(KILN_KM2)
    return areas.withColumns({"kilns": kilns, "co2_tonnes": kilns * F.lit(CO2_TONNES), "pm25_tonnes": kilns * F.lit(PM25_TONNES)})
