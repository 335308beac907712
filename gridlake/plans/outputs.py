"""Tables behind maps and animations, and report summaries."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import BUILT_EPOCHS, NDVI_FRAME, WATER_FRAME, Grid
from gridlake.operators import temporal
from gridlake.plans import floods
from gridlake.plans.lights import LAST_YEAR_A


def urban_frames(settlement: DataFrame, first: int, last: int, epochs=BUILT_EPOCHS) -> DataFrame:
    """Built-up per cell for the distinct epochs nearest to the years of a range."""
    used = sorted({temporal.snap_int(y, epochs) for y in range(first, last + 1)})
    return settlement.filter(F.col("epoch").isin(used)).select("epoch", "cell_id", "built")


def ndvi_frames(vegetation: DataFrame, years=None) -> DataFrame:
    return (temporal.assign_season(vegetation, NDVI_FRAME, years).groupBy("yr", "cell_id")
            .agg((F.avg("ndvi_dn") * F.lit(1e-4)).alias("ndvi")))


def water_frames(water: DataFrame, years=None) -> DataFrame:
    return temporal.assign_season(water, WATER_FRAME, years).groupBy("yr", "cell_id").agg(F.max("water_month").alias("water"))


def light_frames(signals: DataFrame, last_a: int = LAST_YEAR_A) -> DataFrame:
    """Yearly mean light scaled to 0..1: sensor A by 63, sensor B clamped at 100."""
    mean = temporal.calendar_years(signals).groupBy("yr", "cell_id").agg(F.avg("light_dn").alias("v"))
    return mean.select("yr", "cell_id", F.when(F.col("yr") <= last_a, F.col("v") / F.lit(63.0))
                       .otherwise(A.clamp(F.col("v") / F.lit(100.0), 0.0, 1.0)).alias("lights"))


def seasonal_overlay(obs: DataFrame, years=None) -> DataFrame:
    """dry + 2 x monsoon per cell: 0 land, 1 dry season only, 2 monsoon only, 3 both."""
    m = floods.seasonal_masks(obs, years)
    return m.select("cell_id", "yr", (F.col("dry") + F.lit(2) * F.col("monsoon")).alias("code"))


def overlay_areas(overlay: DataFrame, grid: Grid) -> DataFrame:
    return (grid.attach(overlay).filter(F.col("code").isNotNull()).groupBy("yr", "code")
            .agg((F.sum("area_m2") / F.lit(1e6)).alias("area_km2")))
