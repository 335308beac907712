"""Storm impact: windows around a date, per impact disc."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.functions.indices import BANDS
from gridlake.operators import histogram, temporal

# Window bounds in days from landfall, ends exclusive
PRE_DAYS = (-48, 12)
POST_DAYS = (-10, 50)


def _near(obs: DataFrame, event_cells: DataFrame, low: Column, high: Column) -> DataFrame:
    """Observations of the event's cells inside its date span: an equi join on the cell,
    then a date predicate."""
    return (obs.join(event_cells.select("disc", "event_date", "cell_id"), "cell_id")
            .filter((F.col("t") >= low) & (F.col("t") < high)))


def window_composites(obs: DataFrame, event_cells: DataFrame, bands=BANDS, pre=PRE_DAYS, post=POST_DAYS,
                      bits: int = 24) -> DataFrame:
    """Median of each band before and after, per (disc, cell). The windows may overlap, so
    both come from conditional medians in one grouped pass."""
    d = F.col("event_date")
    near = _near(temporal.cloud_free(obs, bits), event_cells,
                 F.date_add(d, min(pre[0], post[0])), F.date_add(d, max(pre[1], post[1])))
    aggs = []
    for name, (a, b) in (("pre", pre), ("post", post)):
        inside = (F.col("t") >= F.date_add(d, a)) & (F.col("t") < F.date_add(d, b))
        aggs += [F.percentile(F.when(inside, F.col(x)), F.lit(0.5)).alias(f"{name}_{x}") for x in bands]
    return near.groupBy("disc", "event_date", "cell_id").agg(*aggs)


def with_damage(composites: DataFrame) -> DataFrame:
    """NDVI before, after and drop, and the water class after."""
    c = F.col
    water = [A.flag(i >= 0) for i in (I.ndwi("post_green", "post_nir"), I.mndwi("post_green", "post_swir1"),
                                      I.awei("post_green", "post_nir", "post_swir1", "post_swir2"))]
    out = composites.withColumns({"ndvi_pre": I.ndvi("pre_nir", "pre_red"), "ndvi_post": I.ndvi("post_nir", "post_red"),
                                  "flooded": A.flag(water[0] + water[1] + water[2] >= 2)})
    return out.withColumn("ndvi_drop", c("ndvi_pre") - c("ndvi_post"))


def vegetation_damage(damage: DataFrame) -> DataFrame:
    means = [F.avg("ndvi_drop").alias("mean_drop"), F.max("ndvi_drop").alias("max_drop"), F.avg("ndvi_pre").alias("mean_pre"), F.avg("ndvi_post").alias("mean_post")]
    return histogram.with_percentiles(damage, "ndvi_drop", {"p25_drop": 0.25, "p75_drop": 0.75}, means, ("disc",), ("ndvi_pre", "ndvi_post"))


def flood_extent(damage: DataFrame, area: Column) -> DataFrame:
    return damage.groupBy("disc").agg(A.km2(F.col("flooded"), area).alias("flood_km2"))


def damage_areas(damage: DataFrame, area: Column, severe: float = 0.20, moderate: float = 0.10,
                 mild: float = 0.05) -> DataFrame:
    """km2 per tier of NDVI drop plus the flood extent, one pass."""
    d = F.col("ndvi_drop")
    return damage.groupBy("disc").agg(
        A.km2(A.flag(d >= severe), area).alias("severe_km2"),
        A.km2(A.mask_and(A.flag(d >= moderate), A.flag(d < severe)), area).alias("moderate_km2"),
        A.km2(A.mask_and(A.flag(d >= mild), A.flag(d < moderate)), area).alias("mild_km2"),
        A.km2(A.flag(d >= mild), area).alias("damaged_km2"), A.km2(F.col("flooded"), area).alias("flood_km2"))


def compare_all(events: DataFrame, damage: DataFrame, area: Column) -> DataFrame:
    """One row per event in date order; an event without data keeps NULL areas and a status."""
    areas = damage_areas(damage, area)
    return (events.select("disc", "event_date").join(areas, "disc", "left")
            .withColumn("status", F.when(F.col("damaged_km2").isNull(), F.lit("no data")).otherwise(F.lit("ok")))
            .orderBy("event_date", "disc"))


def ndvi_drop(vegetation: DataFrame, event_cells: DataFrame, months: int = 3, scale: float = 1e-4,
              years: tuple | None = None) -> DataFrame:
    """Mean NDVI before minus after per cell, then zone mean and maximum.

    ``years=(pre, post)`` compares two calendar years instead of the months around the date."""
    d, t = F.col("event_date"), F.col("t")
    if years is None:
        near = _near(vegetation, event_cells, F.add_months(d, -months), F.add_months(d, months))
        before, after = t < d, t >= d
    else:
        near = temporal.calendar_years(vegetation, min(years), max(years)).join(
            event_cells.select("disc", "event_date", "cell_id"), "cell_id")
        before, after = F.col("yr") == years[0], F.col("yr") == years[1]
    per_cell = near.groupBy("disc", "cell_id").agg(
        ((F.avg(F.when(before, F.col("ndvi_dn"))) - F.avg(F.when(after, F.col("ndvi_dn")))) * F.lit(scale)).alias("drop"))
    return per_cell.groupBy("disc").agg(F.avg("drop").alias("mean_drop"), F.max("drop").alias("max_drop"))
