"""Composite indices: deprivation, informal settlement, health risk."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.operators import focal, histogram, temporal
from gridlake.plans import climate, vegetation
from gridlake.plans import lights as L

ONE = 1.0


def yearly_inputs(signals: DataFrame, last_a: int = L.LAST_YEAR_A) -> DataFrame:
    """Light, greenness and day temperature per (cell, year) in one pass; what a query leaves unused is pruned."""
    found = temporal.calendar_years(signals).groupBy("cell_id", "yr").agg(
        F.percentile("light_dn", F.lit(0.5)).alias("_m"), F.avg("light_dn").alias("_a"),
        (F.max(vegetation.good_quality("ndvi_dn")) * F.lit(vegetation.SCALE)).alias("ndvi"),
        climate.celsius(F.avg(climate.quality_lst("day"))).alias("lst_day"))
    light = F.when(F.col("yr") <= last_a, F.col("_m")).otherwise(F.col("_a"))
    return found.select("cell_id", "yr", light.alias("light"), "ndvi", "lst_day")


def cropland_fraction(cells: DataFrame, radius_cells: int, code: int = 40) -> DataFrame:
    """Share of cropland cells in a disc around every cell."""
    mask = cells.select("cell_id", "x", "y", A.flag(F.col("worldcover") == code).alias("_c"))
    k = focal.disc_kernel(mask, "_c", radius_cells)
    return k.select("cell_id", focal.disc_mean().alias("cropland_fraction"))


def built_fraction(built: Column) -> Column:
    return A.clamp(built / F.lit(10000.0), 0.0, 1.0)


def deprivation_index(df: DataFrame, last_a: int = L.LAST_YEAR_A, built: str | None = "built",
                      population: str | None = "population", ndvi: str | None = "ndvi") -> DataFrame:
    """Mean of four deprivations in 0..1. A table that is absent (None) counts as 0.5; a NULL
    cell stays NULL. Light has no fallback."""
    dark = F.lit(ONE) - L.light_norm(F.col("light"), F.col("yr"), last_a)
    unbuilt = F.lit(0.5) if built is None else F.lit(ONE) - built_fraction(F.col(built))
    gap = F.lit(0.5) if population is None else A.norm(F.col(population), 0, 25000) * dark
    stress = F.lit(0.5) if ndvi is None else F.lit(ONE) - A.norm(F.col(ndvi), 0, 0.9)
    return df.withColumn("deprivation", (dark + unbuilt + gap + stress) / F.lit(4.0))


def deprivation_level(index: Column) -> Column:
    return F.when(index < 0.25, 1).when(index < 0.5, 2).when(index < 0.75, 3).when(index.isNotNull(), 4)


def stats_by_zone(index: DataFrame, value: str, zone_cells: DataFrame, key: str) -> DataFrame:
    zoned = index.select("cell_id", "yr", value).join(zone_cells.select(key, "cell_id"), "cell_id")
    return mean_median(zoned, value, (key, "yr"))


def mean_median(df: DataFrame, value: str, keys) -> DataFrame:
    return histogram.with_percentiles(df, value, {"median": 0.5}, [F.avg(value).alias("mean")], keys)


def index_change(index: DataFrame, value: str, year1: int, year2: int) -> DataFrame:
    wide = index.filter(F.col("yr").isin(year1, year2)).groupBy("cell_id").agg(
        F.max(F.when(F.col("yr") == year1, F.col(value))).alias("_1"),
        F.max(F.when(F.col("yr") == year2, F.col(value))).alias("_2"))
    return wide.select("cell_id", (F.col("_2") - F.col("_1")).alias("change"))


def zone_ranking(index: DataFrame, value: str, zone_cells: DataFrame, key: str) -> DataFrame:
    """Zones of a year by mean index, most deprived first. The window holds one row per zone."""
    from pyspark.sql import Window
    means = (index.join(zone_cells.select(key, "cell_id"), "cell_id").groupBy(key, "yr").agg(F.avg(value).alias("mean")))
    order = Window.partitionBy("yr").orderBy(F.desc(F.round("mean", 9)), key)
    return means.withColumn("rank", F.row_number().over(order))


# --- informal settlement ------------------------------------------------------

def vegetation_deficit(ndvi: Column) -> Column:
    return F.lit(ONE) - A.clamp(ndvi, 0.0, 0.6) / F.lit(0.6)


def overcrowding(population: Column, built: Column) -> Column:
    return A.norm(population / A.max2(built.cast("double"), F.lit(1.0)), 0, 0.1)


def light_deficit(light_norm: Column, built: Column) -> Column:
    safe = A.max2(A.norm(built, 0, 10000), F.lit(0.01))
    return F.lit(ONE) - A.clamp(light_norm / safe, 0.0, 1.0)


def building_density(settlement: DataFrame, radius_cells: int, keys=("epoch",), beside=(), tasks: int | None = None) -> DataFrame:
    """Mean built-up surface of the disc around the cell; ``beside`` names columns that stay with the row."""
    kept = [c for c in beside if c != "built"]
    k = focal.disc_kernel(settlement.select(*keys, "cell_id", "x", "y", "built", *kept), "built", radius_cells, keys, tasks=tasks)
    return k.select(*keys, "cell_id", *beside, focal.disc_mean().alias("building_density"))


def texture(composites: DataFrame, keys=("yr",), scale: float = 1.0) -> DataFrame:
    """Co-occurrence entropy of the near-infrared band truncated to integers."""
    band = composites.withColumn("_n", (F.col("nir") * F.lit(scale)).cast("int"))
    return focal.texture_entropy(band.select(*keys, "cell_id", "x", "y", "_n"), "_n", keys).drop("_n")


def temperature_anomaly(lst: DataFrame, radius_cells: int, keys=("yr",), value: str = "lst_day", tasks: int | None = None) -> DataFrame:
    """Temperature minus the mean of the disc around the cell."""
    k = focal.disc_kernel(lst, value, radius_cells, keys, tasks=tasks)
    return k.withColumn("lst_anomaly", F.col(value) - focal.disc_mean()).drop("disc_sum", "disc_count")


def weighted_index(df: DataFrame, out: str, parts: dict[str, tuple[Column, float]]) -> DataFrame:
    """Weighted sum over the inputs that are present, weights rescaled to 1. Dropping an input
    is a decision about tables; a NULL cell in any used input masks the sum there."""
    total = sum(w for _, w in parts.values())
    index = None
    for column, weight in parts.values():
        term = column * F.lit(weight / total)
        index = term if index is None else index + term
    return df.withColumn(out, index)


def settlement_index(df: DataFrame, last_a: int = L.LAST_YEAR_A, without=()) -> DataFrame:
    """Needs building_density, ndvi, population, built, lst_anomaly, light, smod; ``without``
    names inputs that are not available. Kept only on settled cells (code >= 21)."""
    c = F.col
    parts = {
        "density": (A.norm(c("building_density"), 0, 5000), 0.25),
        "vegetation": (vegetation_deficit(c("ndvi")), 0.20),
        "crowding": (overcrowding(c("population"), c("built")), 0.25),
        "temperature": (A.norm(c("lst_anomaly"), -5, 5), 0.15),
        "light": (light_deficit(L.light_norm(c("light"), c("yr"), last_a), c("built")), 0.15),
    }
    out = weighted_index(df, "slum_index", {k: v for k, v in parts.items() if k not in without})
    return out.withColumn("slum_index", F.when(c("smod") >= 21, c("slum_index")))


def risk_class(index: Column) -> Column:
    """1 low to 4 very high; a masked cell is 0."""
    return A.where_chain(0, (index < 0.3, 1), ((index >= 0.3) & (index < 0.5), 2),
                         ((index >= 0.5) & (index < 0.7), 3), (index >= 0.7, 4))


def index_area(index: DataFrame, area: Column, threshold: float = 0.6) -> DataFrame:
    return index.groupBy("yr").agg(A.km2(A.flag(F.col("slum_index") > threshold), area).alias("slum_km2"))


def index_growth(index: DataFrame, area: Column, year1: int, year2: int, threshold: float = 0.6) -> DataFrame:
    wide = index.filter(F.col("yr").isin(year1, year2)).groupBy("cell_id").agg(*[
        A.flag(F.max(F.when(F.col("yr") == y, F.col("slum_index"))) > threshold).alias(n) for n, y in (("s1", year1), ("s2", year2))])
    s1, s2 = F.col("s1"), F.col("s2")
    return wide.agg(A.km2(A.mask_and(s2, A.mask_not(s1)), area).alias("new_slum_km2"),
                    A.km2(A.mask_and(s1, A.mask_not(s2)), area).alias("cleared_slum_km2"))


def known_areas(index: DataFrame, zone_cells: DataFrame, key: str) -> DataFrame:
    return (index.join(zone_cells.select(key, "cell_id"), "cell_id").groupBy(key, "yr")
            .agg(F.avg("slum_index").alias("mean_index"), F.max("slum_index").alias("max_index")))


# --- health risk ----------------------------------------------------------------

def heat_count(df: DataFrame, limit_c: float = 40.0, years=None) -> DataFrame:
    """Number of images in March to October above the limit per (cell, year); no quality filter."""
    from gridlake.model import HEAT_SEASON
    from gridlake.operators import temporal
    from gridlake.plans.climate import celsius
    return (temporal.assign_season(df, HEAT_SEASON, years).groupBy("cell_id", "yr")
            .agg(F.sum(A.flag(celsius(F.col("lst_day_dn")) > limit_c)).alias("hot_images")))


def water_habitat(composites: DataFrame, seasonal_mode: DataFrame, flooded_class: int = 3) -> DataFrame:
    """LSWI > 0 in the monsoon composite or the seasonal land-cover mode is flooded vegetation."""
    both = composites.join(seasonal_mode.withColumnRenamed("label", "_l"), ["cell_id", "yr"])
    return both.select("cell_id", "yr", A.mask_or(A.flag(I.lswi() > 0), A.flag(F.col("_l") == flooded_class)).alias("habitat"))


def pollution_risk(df: DataFrame, qa: Column, no2_scale: float, aerosol_scale: float, first_year: int = 2019) -> DataFrame:
    """Mean of scaled nitrogen dioxide and aerosol of the dry season; no rows before the first year."""
    from gridlake.model import POLLUTION_SEASON
    from gridlake.operators import temporal
    from gridlake.plans import air
    tagged = temporal.assign_season(df, POLLUTION_SEASON)
    cell = air.composites(tagged.filter(F.col("yr") >= first_year), qa, ("cell_id", "yr"), ("no2", "aerosol"),
                          {"no2": no2_scale, "aerosol": aerosol_scale})
    risk = (A.norm(F.col("no2"), 0, 0.0002) + A.norm(F.col("aerosol"), -1, 3)) / F.lit(2.0)
    return cell.select("cell_id", "yr", risk.alias("pollution_risk"))


def hazard_map(cells: DataFrame, zone_cells: DataFrame) -> DataFrame:
    """1 inside any hazard disc, else 0."""
    inside = zone_cells.select("cell_id").distinct().withColumn("_h", F.lit(1))
    return cells.join(inside, "cell_id", "left").select("cell_id", A.unmask(F.col("_h")).alias("hazard"))


def health_index(df: DataFrame, without=()) -> DataFrame:
    """Needs waterlog, hot_images, population, pollution_risk, ndvi unless named in ``without``."""
    c = F.col
    parts = {
        "waterlog": (c("waterlog").cast("double"), 0.25), "heat": (A.norm(c("hot_images"), 0, 90), 0.20),
        "population": (A.norm(c("population"), 0, 10000), 0.20), "pollution": (c("pollution_risk"), 0.20),
        "vegetation": (vegetation_deficit(c("ndvi")), 0.15),
    }
    parts = {k: v for k, v in parts.items() if k not in without}
    return weighted_index(df, "health_risk", parts)
