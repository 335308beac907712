"""Low coast, shoreline, mangrove and new land."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import DECADE_YEARS, DRY, Grid
from gridlake.operators import temporal, topology
from gridlake.plans import rivers
from gridlake.plans.floods import conditional_masks


def low_coast(threshold: float, elevation: str = "elevation") -> Column:
    e = F.col(elevation)
    return A.mask_and(A.flag(e >= 0), A.flag(e < threshold))


def low_coast_areas(cells: DataFrame, thresholds=(1, 2, 3, 5, 10)) -> DataFrame:
    """km2 per threshold: one conditional sum each in a single pass, then unpivoted."""
    wide = cells.agg(*[A.km2(low_coast(t), F.col("area_m2")).alias(f"_{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold_m"), F.col(f"_{t}").alias("area_km2")) for t in thresholds])
    return wide.select(F.inline(rows))


def low_coast_population(cells: DataFrame, population: DataFrame, threshold: float = 5, keys=()) -> DataFrame:
    """Population on cells below the threshold; population(cell_id, population, keys)."""
    low = cells.filter(low_coast(threshold) == 1).select("cell_id")
    return (population.join(low, "cell_id", "left_semi").groupBy(*keys)
            .agg(F.sum("population").alias("population_in_zone")))


def dry_water_years(obs: DataFrame, years) -> DataFrame:
    """(cell_id, w_<year>...) dry-season water of the given years in one grouped pass."""
    tagged = temporal.assign_season(temporal.cloud_free(obs), DRY, (min(years), max(years)))
    return conditional_masks(tagged, ["cell_id"], {f"w_{y}": F.col("yr") == y for y in years})


def shoreline_change(wide: DataFrame, years, area: Column) -> DataFrame:
    """Accretion and erosion km2 per neighbouring pair of years."""
    pairs = list(zip(years, years[1:]))
    aggs = []
    for a, b in pairs:
        w1, w2 = F.col(f"w_{a}"), F.col(f"w_{b}")
        aggs += [A.km2(A.mask_and(w1, A.mask_not(w2)), area).alias(f"_a{a}"),
                 A.km2(A.mask_and(w2, A.mask_not(w1)), area).alias(f"_e{a}")]
    rows = F.array(*[F.struct(F.lit(a).alias("year1"), F.lit(b).alias("year2"), F.col(f"_a{a}").alias("accretion_km2"),
                              F.col(f"_e{a}").alias("erosion_km2")) for a, b in pairs])
    return wide.agg(*aggs).select(F.inline(rows))


def mangrove_mask(year: int) -> Column:
    """Land-cover class 95 from 2020 on; before that tree cover above 30 % below 10 m."""
    if year >= 2020:
        return A.flag(F.col("worldcover") == 95)
    return A.mask_and(A.flag(F.col("treecover") > 30), A.flag(F.col("elevation") < 10))


def mangrove_areas(cells: DataFrame, years) -> DataFrame:
    wide = cells.agg(*[A.km2(mangrove_mask(y), F.col("area_m2")).alias(f"_{y}") for y in years])
    rows = F.array(*[F.struct(F.lit(y).alias("yr"), F.col(f"_{y}").alias("mangrove_km2")) for y in years])
    return wide.select(F.inline(rows))


def mangrove_health(vegetation: DataFrame, cells: DataFrame, years=None, scale: float = 1e-4) -> DataFrame:
    """Mean and deviation of the per-cell yearly mean NDVI inside the mask; no quality filter."""
    first, last = years or (None, None)
    per_cell = (temporal.calendar_years(vegetation, first, last).groupBy("cell_id", "yr")
                .agg(F.avg("ndvi_dn").alias("v")))
    masked = per_cell.join(cells.select("cell_id", mangrove_mask(2019).alias("_old"), mangrove_mask(2020).alias("_new")),
                           "cell_id")
    inside = masked.filter(F.when(F.col("yr") >= 2020, F.col("_new")).otherwise(F.col("_old")) == 1)
    return inside.groupBy("yr").agg((F.avg("v") * F.lit(scale)).alias("mean_ndvi"),
                                    (F.stddev_pop("v") * F.lit(scale)).alias("std_ndvi"))


def mangrove_loss(cells: DataFrame, year1: int, year2: int) -> DataFrame:
    loss = (F.col("lossyear") > 0) & F.col("lossyear").between(year1 - 2000, year2 - 2000)
    forest = (F.col("treecover") > 30) & (F.col("elevation") < 10)
    return cells.agg(A.km2_where(loss & forest, F.col("area_m2")).alias("mangrove_loss_km2"))


def new_land(wide: DataFrame, early: int, late: int) -> DataFrame:
    """Cells that were water early and are not water late (column new_land 0/1, unseen = 0)."""
    return wide.withColumn("new_land", A.unmask(A.mask_and(F.col(f"w_{early}"), A.mask_not(F.col(f"w_{late}")))))


def _accretion(wide: DataFrame, years, key: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("early"), F.lit(b).alias("late"),
                               A.unmask(A.mask_and(F.col(f"w_{a}"), A.mask_not(F.col(f"w_{b}")))).alias("_n"))
                      for a, b in zip(years, years[1:])])
    km2 = F.coalesce(A.km2(F.col("_n"), F.col("area_m2")), F.lit(0.0))
    return (wide.select(key, "area_m2", F.inline(pairs)).groupBy(key, "early", "late").agg(km2.alias("accretion_km2"))
            .withColumn("km2_per_year", F.col("accretion_km2") / (F.col("late") - F.col("early"))))


def accretion_series(wide: DataFrame, years, zone_cells: DataFrame, key: str = "zone") -> DataFrame:
    """New land km2 and km2 per year for every (zone, neighbouring pair)."""
    return _accretion(wide.join(zone_cells.select(key, "cell_id"), "cell_id"), years, key)


def zone_resolution(square_degrees):
    """Working cell size in metres by zone extent; a number or a column."""
    if isinstance(square_degrees, (int, float)):
        return 300 if square_degrees >= 2 else 100 if square_degrees >= 0.5 else 30
    return F.when(square_degrees >= 2, 300).when(square_degrees >= 0.5, 100).otherwise(30)


def accretion_report(obs: DataFrame, zone_cells: DataFrame, key: str, grid: Grid, square_degrees, years=DECADE_YEARS, cell_m: int = 30, **windows_of) -> DataFrame:
    """New land per (zone, neighbouring pair) in one job: windows widened per zone, each zone at the
    resolution of its extent; ``square_degrees`` is a column of the zones' cells."""
    factor = zone_cells.select(key, F.floor(zone_resolution(square_degrees) / F.lit(cell_m)).alias("_factor")).distinct()
    masks = grid.attach(rivers.region_masks(obs, zone_cells, key, years, last_day=(2, 28), **windows_of)).join(factor, key)
    wide = rivers.at_resolution(masks, years, [key], F.col("_factor"))
    return _accretion(wide, years, key)


def major_islands(land: DataFrame, min_area_m2: int = 500_000, neighbours: int = 4, grid: Grid | None = None, period: str | None = None) -> DataFrame:
    """Patches of new land of at least the given area with centroid, largest first.

    A grid adds the centroid's lon and lat, ``period`` a label column."""
    patches = topology.patch_table(topology.label_patches(land.filter(F.col("new_land") == 1), neighbours=neighbours), grid=grid)
    if period is not None:
        patches = patches.withColumn("period", F.lit(period))
    return patches.filter(F.col("area_m2") >= min_area_m2).orderBy(F.desc("area_m2"), "label")


def vulnerability(land: DataFrame, min_occurrence: int = 25) -> DataFrame:
    """New land that was often water; occurrence must be a column of ``land``."""
    is_new = F.col("new_land") == 1
    return land.agg(
        A.km2_where(is_new & (F.col("occurrence") >= min_occurrence), F.col("area_m2")).alias("vulnerable_km2"),
        F.coalesce(F.avg(F.when(is_new, F.col("occurrence"))), F.lit(0.0)).alias("mean_occurrence"))
