"""Coastal pond detection, conversion and accuracy."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import LOW_WATER, Grid
from gridlake.operators import temporal, topology

POND_BANDS = ("green", "nir", "swir1")


def coastal_low(elevation="elevation", limit: int = 10):
    return A.mask_and(A.flag(F.col(elevation) >= 0), A.flag(F.col(elevation) <= limit))


def dry_composites(obs: DataFrame, years, switch_year: int = 2016, scene_cloud: int = 20) -> DataFrame:
    """Dry composite per (cell, season year): before the switch year bit-masked scenes, from it
    on scenes below a cloud share without the bit mask."""
    tagged = temporal.assign_season(obs, LOW_WATER, years)
    keep = F.when(F.col("yr") >= switch_year, F.col("scene_cloud_pct") < scene_cloud).otherwise(
        A.bits_clear(F.col("qa"), 24))
    return temporal.composite(tagged.filter(keep), ["cell_id", "yr"], bands=POND_BANDS)


def candidates(composites: DataFrame, cells: DataFrame, ndwi_min: float = 0.1, turbidity_min: float = 0.05,
               occurrence=(50, 95), limit: int = 10, scale: float = 1e-4) -> DataFrame:
    """Static filters first: the small set of low, often wet cells prunes the composites."""
    sites = cells.filter((coastal_low(limit=limit) == 1) & F.col("occurrence").between(*occurrence))
    hit = (I.ndwi() > ndwi_min) & (I.mndwi() > ndwi_min) & (I.turbidity(scale=scale) > turbidity_min)
    return composites.join(sites.select("cell_id"), "cell_id").filter(hit).select("cell_id", "yr")


def detect(obs: DataFrame, cells: DataFrame, grid: Grid, years, min_cells: int = 5, max_cells: int = 5000,
           neighbours: int = 8, **rules) -> DataFrame:
    """Pond cells per year after the patch-size filter."""
    found = grid.attach(candidates(dry_composites(obs, years), cells, **rules))
    return topology.keep_by_size(topology.label_patches(found, ["yr"], neighbours), min_cells, max_cells, ["yr"])


def area_series(ponds: DataFrame, first: int, last: int, step: int = 3) -> DataFrame:
    """km2 per listed year; a year without ponds gives 0."""
    wanted = list(range(first, last + 1, step))
    wide = ponds.agg(*[A.km2_where(F.col("yr") == y, F.col("area_m2")).alias(f"_{y}") for y in wanted])
    rows = F.array(*[F.struct(F.lit(y).alias("yr"), F.coalesce(F.col(f"_{y}"), F.lit(0.0)).alias("pond_km2"))
                     for y in wanted])
    return wide.select(F.inline(rows))


def mangrove_conversion(ponds: DataFrame, cells: DataFrame, years_since_2000: int, limit: int = 10) -> DataFrame:
    """Pond cells on land that was wooded at some time and lies low, km2 per year."""
    wooded = (F.col("treecover") > 30) | ((F.col("lossyear") > 0) & (F.col("lossyear") <= years_since_2000))
    was = cells.filter(wooded & (coastal_low(limit=limit) == 1)).select("cell_id")
    return (ponds.join(was, "cell_id", "left_semi").groupBy("yr")
            .agg((F.sum("area_m2") / F.lit(1e6)).alias("conversion_km2")))


def area_by_zone(ponds: DataFrame, zone_cells: DataFrame, zones: DataFrame, key: str = "zone", years=()) -> DataFrame:
    """km2 per zone, or per zone and listed year; zones without ponds give 0."""
    keys = [key, "yr"] if years else [key]
    area = (ponds.join(zone_cells.select(key, "cell_id"), "cell_id").groupBy(*keys)
            .agg((F.sum("area_m2") / F.lit(1e6)).alias("_k")))
    wanted = zones.select(key, F.explode(F.array(*[F.lit(y) for y in years])).alias("yr")) if years else zones.select(key)
    return wanted.join(area, keys, "left").select(*keys, F.coalesce("_k", F.lit(0.0)).alias("pond_km2"))


def accuracy(measured: DataFrame, reference: DataFrame, key: str, value: str, truth: str, keys=()) -> DataFrame:
    """R2, RMSE and MAE over names present in both, per ``keys`` of the measured side such as a year; all NULL without a match."""
    both = measured.select(key, *keys, value).join(reference.select(key, truth), key)
    e = F.col(value) - F.col(truth)
    total = F.var_pop(truth) * F.count(truth)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                    F.when(total > 0, F.lit(1.0) - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r_squared"),
                    F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def errors(measured: DataFrame, reference: DataFrame, key: str, value: str, truth: str, keep=()) -> DataFrame:
    """One row per name present in both, with its error; ``keep`` are further keys of the measured side, such as years."""
    return (measured.select(key, *keep, F.col(value).alias("satellite"))
            .join(reference.select(key, F.col(truth).alias("reference")), key)
            .withColumn("error", F.col("satellite") - F.col("reference")))
