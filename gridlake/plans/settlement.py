"""Built-up area, settlement classes and construction."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import BUILT_EPOCHS, SMOD_CLASSES
from gridlake.operators import focal, histogram, temporal, zonal


def layer_at(settlement: DataFrame, years: DataFrame, epochs=BUILT_EPOCHS) -> DataFrame:
    """Layers of the epoch nearest to each year: years(yr), a bounded table, joins on the epoch."""
    snapped = years.select("yr", temporal.snap_year(F.col("yr"), epochs).alias("epoch"))
    return settlement.join(F.broadcast(snapped), "epoch")


def at_year(frame: DataFrame, settlement: DataFrame, columns, epochs=BUILT_EPOCHS) -> DataFrame:
    """Attach settlement columns to (cell_id, yr) rows at the epoch nearest to the year."""
    keyed = frame.withColumn("epoch", temporal.snap_year(F.col("yr"), epochs))
    return keyed.join(settlement.select("cell_id", "epoch", *columns), ["cell_id", "epoch"]).drop("epoch")


def builtup_series(settlement: DataFrame, keys=("epoch",), last: int = 2020) -> DataFrame:
    return settlement.filter(F.col("epoch") <= last).groupBy(*keys).agg((F.sum("built") / F.lit(1e6)).alias("built_km2"))


def urbanisation_rate(settlement: DataFrame, pairs, epochs=BUILT_EPOCHS) -> DataFrame:
    """Change and yearly rate of built-up km2 per (year1, year2) pair in one pass;
    same_epoch = 1 warns that both years use one layer."""
    def total(year):
        return F.sum(F.when(F.col("epoch") == temporal.snap_int(year, epochs), F.col("built")))
    wide = settlement.agg(*[((total(b) - total(a)) / F.lit(1e6)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(
        F.lit(a).alias("year1"), F.lit(b).alias("year2"), F.col(f"_{i}").alias("change_km2"),
        (F.col(f"_{i}") / F.lit(b - a)).alias("km2_per_year"),
        F.lit(int(temporal.snap_int(a, epochs) == temporal.snap_int(b, epochs))).alias("same_epoch"))
        for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def expansion(settlement: DataFrame, year1: int, year2: int, epochs=BUILT_EPOCHS, minimum: int = 10) -> DataFrame:
    """new / lost built-up flags per cell between two years."""
    e1, e2 = (temporal.snap_int(y, epochs) for y in (year1, year2))
    wide = settlement.filter(F.col("epoch").isin(e1, e2)).groupBy("cell_id").agg(
        *[A.flag(F.max(F.when(F.col("epoch") == e, F.col("built"))) > minimum).alias(n) for n, e in (("u1", e1), ("u2", e2))])
    u1, u2 = F.col("u1"), F.col("u2")
    return wide.select("cell_id", A.mask_and(u2, A.mask_not(u1)).alias("new_urban"), A.mask_and(u1, A.mask_not(u2)).alias("lost_urban"))


def class_areas(settlement: DataFrame, area: Column, keys=("epoch",)) -> DataFrame:
    return zonal.area_by_class(settlement, "smod", area, SMOD_CLASSES, keys)


def growth_by_zone(settlement: DataFrame, zone_cells: DataFrame, key: str, last: int = 2020) -> DataFrame:
    return builtup_series(settlement.join(zone_cells.select(key, "cell_id"), "cell_id"), (key, "epoch"), last)


def construction(modes: DataFrame, built_class: int = 6) -> DataFrame:
    """new / demolished flags per cell and consecutive year pair; modes(cell_id, yr, label).
    The window holds one row per year of a cell."""
    w = Window.partitionBy("cell_id").orderBy("yr")
    prev, prev_year = F.lag("label").over(w), F.lag("yr").over(w)
    pairs = modes.withColumns({"_p": prev, "_y": prev_year}).filter(F.col("_y") == F.col("yr") - 1)
    was, now = A.flag(F.col("_p") == built_class), A.flag(F.col("label") == built_class)
    return pairs.select("cell_id", F.col("_y").alias("year1"), F.col("yr").alias("year2"),
                        A.mask_and(A.mask_not(was), now).alias("new_construction"),
                        A.mask_and(was, A.mask_not(now)).alias("demolished"))


def construction_between(modes: DataFrame, year1: int, year2: int, built_class: int = 6) -> DataFrame:
    """new / demolished between two years that need not be neighbours."""
    wide = modes.filter(F.col("yr").isin(year1, year2)).groupBy("cell_id").agg(
        *[F.max(F.when(F.col("yr") == y, F.col("label"))).alias(n) for n, y in (("c1", year1), ("c2", year2))])
    was, now = A.flag(F.col("c1") == built_class), A.flag(F.col("c2") == built_class)
    return wide.select("cell_id", A.mask_and(A.mask_not(was), now).alias("new_construction"),
                       A.mask_and(was, A.mask_not(now)).alias("demolished"))


def construction_areas(flags: DataFrame, area: Column, keys=("year1", "year2")) -> DataFrame:
    return flags.groupBy(*keys).agg(A.km2(F.col("new_construction"), area).alias("new_construction_km2"),
                                    A.km2(F.col("demolished"), area).alias("demolished_km2"))


def spectral_construction(composites: DataFrame, year1: int, year2: int, rise: float = 0.1) -> DataFrame:
    """NDBI up and NDVI down by more than ``rise`` between two yearly composites."""
    indexed = composites.select("cell_id", "yr", I.ndbi().alias("b"), I.ndvi().alias("v"))
    wide = indexed.filter(F.col("yr").isin(year1, year2)).groupBy("cell_id").agg(
        *[F.max(F.when(F.col("yr") == y, F.col(c))).alias(f"{c}{n}") for n, y in ((1, year1), (2, year2)) for c in ("b", "v")])
    return wide.select("cell_id", A.mask_and(A.flag(F.col("b2") - F.col("b1") > rise),
                                             A.flag(F.col("v1") - F.col("v2") > rise)).alias("construction"))


def buildup_density(settlement: DataFrame, radius_cells: int, keys=("epoch",), tile: int | None = None) -> DataFrame:
    """Built-up surface within a disc around every cell, in km2."""
    k = focal.disc_kernel(settlement.select(*keys, "cell_id", "x", "y", "built"), "built", radius_cells, keys, tile=tile)
    return k.select(*keys, "cell_id", (F.col("disc_sum") / F.lit(1e6)).alias("density_km2"))


def hotspots(construction_cells: DataFrame, radius_cells: int, p: float = 0.75) -> DataFrame:
    """Construction count within a disc and 1 where it reaches the percentile of its non-zero values."""
    k = focal.disc_kernel(construction_cells.select("cell_id", "x", "y", "new_construction"), "new_construction", radius_cells)
    k = k.select("cell_id", F.col("disc_sum").alias("density"))
    bound = histogram.percentile_threshold(k.filter(F.col("density") > 0), "density", p)
    return k.withColumn("threshold", bound.scalar()).withColumn("hotspot", A.flag(F.col("density") >= F.col("threshold")))
