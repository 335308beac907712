"""Settlement masks, accessibility, underserved areas and market access."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.operators import focal, histogram, temporal, topology
from gridlake.plans import lights as L


def clamped_year(year: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(year, F.lit(high)), F.lit(low))


def annual_light(signals: DataFrame, years: DataFrame, low: int, high: int, value: str = "light_dn") -> DataFrame:
    """Median light of the product year nearest inside [low, high] for every requested year."""
    wanted = years.select("yr", clamped_year(F.col("yr"), low, high).alias("_y"))
    layers = (temporal.calendar_years(signals, low, high).withColumnRenamed("yr", "_y").groupBy("cell_id", "_y")
              .agg(F.percentile(value, F.lit(0.5)).alias("light")))
    return layers.join(F.broadcast(wanted), "_y").select("cell_id", "yr", "light")


def settlement_masks(smod: str = "smod") -> dict[str, Column]:
    s = F.col(smod)
    return {"urban": A.flag(s >= 22), "peri_urban": A.flag(s == 21), "rural_cluster": A.flag(s == 13),
            "low_density": A.mask_and(A.flag(s <= 12), A.flag(s >= 11))}


def settlement_areas(settlement: DataFrame, area: Column, keys=("epoch",)) -> DataFrame:
    return settlement.groupBy(*keys).agg(*[A.km2(m, area).alias(f"{n}_km2") for n, m in settlement_masks().items()])


def accessibility(raster: DataFrame, keys=(), cell_m: float = 1000.0) -> DataFrame:
    """0.4 light + 0.4 population + 0.2 nearness to urban cells; raster has light, population, smod."""
    marked = raster.withColumn("_u", A.flag(F.col("smod") >= 22))
    far = topology.distance_to_set(marked, "_u", keys, "_d", cap=int(100000 // cell_m) + 1)
    index = (A.norm(F.col("light"), 0, 50) * F.lit(0.4) + A.norm(F.col("population"), 0, 5000) * F.lit(0.4)
             + (F.lit(1.0) - A.norm(F.col("_d") * F.lit(cell_m), 0, 100000)) * F.lit(0.2))
    return far.withColumn("accessibility", A.clamp(index, 0.0, 1.0)).drop("_u", "_d")


def underserved(raster: DataFrame) -> DataFrame:
    need = A.norm(F.col("population"), 0, 5000) * (F.lit(1.0) - A.norm(F.col("light"), 0, 50))
    return raster.withColumn("underserved_index", A.clamp(need, 0.0, 1.0))


def underserved_population(index: DataFrame, p: float = 0.6, keys=("epoch",)) -> DataFrame:
    """Threshold (exact percentile per key), number of cells and population at or above it."""
    k = list(keys)
    bound = histogram.percentile_threshold(index, "underserved_index", p, k)
    hit = histogram.attach(index, bound, k).filter(F.col("underserved_index") >= F.col("threshold"))
    return hit.groupBy(*k, "threshold").agg(F.count(F.lit(1)).alias("cells"), F.sum("population").alias("population_at_risk"))


def gap_by_zone(index: DataFrame, zone_cells: DataFrame, keys=("division",)) -> DataFrame:
    own = [k for k in keys if k != "division"]
    zoned = index.select("cell_id", *own, "underserved_index").join(zone_cells.select("division", "cell_id"), "cell_id")
    return histogram.with_percentiles(zoned, "underserved_index", {"p75_gap": 0.75}, [F.avg("underserved_index").alias("mean_gap")], keys)


def market_access(raster: DataFrame, keys=(), radius_cells: int = 3, cell_m: float = 1000.0, bright: float = 5.0) -> DataFrame:
    """Gradient magnitude of smoothed light and nearness to bright cells."""
    # distances come from the raw cells, so that bounds and rows do not evaluate the smoothing
    far = topology.distance_to_set(raster.withColumn("_b", A.flag(F.col("light") > bright)), "_b", keys, "_d", cap=int(80000 // cell_m) + 1)
    near = far.withColumn("market_access", F.lit(1.0) - A.norm(F.col("_d") * F.lit(cell_m), 0, 80000)).drop("_b", "_d")
    return focal.gaussian_gradient(near, "light", radius_cells, keys, "light_gradient")


def connectivity(raster: DataFrame, year: Column, keys=(), cell_m: float = 100.0, built_min: float = 100.0,
                 last_a: int = L.LAST_YEAR_A) -> DataFrame:
    """Nearness to built-up cells times (light + 0.1); raster has built and light."""
    marked = raster.withColumn("_b", A.flag(F.col("built") > built_min))
    far = topology.distance_to_set(marked, "_b", keys, "_d", cap=int(50000 // cell_m) + 1)
    near = F.lit(1.0) - A.norm(F.col("_d") * F.lit(cell_m), 0, 50000)
    return far.withColumn("connectivity", A.clamp(
        near * (L.light_norm(F.col("light"), year, last_a) + F.lit(0.1)), 0.0, 1.0)).drop("_b", "_d")
