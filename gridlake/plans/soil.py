"""Soil properties, slope, erosion, salinity and suitability."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.operators import focal

PROPERTIES = ("clay", "sand", "soc", "ph")


def properties(long: DataFrame, depth: str = "b0") -> DataFrame:
    """soil(cell_id, depth, property, value) to one row per cell; pH is stored times ten."""
    wide = (long.filter(F.col("depth") == depth).groupBy("cell_id").pivot("property", list(PROPERTIES)).agg(F.first("value")))
    return wide.withColumn("ph", F.col("ph") / F.lit(10.0))


def property_stats(wide: DataFrame, keys=()) -> DataFrame:
    return wide.groupBy(*keys).agg(*[f(p).alias(f"{p}_{n}") for p in PROPERTIES for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def slope(cells: DataFrame, cell_m: float = 30.0) -> DataFrame:
    return focal.slope_degrees(cells, "elevation", cell_m)


def _or(column: str | None, default: float) -> Column:
    return F.lit(default) if column is None else F.col(column)


def erosion_risk(df: DataFrame, rain: str | None = "rain_mm", soil: bool = True, slope_col: str | None = "slope",
                 ndvi: str | None = "ndvi") -> DataFrame:
    """Weighted susceptibility; an input passed as None uses its fallback constant, a NULL
    cell stays NULL."""
    rf = F.lit(0.5) if rain is None else A.norm(F.col(rain), 500, 4000)
    kf = (A.norm(F.col("clay"), 0, 80) + (F.lit(1.0) - A.norm(F.col("soc"), 0, 30))) / F.lit(2.0) if soil else F.lit(0.5)
    ls = F.lit(0.05) if slope_col is None else A.norm(F.col(slope_col), 0, 30)
    cf = F.lit(0.5) if ndvi is None else F.lit(1.0) - A.clamp(F.col(ndvi), 0.0, 0.8) / F.lit(0.8)
    return df.withColumn("erosion_risk", rf * F.lit(0.3) + kf * F.lit(0.2) + ls * F.lit(0.25) + cf * F.lit(0.25))


def salinity_proxy(scale: float = 1e-4) -> Column:
    return (F.sqrt((F.col("blue") * F.lit(scale)) * (F.col("red") * F.lit(scale)))
            * (F.lit(1.0) - A.clamp(I.ndvi(), 0.0, 1.0)))


def salinity_risk(proxy: str = "salinity_proxy", elevation: str = "elevation") -> Column:
    e = F.col(elevation)
    return A.norm(F.col(proxy), 0, 0.3) * A.unmask(A.mask_and(A.flag(e < 5), A.flag(e >= 0)))


def ph_score(ph: Column) -> Column:
    """1 between 5.5 and 7.5, falling to 0 at 3.5 and 9.5."""
    beyond = A.max2(F.abs(ph - F.lit(6.5)) - F.lit(1.0), F.lit(0.0))
    return A.clamp(F.lit(1.0) - beyond / F.lit(2.0), 0.0, 1.0)


def suitability(df: DataFrame, soil: bool = True, slope_col: str | None = "slope", rain: str | None = "rain_mm") -> DataFrame:
    ground = (A.norm(F.col("soc"), 0, 20) + ph_score(F.col("ph"))) / F.lit(2.0) if soil else F.lit(0.5)
    flat = F.lit(0.7) if slope_col is None else F.lit(1.0) - A.norm(F.col(slope_col), 0, 15)
    wet = F.lit(0.7) if rain is None else A.min2(A.norm(F.col(rain), 800, 1500), A.norm(F.col(rain), 3000, 2000))
    return df.withColumn("suitability", ground * F.lit(0.4) + flat * F.lit(0.3) + wet * F.lit(0.3))
