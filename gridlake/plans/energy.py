"""Solar, wind, biomass and energy access."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import SOLAR_SEASONS
from gridlake.operators import temporal
from gridlake.plans import lights as L

SECONDS_PER_MONTH = 2.628e6
UNAVAILABLE = (80, 50, 40)   # water, built-up, cropland


def solar_irradiance(df: DataFrame, joules: float = 1e6, value: str = "solar_mj") -> DataFrame:
    """Mean W/m2 per (cell, year) from monthly energy sums."""
    return temporal.calendar_years(df).groupBy("cell_id", "yr").agg(
        (F.avg(value) * F.lit(joules) / F.lit(SECONDS_PER_MONTH)).alias("irradiance"))


def solar_stats(irradiance: DataFrame, keys=("yr",)) -> DataFrame:
    return irradiance.groupBy(*keys).agg(F.avg("irradiance").alias("mean_wm2"), F.max("irradiance").alias("max_wm2"))


def solar_potential(df: DataFrame, cells: DataFrame, joules: float = 1e6, value: str = "solar_mj") -> DataFrame:
    """Scaled irradiance x seasonal consistency x available land."""
    tagged = temporal.assign_season(df, SOLAR_SEASONS)
    seasons = tagged.groupBy("cell_id", "yr").agg(*[
        (F.avg(F.when(F.col("season") == s.name, F.col(value))) * F.lit(joules)).alias(s.name) for s in SOLAR_SEASONS])
    consistency = A.clamp(F.col("monsoon") / A.max2(F.col("dry"), F.lit(1.0)), 0.0, 1.0)
    free = A.unmask(A.flag(~F.col("worldcover").isin(list(UNAVAILABLE))))
    both = solar_irradiance(df, joules, value).join(seasons, ["cell_id", "yr"]).join(cells.select("cell_id", "worldcover"), "cell_id")
    return both.select("cell_id", "yr", (A.norm(F.col("irradiance"), 0, 250) * consistency * free).alias("solar_potential"))


def wind(df: DataFrame) -> DataFrame:
    """Mean speed per (cell, year) and its cubed score. Whole calendar years."""
    u, v = F.col("wind_u"), F.col("wind_v")
    speed = df.groupBy("cell_id", F.year("t").alias("yr")).agg(F.avg(F.sqrt(u * u + v * v)).alias("wind_speed"))
    return speed.withColumn("wind_potential", A.norm(F.pow("wind_speed", F.lit(3.0)), 0, 500))


def biomass(ndvi: DataFrame) -> DataFrame:
    return ndvi.withColumn("biomass", F.col("ndvi") * F.col("ndvi") * F.lit(100.0))


def biomass_stats(df: DataFrame, keys=("yr",)) -> DataFrame:
    return biomass(df).groupBy(*keys).agg(F.avg("biomass").alias("mean_biomass"), F.sum("biomass").alias("total_biomass"))


def access(lights: DataFrame, last_a: int = L.LAST_YEAR_A) -> DataFrame:
    """Electrified flag times scaled light."""
    lit = L.electrified(lights, last_a=last_a)
    return lit.withColumn("energy_access", F.col("electrified") * L.light_norm(F.col("light"), F.col("yr"), last_a))


def energy_poor(access_population: DataFrame, keys=("yr",)) -> DataFrame:
    return access_population.groupBy(*keys).agg(
        F.sum(F.col("population") * (F.lit(1.0) - F.col("energy_access"))).alias("energy_poor_population"))
