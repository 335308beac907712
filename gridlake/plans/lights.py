"""Night lights: sensors, yearly layers, change, electrification."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.operators import temporal

# Last year of sensor A; lit thresholds; value ranges
LAST_YEAR_A = 2013
LIT_A, LIT_B = 3.0, 0.5
RANGE_A, RANGE_B = (0, 63), (0, 200)


def sensor(year: Column, last_a: int = LAST_YEAR_A) -> Column:
    return F.when(year <= last_a, F.lit("A")).otherwise(F.lit("B"))


def lit_threshold(year: Column, last_a: int = LAST_YEAR_A) -> Column:
    return F.when(year <= last_a, F.lit(LIT_A)).otherwise(F.lit(LIT_B))


def light_norm(light: Column, year: Column, last_a: int = LAST_YEAR_A) -> Column:
    """Light scaled to 0..1 by the range of the year's sensor."""
    return F.when(year <= last_a, A.norm(light, *RANGE_A)).otherwise(A.norm(light, *RANGE_B))


def sensor_rules(years: DataFrame, last_a: int = LAST_YEAR_A) -> DataFrame:
    y = F.col("yr")
    high = F.when(y <= last_a, F.lit(RANGE_A[1])).otherwise(F.lit(RANGE_B[1]))
    return years.select("yr", sensor(y, last_a).alias("sensor"), lit_threshold(y, last_a).alias("lit_min"), high.alias("range_max"))


def annual(signals: DataFrame, value: str = "light_dn", last_a: int = LAST_YEAR_A, first=None, last=None) -> DataFrame:
    """Per (cell, year): median for sensor A years, mean for sensor B years."""
    both = temporal.calendar_years(signals, first, last).groupBy("cell_id", "yr").agg(
        F.percentile(value, F.lit(0.5)).alias("_m"), F.avg(value).alias("_a"))
    return both.select("cell_id", "yr", F.when(F.col("yr") <= last_a, F.col("_m")).otherwise(F.col("_a")).alias("light"))


def stats(lights: DataFrame, keys=("yr",), last_a: int = LAST_YEAR_A) -> DataFrame:
    return (lights.groupBy(*keys).agg(F.avg("light").alias("mean_light"), F.max("light").alias("max_light"),
                                      F.sum("light").alias("sum_light")).withColumn("sensor", sensor(F.col("yr"), last_a)))


def change(lights: DataFrame, year1: int, year2: int, last_a: int = LAST_YEAR_A) -> DataFrame:
    """Difference and relative change per cell; years of different sensors are refused."""
    if (year1 <= last_a) != (year2 <= last_a):
        raise ValueError(f"{year1} and {year2} come from different light sensors")
    wide = lights.filter(F.col("yr").isin(year1, year2)).groupBy("cell_id").agg(
        F.max(F.when(F.col("yr") == year1, F.col("light"))).alias("_1"),
        F.max(F.when(F.col("yr") == year2, F.col("light"))).alias("_2"))
    diff = F.col("_2") - F.col("_1")
    return wide.select("cell_id", diff.alias("diff"), (diff / A.max2(F.col("_1"), F.lit(0.01))).alias("relative"))


def electrified(lights: DataFrame, threshold: float | None = None, last_a: int = LAST_YEAR_A) -> DataFrame:
    bound = lit_threshold(F.col("yr"), last_a) if threshold is None else F.lit(threshold)
    return lights.withColumn("electrified", A.flag(F.col("light") > bound))


def lit_area(lights: DataFrame, area: Column, last_a: int = LAST_YEAR_A) -> DataFrame:
    return electrified(lights, last_a=last_a).groupBy("yr").agg(A.km2(F.col("electrified"), area).alias("lit_km2"))


def per_capita(lights_population: DataFrame) -> DataFrame:
    return lights_population.withColumn("light_per_capita",
                                        F.col("light") / A.max2(F.col("population").cast("double"), F.lit(1.0)))


def by_zone(lights: DataFrame, zone_cells: DataFrame, key: str, last_a: int = LAST_YEAR_A) -> DataFrame:
    return stats(lights.join(zone_cells.select(key, "cell_id"), "cell_id"), (key, "yr"), last_a)
