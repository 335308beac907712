"""Yearly alerts. Every detector returns one row per year:
yr, alert, triggered, severity, area_km2 (and its measures)."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.operators import temporal

REPORT = ("yr", "alert", "triggered", "severity", "area_km2", "description")


def severity(*rules) -> Column:
    """First matching (condition, level) wins, else none."""
    out = None
    for condition, level in rules:
        out = F.when(condition, F.lit(level)) if out is None else out.when(condition, F.lit(level))
    return out.otherwise(F.lit("none"))


def _trailing(lookback: int) -> Window:
    """The previous years of a series that holds one row per year."""
    return Window.partitionBy(F.lit(0)).orderBy("yr").rangeBetween(-lookback, -1)


def with_baseline(series: DataFrame, value: str, lookback: int, first: int) -> DataFrame:
    w = _trailing(lookback)
    v = F.when(F.col("yr") >= first, F.col(value))
    return series.withColumns({"baseline_mean": F.avg(v).over(w), "baseline_std": F.stddev_pop(v).over(w),
                               "baseline_years": F.count(v).over(w)})


def _z(value: str) -> Column:
    return F.when(F.col("baseline_std") > 0, (F.col(value) - F.col("baseline_mean")) / F.col("baseline_std")).otherwise(F.lit(0.0))


def forest_loss(cells: DataFrame, years, threshold: int = 30) -> DataFrame:
    """Loss of a year on wooded cells; years without a loss code are never triggered."""
    codes = [y for y in years if 1 <= y - 2000 <= 23]
    wide = cells.agg(*[A.km2_where((F.col("lossyear") == y - 2000) & (F.col("treecover") >= threshold), F.col("area_m2")).alias(f"_{y}")
                       for y in codes])
    rows = F.array(*[F.struct(F.lit(y).alias("yr"), (F.col(f"_{y}") if y in codes else F.lit(0.0)).alias("area_km2")) for y in years])
    a = F.col("area_km2")
    return wide.select(F.inline(rows)).select(
        "yr", F.lit("forest_loss").alias("alert"), A.flag(a > 1.0).alias("triggered"),
        severity((a > 50, "critical"), (a > 10, "high"), (a > 1, "medium")).alias("severity"), "area_km2")


def flood_anomaly(water: DataFrame, area: Column, lookback: int = 10, first: int = 2000, minimum: int = 3,
                  months=(7, 9), value: str = "water_month") -> DataFrame:
    """Monsoon water area against the previous years' mean and population deviation."""
    cell = (water.filter(F.month("t").between(*months)).groupBy("cell_id", F.year("t").alias("yr"))
            .agg(F.max(A.flag(F.col(value) == 2)).alias("_w")))
    base = with_baseline(cell.groupBy("yr").agg(A.km2(F.col("_w"), area).alias("area_km2")), "area_km2", lookback, first)
    enough, a = F.col("baseline_years") >= minimum, F.col("area_km2")
    over = a > F.col("baseline_mean") + F.lit(1.5) * F.col("baseline_std")
    base = base.withColumn("z", F.when(enough, _z("area_km2")))
    z = F.col("z")
    return base.select("yr", F.lit("flood_anomaly").alias("alert"), F.when(enough, A.flag(over)).otherwise(0).alias("triggered"),
                       severity((~enough, "insufficient_data"), (z > 3, "critical"), (z > 2, "high"), (over, "medium")).alias("severity"),
                       "area_km2", "baseline_mean", "z")


def construction_surge(classes: DataFrame, area: Column, first: int = 2016, built_class: int = 6) -> DataFrame:
    """Growth of the area where any image of the year is built-up; 0 after an empty year."""
    cell = (temporal.calendar_years(classes).groupBy("cell_id", "yr").agg(F.max(A.flag(F.col("label") == built_class)).alias("_b")))
    yearly = cell.groupBy("yr").agg(A.km2(F.col("_b"), area).alias("area_km2"))
    w = Window.partitionBy(F.lit(0)).orderBy("yr").rangeBetween(-1, -1)
    yearly = yearly.withColumn("_p", F.coalesce(F.max("area_km2").over(w), F.lit(0.0)))
    growth = F.when((F.col("yr") < first) | (F.col("_p") == 0), F.lit(0.0)).otherwise(
        (F.col("area_km2") - F.col("_p")) / F.nullif(F.col("_p"), F.lit(0.0)) * F.lit(100.0))
    yearly = yearly.withColumn("growth_pct", growth)
    g = F.col("growth_pct")
    return yearly.select("yr", F.lit("construction_surge").alias("alert"), A.flag(g > 20).alias("triggered"),
                         severity((g > 50, "critical"), (g > 30, "high"), (g > 20, "medium")).alias("severity"),
                         F.when(F.col("yr") < first, F.lit(0.0)).otherwise(F.col("area_km2")).alias("area_km2"), "growth_pct")


def _cell_means(df: DataFrame, value: str, scale: float) -> DataFrame:
    return temporal.calendar_years(df).groupBy("cell_id", "yr").agg((F.avg(value) * F.lit(scale)).alias("v"))


def ndvi_anomaly(vegetation: DataFrame, area: Column, lookback: int = 10, first: int = 2000, minimum: int = 3) -> DataFrame:
    """Yearly mean NDVI against previous years; the area counts cells below mean - 2 deviations."""
    cells = _cell_means(vegetation, "ndvi_dn", 1e-4)
    base = with_baseline(cells.groupBy("yr").agg(F.avg("v").alias("ndvi")), "ndvi", lookback, first)
    base = base.withColumn("limit", F.col("baseline_mean") - F.lit(2.0) * F.col("baseline_std"))
    low = cells.join(F.broadcast(base.select("yr", "limit")), "yr").groupBy("yr").agg(
        A.km2_where(F.col("v") < F.col("limit"), area).alias("_k"))
    base = base.join(low, "yr").withColumn("_ok", F.col("baseline_years") >= minimum)
    base = base.withColumn("z", F.when(F.col("_ok"), _z("ndvi")))
    z, ok = F.col("z"), F.col("_ok")
    return base.select("yr", F.lit("ndvi_anomaly").alias("alert"), F.when(ok, A.flag(z < -2)).otherwise(0).alias("triggered"),
                       severity((~ok, "insufficient_data"), (z < -3.5, "critical"), (z < -2.5, "high"), (z < -2, "medium")).alias("severity"),
                       F.when(ok, F.col("_k")).otherwise(F.lit(0.0)).alias("area_km2"), "ndvi", "baseline_mean", "z")


def no2_spike(df: DataFrame, area: Column, lookback: int = 3, first: int = 2019, minimum: int = 2, value: str = "no2_dn",
              scale: float = 1.0) -> DataFrame:
    """Yearly mean NO2 against previous years; the area counts cells above 1.15 times their mean.
    No quality filter."""
    cells = _cell_means(df, value, scale)
    base = with_baseline(cells.groupBy("yr").agg(F.avg("v").alias("no2")), "no2", lookback, first)
    base = base.withColumn("limit", F.col("baseline_mean") * F.lit(1.15))
    high = cells.join(F.broadcast(base.select("yr", "limit")), "yr").groupBy("yr").agg(
        A.km2_where(F.col("v") > F.col("limit"), area).alias("_k"))
    base = base.join(high, "yr").withColumn("_ok", (F.col("baseline_years") >= minimum) & (F.col("yr") >= first))
    pct = F.when(F.col("baseline_mean") > 0, (F.col("no2") - F.col("baseline_mean")) / F.col("baseline_mean") * F.lit(100.0)).otherwise(F.lit(0.0))
    base = base.withColumn("change_pct", F.when(F.col("_ok"), pct))
    p, ok = F.col("change_pct"), F.col("_ok")
    return base.select("yr", F.lit("air_quality_spike").alias("alert"), F.when(ok, A.flag(p > 15)).otherwise(0).alias("triggered"),
                       severity((F.col("yr") < first, "none"), (~ok, "insufficient_data"), (p > 40, "critical"), (p > 25, "high"), (p > 15, "medium")).alias("severity"),
                       F.when(ok, F.col("_k")).otherwise(F.lit(0.0)).alias("area_km2"), "no2", "baseline_mean", "change_pct")


def report(*alerts: DataFrame) -> DataFrame:
    """All alerts as one table."""
    text = F.concat(F.regexp_replace("alert", "_", " "), F.lit(" "), F.col("yr").cast("string"), F.lit(": "), F.col("severity"))
    parts = [a.withColumn("description", text).select(*REPORT) for a in alerts]
    return reduce(DataFrame.unionByName, parts)
