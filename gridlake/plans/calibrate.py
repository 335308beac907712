"""Calibration of a satellite index against a survey rate."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A


def head_count(rates: DataFrame, year: int = 2022) -> DataFrame:
    return rates.filter(F.col("year") == year).select("division", "hcr_upl")


def calibration_rows(index: DataFrame, rates: DataFrame, income: DataFrame, facilities: DataFrame, names: DataFrame) -> DataFrame:
    """index(name, sat_mean, sat_median) renamed by names(name, division), inner on the rate, left on
    income and facilities (missing = 0). All sides hold one row per division."""
    return (index.join(names, "name").drop("name").join(rates, "division").join(income, "division", "left").join(facilities, "division", "left")
            .select("division", "sat_mean", "sat_median", F.col("hcr_upl").alias("hcr"),
                    F.coalesce("income", F.lit(0.0)).alias("income"), F.coalesce("internet_pct", F.lit(0.0)).alias("internet")))


def pearson(x: str, y: str) -> Column:
    """0 for fewer than two rows or a constant column."""
    usable = (F.count(F.lit(1)) >= 2) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(usable, A.correlation(x, y)).otherwise(F.lit(0.0))


def ols(x: str, y: str) -> tuple[Column, Column]:
    """Slope and intercept of y on x; (0, mean y) for a constant x."""
    usable = F.var_pop(x) > 0
    return (F.when(usable, F.regr_slope(y, x)).otherwise(F.lit(0.0)),
            F.when(usable, F.regr_intercept(y, x)).otherwise(F.avg(y)))


def correlations(rows: DataFrame) -> DataFrame:
    return rows.agg(*[pearson(k, "hcr").alias(f"r_{k}") for k in ("sat_mean", "income", "internet")])


def fit(rows: DataFrame) -> DataFrame:
    slope, intercept = ols("sat_mean", "hcr")
    return rows.agg(F.count(F.lit(1)).alias("n"), slope.alias("slope"), intercept.alias("intercept"))


def calibrated(rows: DataFrame, minimum: int = 3) -> DataFrame:
    """Calibrated rate and error per division; no rows below the minimum number of divisions."""
    f = fit(rows)
    out = rows.withColumns({"_n": f.select("n").scalar(), "_a": f.select("slope").scalar(), "_b": f.select("intercept").scalar()})
    out = out.filter(F.col("_n") >= minimum).withColumn("calibrated", F.col("_a") * F.col("sat_mean") + F.col("_b"))
    return out.withColumn("error", F.col("calibrated") - F.col("hcr")).drop("_n", "_a", "_b")


def summary(scores: DataFrame, narrow: float = 0.02) -> DataFrame:
    """Mean absolute error, spreads and a warning flag for an index that barely varies."""
    spread = F.max("sat_mean") - F.min("sat_mean")
    return scores.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("error")).alias("mae"), spread.alias("index_spread"),
                      (F.max("hcr") - F.min("hcr")).alias("rate_spread"), (spread < narrow).cast("int").alias("narrow_index"))
