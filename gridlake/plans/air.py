"""Pollutant composites, statistics and hotspots."""
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import AIR_SEASONS, POLLUTANT_QA, POLLUTANT_START
from gridlake.operators import histogram, temporal
from gridlake.session import stored

COLUMNS = {"no2": "no2_dn", "so2": "so2_dn", "co": "co_dn", "aerosol": "aai_dn", "hcho": "hcho_dn"}


def valid(pollutant: str, qa: Column, value: Column) -> Column:
    """Quality rule per pollutant; the aerosol index needs quality above its bound and a positive value."""
    bound = F.lit(POLLUTANT_QA[pollutant])
    if pollutant == "aerosol":
        return F.when((qa > bound) & (value > 0), value)
    return F.when(qa >= bound, value)


def clamped_start(start: str, first: str | None = POLLUTANT_START) -> str:
    """Data before the first reliable month is not used; None for a series without such a month."""
    return start if first is None else max(start, first)


def composites(df: DataFrame, qa: Column, keys=("cell_id", "yr"), pollutants=tuple(COLUMNS), scales=None) -> DataFrame:
    """Mean of the valid observations, all pollutants in one pass as columns."""
    scales = scales or {}
    return df.groupBy(*keys).agg(*[
        (F.avg(valid(p, qa, F.col(COLUMNS[p]))) * F.lit(float(scales.get(p, 1.0)))).alias(p) for p in pollutants])


def yearly(df: DataFrame, qa: Column, pollutants=tuple(COLUMNS), first: int | None = None, reliable: str | None = POLLUTANT_START) -> DataFrame:
    """Yearly means; rows before the first reliable day are left out at the scan."""
    if reliable is not None:
        df = df.filter(F.col("t") >= F.lit(date.fromisoformat(reliable)))
    return composites(temporal.calendar_years(df, first), qa, ("cell_id", "yr"), pollutants)


def stats(cells: DataFrame, pollutant: str, keys=("yr",)) -> DataFrame:
    return histogram.with_percentiles(cells, pollutant, {"median": 0.5}, [F.avg(pollutant).alias("mean"), F.max(pollutant).alias("max")], keys)


def stats_of(cells: DataFrame, pollutants, keys=("yr",)) -> dict[str, DataFrame]:
    """The statistics of several pollutants in one pass over the cells; only the result, a row per pollutant and key, is read again."""
    k = list(keys)
    each = F.array(*[F.struct(F.lit(p).alias("pollutant"), F.col(p).alias("value")) for p in pollutants])
    found = stored(stats(cells.select(*k, F.inline(each)), "value", ["pollutant", *k]), "air-stats")
    return {p: found.filter(F.col("pollutant") == p).drop("pollutant") for p in pollutants}


def seasonal(df: DataFrame, qa: Column, pollutant: str, years=None) -> DataFrame:
    """Zone mean per season, one column each."""
    return _seasons(df, qa, [pollutant], years).select("yr", *[F.col(f"{pollutant}_{s.name}").alias(s.name) for s in AIR_SEASONS])


def seasonal_of(df: DataFrame, qa: Column, pollutants, years=None) -> dict[str, DataFrame]:
    """The same of several pollutants in one pass over the observations."""
    found = stored(_seasons(df, qa, pollutants, years), "air-seasons")
    return {p: found.select("yr", *[F.col(f"{p}_{s.name}").alias(s.name) for s in AIR_SEASONS]) for p in pollutants}


def _seasons(df: DataFrame, qa: Column, pollutants, years=None) -> DataFrame:
    tagged = temporal.assign_season(df, AIR_SEASONS, years)
    values = {f"{p}_{s.name}": F.when(F.col("season") == s.name, valid(p, qa, F.col(COLUMNS[p]))) for p in pollutants for s in AIR_SEASONS}
    cell = tagged.groupBy("cell_id", "yr").agg(*[F.avg(v).alias(n) for n, v in values.items()])
    return cell.groupBy("yr").agg(*[F.avg(n).alias(n) for n in values])


def by_zone(cells: DataFrame, zone_cells: DataFrame, key: str, pollutant: str) -> DataFrame:
    return stats(cells.join(zone_cells.select(key, "cell_id"), "cell_id"), pollutant, (key, "yr"))


def hotspots(cells: DataFrame, pollutant: str, p: float = 0.9, keys=("yr",)) -> DataFrame:
    """1 where the composite reaches the exact percentile of its key; the threshold is kept."""
    k = list(keys)
    bound = histogram.percentile_threshold(cells, pollutant, p, k)
    return histogram.attach(cells, bound, k).withColumn("hotspot", A.flag(F.col(pollutant) >= F.col("threshold")))


def stack(df: DataFrame, qa: Column, start: str, end: str, reliable: str | None = POLLUTANT_START, keys=("cell_id",)) -> DataFrame:
    """The pollutants side by side per key for one date range, which starts with the reliable data."""
    return composites(temporal.between(df, clamped_start(start, reliable), end), qa, keys)
