"""Land-cover products: yearly classes, areas, transitions and static summaries."""
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import DW_CLASSES, IGBP_CLASSES
from gridlake.operators import temporal, zonal


def first_of_year(classes: DataFrame, value: str = "label") -> DataFrame:
    return temporal.first_value(temporal.calendar_years(classes), ["cell_id", "yr"], value)


def yearly_mode(classes: DataFrame, value: str = "label") -> DataFrame:
    """Most frequent class per (cell, year); ties go to the lowest class."""
    return temporal.mode_value(temporal.calendar_years(classes), ["cell_id", "yr"], value)


def mean_probabilities(classes: DataFrame, bands: dict[str, Column], keys=("cell_id", "yr")) -> DataFrame:
    """Mean of each class-probability band over dates."""
    return temporal.calendar_years(classes).groupBy(*keys).agg(*[F.avg(e).alias(n) for n, e in bands.items()])


def class_share_bands(value: str = "label") -> dict[str, Column]:
    """One-hot stand-ins for the nine probability bands of a labelled product."""
    return {name: A.flag(F.col(value) == i) for i, name in enumerate(DW_CLASSES)}


def with_year_fallback(year: int, layers: dict[int, Column], fallback: int = 2021) -> Column:
    """The layer of the year if there is one, otherwise the fallback year's layer."""
    return layers[year if year in layers else fallback]


def class_areas(df: DataFrame, value: str, area: Column, classes=IGBP_CLASSES, keys=()) -> DataFrame:
    table = dict(enumerate(classes)) if not isinstance(classes, dict) else classes
    return zonal.area_by_class(df, value, area, table, keys)


def transitions(classes: DataFrame, year1: int, year2: int, source: str = "mode") -> DataFrame:
    """changed flag and code c1 * 100 + c2 per cell; one grouped pass picks both years."""
    per_year = {"mode": yearly_mode, "first": first_of_year}
    if source not in per_year:
        raise ValueError(f"unknown land-cover source: {source}")
    in_year = [(F.col("t") >= F.lit(date(y, 1, 1))) & (F.col("t") < F.lit(date(y + 1, 1, 1))) for y in (year1, year2)]
    yearly = per_year[source](classes.filter(in_year[0] | in_year[1]))      # ranges of dates reach the scan
    wide = yearly.groupBy("cell_id").agg(F.max(F.when(F.col("yr") == year1, F.col("label"))).alias("c1"),
                                         F.max(F.when(F.col("yr") == year2, F.col("label"))).alias("c2"))
    changed = A.flag(F.col("c1") != F.col("c2"))
    return wide.select("cell_id", "c1", "c2", changed.alias("changed"),
                       A.update_mask(F.col("c1") * 100 + F.col("c2"), changed).alias("transition"))


def transition_areas(changes: DataFrame, area: Column) -> DataFrame:
    return (changes.filter(F.col("changed") == 1).groupBy("c1", "c2")
            .agg((F.sum(area) / F.lit(1e6)).alias("area_km2")))


def proportion_series(classes: DataFrame) -> DataFrame:
    """Zone mean of the per-cell class probabilities per year."""
    cell = mean_probabilities(classes, class_share_bands())
    return cell.groupBy("yr").agg(*[F.avg(n).alias(n) for n in DW_CLASSES])


def area_series(yearly: DataFrame, area: Column, classes=IGBP_CLASSES) -> DataFrame:
    """One row per year, one km2 column per class name."""
    return yearly.groupBy("yr").agg(*[A.km2_where(F.col("label") == i, area).alias(name) for i, name in enumerate(classes)])


def static_summary(cells: DataFrame, population: DataFrame, built_km2: DataFrame, forest_min: int = 25,
                   permanent: int = 80, seasonal: int = 20, last_code: int = 23) -> DataFrame:
    """Wide summary from static layers: forest, water, population and the remainder.

    Loss by year is not limited to forest here; occurrence above 100 is no data."""
    area, occ = F.col("area_m2"), F.when(F.col("occurrence") <= 100, F.col("occurrence")).otherwise(0)
    base = cells.agg(
        (F.sum(area) / F.lit(1e6)).alias("total_km2"),
        A.km2_where(F.col("treecover") > forest_min, area).alias("forest_2000_km2"),
        A.km2_where(F.col("lossyear").between(1, last_code), area).alias("forest_loss_km2"),
        A.km2_where(F.col("gain") == 1, area).alias("forest_gain_km2"),
        A.km2_where(occ >= permanent, area).alias("permanent_water_km2"),
        A.km2_where((occ >= seasonal) & (occ < permanent), area).alias("seasonal_water_km2"))
    people = population.filter(F.col("population") > 0).agg(F.sum("population").alias("population"),
                                                            F.avg("population").alias("population_mean"))
    c = F.col
    return (base.withColumns({
        "built_km2": built_km2.scalar(), "population": people.select("population").scalar(),
        "population_mean": people.select("population_mean").scalar(),
        "forest_current_km2": c("forest_2000_km2") - c("forest_loss_km2") + c("forest_gain_km2")})
        .withColumn("cropland_other_km2", c("total_km2") - c("forest_current_km2") - c("built_km2")
                    - (c("permanent_water_km2") + c("seasonal_water_km2"))))


def summary_long(summary: DataFrame) -> DataFrame:
    """(category, area_km2, year) rows of the summary."""
    rows = [("forest_current", "forest_current_km2", 2023), ("built_area", "built_km2", 2020),
            ("permanent_water", "permanent_water_km2", 2020), ("seasonal_water", "seasonal_water_km2", 2020),
            ("cropland_other", "cropland_other_km2", 2020)]
    return summary.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("category"), F.col(k).alias("area_km2"), F.lit(y).alias("year")) for n, k, y in rows])))


def density_distribution(population: DataFrame, thresholds=(1000, 2000, 5000, 10000, 20000), proxy: int = 10000, keys=()) -> DataFrame:
    """Number of cells at or above each density, per keys such as the epoch; the proxy counts cells of 1 km2."""
    aggs = [F.count_if(F.col("population") >= t).alias(f"cells_gte_{t}") for t in thresholds]
    return population.groupBy(*keys).agg(*aggs, F.count_if(F.col("population") >= proxy).alias("slum_proxy_km2"))


def occurrence_classes(cells: DataFrame, permanent: int = 75, seasonal: int = 25) -> DataFrame:
    o, area = F.col("occurrence"), F.col("area_m2")
    return cells.agg(A.km2_where(o > permanent, area).alias("permanent_km2"),
                     A.km2_where((o >= seasonal) & (o <= permanent), area).alias("seasonal_km2"),
                     A.km2_where((o > 0) & (o < seasonal), area).alias("rare_km2"))
