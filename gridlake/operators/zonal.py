"""Zonal statistics."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(df: DataFrame, value, keys=(), which=("mean",), prefix: str | None = None) -> DataFrame:
    """Combined reducers in one pass. which: mean, sum, min, max, std, median, count, pNN.

    Median and pNN suit stored integers; for real values over many cells use
    ``histogram.percentiles``."""
    c = F.col(value) if isinstance(value, str) else value
    base = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "count": F.count,
            "median": lambda v: F.percentile(v, F.lit(0.5))}
    aggs = []
    for w in which:
        agg = base[w](c) if w in base else F.percentile(c, F.lit(int(w[1:]) / 100))
        aggs.append(agg.alias(f"{prefix}_{w}" if prefix else w))
    return df.groupBy(*keys).agg(*aggs)


def by_zone(values: DataFrame, zone_cells: DataFrame, keys, *aggs) -> DataFrame:
    """Aggregate per zone after reducing to one row per cell.

    ``values`` should already hold one row per (cell, period); then a hot cell adds one
    row per zone and period, and partial aggregation runs before the zone shuffle."""
    return values.join(zone_cells, "cell_id").groupBy(*keys).agg(*aggs)


def area_by_class(df: DataFrame, class_col: str, area: Column, classes: dict, keys=()) -> DataFrame:
    """km2 of every listed class; an absent class gives 0.

    One conditional sum per class in a single pass, then unpivoted, so classes that
    do not occur need no outer join."""
    aggs = [(F.sum(F.when(F.col(class_col) == code, area).otherwise(F.lit(0))) / F.lit(1e6)).alias(f"_{code}")
            for code in classes]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(code).cast("int").alias("class"), F.lit(label).alias("class_name"),
                              F.col(f"_{code}").alias("area_km2")) for code, label in classes.items()])
    return wide.select(*keys, F.inline(rows))


def weighted_stats(df: DataFrame, value: str, zone_weights: DataFrame, keys=("zone_id",), area: str = "area_m2") -> DataFrame:
    """Statistics of border cells by their covered share: (keys, cells, covered_m2, total, mean, min, max).

    ``zone_weights`` is what ``zones.coverage`` gives. A cell adds its share of its area, of its
    value to the total and of its weight to the mean; masked cells add nothing to the last two."""
    w, v = F.col("weight"), F.col(value)
    rows = df.select("cell_id", value, area).join(zone_weights.drop("x", "y"), "cell_id")
    return rows.groupBy(*keys).agg(
        F.count(v).alias("cells"), F.sum(w * F.col(area)).alias("covered_m2"), F.sum(w * v).alias("total"),
        (F.sum(w * v) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
