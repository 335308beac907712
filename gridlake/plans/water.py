"""Surface water: thresholds, classification, occurrence, persistence and change."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import LOW_WATER, Grid
from gridlake.operators import focal, histogram, temporal

WATER_BANDS = ("green", "nir", "swir1", "swir2")
DECADES = ((1985, 1994), (1995, 2004), (2005, 2014), (2015, 2025))


def classify(composite: DataFrame, keys=(), method: str = "fixed", thresholds=(0.0, 0.0, 0.0),
             out: str = "water") -> DataFrame:
    """Majority vote of three water indices.

    fixed uses the given thresholds. otsu computes one threshold per index and key
    from the index histogram and falls back to the given value where a key has none."""
    if method == "fixed":
        return composite.withColumn(out, I.water_vote(*thresholds))
    if method != "otsu":
        raise ValueError(f"unknown water method: {method}")
    k, names = list(keys), ("ndwi", "mndwi", "awei")
    rows = F.array(*[F.struct(F.lit(n).alias("_i"), F.col(n).alias("_v")) for n in names])
    stacked = I.with_water_indices(composite).select(*k, F.inline(rows))
    found = histogram.otsu(stacked, "_v", k + ["_i"], out="_t")
    limits = found.groupBy(*k).agg(*[F.max(F.when(F.col("_i") == n, F.col("_t"))).alias(f"_{n}_t") for n in names])
    bounds = [F.coalesce(F.col(f"_{n}_t"), F.lit(float(d))) for n, d in zip(names, thresholds)]
    joined = composite.join(limits, k, "left") if k else composite.withColumns(
        {f"_{n}_t": limits.select(f"_{n}_t").scalar() for n in names})
    return joined.withColumn(out, I.water_vote(*bounds)).drop(*[f"_{n}_t" for n in names])


def method_for(scope: str) -> str:
    """Fixed thresholds for the national scope, Otsu for all others."""
    return "fixed" if scope == "national" else "otsu"


def classify_for(composite: DataFrame, scope: str, region_keys=None, thresholds=(0.0, 0.0, 0.0), out: str = "water") -> DataFrame:
    """`classify` by the scope's method; without a region, whose keys group the histograms, thresholds are fixed."""
    if region_keys is None:
        return classify(composite, (), "fixed", thresholds, out)
    return classify(composite, region_keys, method_for(scope), thresholds, out)


def otsu_or_default(df: DataFrame, value: str, keys, default: float = 0.0, out: str = "threshold") -> DataFrame:
    """One threshold per key of ``df``; the default where the band is entirely masked."""
    k = list(keys)
    found = histogram.otsu(df, value, k, out="_t")
    return (df.select(*k).distinct().join(found, k, "left")
            .select(*k, F.coalesce("_t", F.lit(default)).alias(out)))


def water_area(masks: DataFrame, keys, grid: Grid, value: str = "water", out: str = "water_km2") -> DataFrame:
    """Despeckled area: opening with the plus element, then the sum of cell areas."""
    opened = focal.opening(grid.attach(masks), value, keys, "_o")
    return opened.groupBy(*keys).agg(A.km2(F.col("_o"), F.col("area_m2")).alias(out))


def low_water_masks(obs: DataFrame, years=None) -> DataFrame:
    """Water per (cell, year) from the November to February composite."""
    seasonal = temporal.assign_season(temporal.cloud_free(obs), LOW_WATER, years)
    return classify(temporal.composite(seasonal, ["cell_id", "yr"], bands=WATER_BANDS)).select("cell_id", "yr", "water")


def occurrence(obs: DataFrame, cells: DataFrame, years) -> DataFrame:
    """Share of years classified as water, for every grid cell.

    A masked cell counts as not water; the denominator is the number of years with
    any scene. No such year gives 0."""
    valid = temporal.assign_season(obs.select("t"), LOW_WATER, years).agg(F.count_distinct("yr")).scalar()
    wet = low_water_masks(obs, years).groupBy("cell_id").agg(F.sum(A.unmask(F.col("water"))).alias("_w"))
    return (cells.join(wet, "cell_id", "left")
            .withColumn("occurrence_share", F.coalesce(F.coalesce("_w", F.lit(0)) / F.nullif(valid, F.lit(0)), F.lit(0.0)))
            .drop("_w"))


def period_of(year: Column, periods) -> Column:
    out = None
    for a, b in periods:
        rule = (year.between(a, b), F.lit(f"{a}-{b}"))
        out = F.when(*rule) if out is None else out.when(*rule)
    return out



def decade_occurrence(obs: DataFrame, cells: DataFrame, periods=DECADES) -> DataFrame:
    """Occurrence per period as one wide row per cell: columns occ_0, occ_1, ...

    All periods come from one pass: yearly masks, then one conditional sum per period."""
    years = (min(a for a, _ in periods), max(b for _, b in periods))
    scene_years = temporal.assign_season(obs.select("t"), LOW_WATER, years)
    masks = low_water_masks(obs, years).groupBy("cell_id").agg(*[
        F.sum(F.when(F.col("yr").between(a, b), A.unmask(F.col("water"))).otherwise(0)).alias(f"_w{i}")
        for i, (a, b) in enumerate(periods)])
    out = cells.join(masks, "cell_id", "left")
    for i, (a, b) in enumerate(periods):
        valid = scene_years.agg(F.count_distinct(F.when(F.col("yr").between(a, b), F.col("yr")))).scalar()
        share = F.coalesce(F.col(f"_w{i}"), F.lit(0)) / F.nullif(valid, F.lit(0))
        out = out.withColumn(f"occ_{i}", F.coalesce(share, F.lit(0.0)))
    return out.drop(*[f"_w{i}" for i in range(len(periods))])


def persistence(share: Column, permanent: float = 0.75, seasonal: float = 0.25) -> Column:
    """3 permanent, 2 seasonal, 1 rare, 0 none."""
    return A.where_chain(0, (share > 0, 1), (share >= seasonal, 2), (share >= permanent, 3))


def change_class(change: Column, threshold: float = 0.25) -> Column:
    """2 strong gain, 1 gain, -1 loss, -2 strong loss, 0 none."""
    t = F.lit(threshold)
    return (F.when(change > t, 2).when(change > 0, 1).when(change < -t, -2).when(change < 0, -1).otherwise(0))


def period_changes(wide: DataFrame, periods, threshold: float = 0.25) -> DataFrame:
    """Change and class of every neighbouring period pair, one row per (cell, pair)."""
    pairs = F.array(*[F.struct(F.lit(f"{a[0]}-{a[1]}").alias("early"), F.lit(f"{b[0]}-{b[1]}").alias("late"),
                               (F.col(f"occ_{i + 1}") - F.col(f"occ_{i}")).alias("change"))
                      for i, (a, b) in enumerate(zip(periods, periods[1:]))])
    return wide.select("cell_id", "area_m2", F.inline(pairs)).withColumn(
        "change_class", change_class(F.col("change"), threshold))


def conversion(early: Column, late: Column, water_min: float = 0.5, land_max: float = 0.1) -> dict[str, Column]:
    return {"water_to_land": A.flag((early >= water_min) & (late < land_max)),
            "land_to_water": A.flag((early < land_max) & (late >= water_min))}


def reference_correlation(own: DataFrame, value: str, reference: str = "occurrence") -> DataFrame:
    return own.agg(A.correlation(F.col(value), F.col(reference) / F.lit(100.0)).alias("pearson_r"))


def area_by_persistence(df: DataFrame, share: str, area: str = "area_m2") -> DataFrame:
    p = persistence(F.col(share))
    return df.agg(*[A.km2_where(p == code, F.col(area)).alias(f"{name}_km2")
                    for code, name in ((3, "permanent"), (2, "seasonal"), (1, "rare"))])
