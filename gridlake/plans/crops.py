"""Rice phenology, crop types, yield proxy, stress and cropping intensity."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import CALENDAR_YEAR, CROP_STRESS, CROP_TYPES, RICE_PHASES, YIELD_WINDOWS
from gridlake.operators import temporal, zonal

SCALE = 1e-4


def _phase(season: str):
    if season not in RICE_PHASES:
        raise ValueError(f"unknown rice season: {season}")
    return RICE_PHASES[season]


def rice_masks(obs: DataFrame, seasons=("aman", "boro", "aus"), years=None, bits: int = 24) -> DataFrame:
    """One 0/1 column per rice season and (cell, year): flooded (LSWI > 0) while transplanting
    and green (NDVI > 0.4) at the peak. All phases of all seasons share one grouped pass."""
    clear = temporal.cloud_free(obs, bits)
    if years is not None:
        clear = temporal.between(clear, f"{years[0]}-01-01", f"{years[1] + 1}-01-01")
    clear = clear.withColumn("yr", F.year("t"))
    t, aggs = F.col("t"), []
    for season in seasons:
        flood, peak = _phase(season)
        for phase, bands in ((flood, ("nir", "swir1")), (peak, ("nir", "red"))):
            start, end = phase.bounds(F.year("t"))
            inside = (t >= start) & (t < end)
            aggs += [F.percentile(F.when(inside, F.col(b)), F.lit(0.5)).alias(f"_{season}_{phase.name}_{b}") for b in bands]
    wide = clear.groupBy("cell_id", "yr").agg(*aggs)
    for season in seasons:
        flooded = A.flag(I.lswi(f"_{season}_flood_nir", f"_{season}_flood_swir1") > 0)
        green = A.flag(I.ndvi(f"_{season}_peak_nir", f"_{season}_peak_red") > 0.4)
        wide = wide.withColumn(season, A.mask_and(flooded, green))
    return wide.select("cell_id", "yr", *seasons)


def flood_phase_scenes(obs: DataFrame, season: str, bits: int = 24) -> DataFrame:
    """Number of scene dates of the transplanting window per year; below 3 is unreliable."""
    flood, _ = _phase(season)
    tagged = temporal.assign_season(temporal.cloud_free(obs, bits).select("t", "qa"), flood)
    return (tagged.groupBy("yr").agg(F.count_distinct("t").alias("scenes"))
            .withColumn("unreliable", A.flag(F.col("scenes") < 3)))


def rice_areas(masks: DataFrame, area, seasons=("aman", "boro", "aus")) -> DataFrame:
    """km2 per (year, season)."""
    wide = masks.groupBy("yr").agg(*[A.km2(F.col(s), area).alias(s) for s in seasons])
    return wide.select("yr", F.inline(F.array(*[F.struct(F.lit(s).alias("season"), F.col(s).alias("rice_km2")) for s in seasons])))


def crop_types(labels: DataFrame, rice: DataFrame) -> DataFrame:
    """Crop class per (cell, year). labels: the yearly land-cover mode, class 4 = crops.
    Rules apply in order and the last match wins; a masked rice season masks 'other crops'."""
    df = labels.join(rice, ["cell_id", "yr"], "left")
    aman, boro, aus = (F.col(s) for s in ("aman", "boro", "aus"))
    any_rice = A.mask_or(aman, boro, aus)
    other = A.mask_and(A.flag(F.col("label") == 4), A.mask_not(any_rice))
    code = A.where_chain(0, (aman == 1, 1), (boro == 1, 2), (A.mask_and(aman, boro) == 1, 3), (aus == 1, 4),
                         (A.mask_and(aus, aman) == 1, 5), (A.mask_and(aus, boro) == 1, 6), (other == 1, 7))
    return df.select("cell_id", "yr", code.alias("crop_type"))


def crop_areas(types: DataFrame, area) -> DataFrame:
    return zonal.area_by_class(types, "crop_type", area, dict(enumerate(CROP_TYPES)), ["yr"])


def monthly_means(vegetation: DataFrame) -> DataFrame:
    """Mean stored NDVI, v, per (cell, year, month)."""
    return vegetation.groupBy("cell_id", F.year("t").alias("yr"), F.month("t").alias("mo")).agg(F.avg("ndvi_dn").alias("v"))


def monthly_profile(vegetation: DataFrame, cells: DataFrame, years, cropland_code: int = 40) -> DataFrame:
    """12 monthly cropland means per year (mean over cells of the per-cell monthly mean)."""
    crop = cells.filter(F.col("worldcover") == cropland_code).select("cell_id")
    inside = temporal.between(vegetation, f"{years[0]}-01-01", f"{years[1] + 1}-01-01").join(crop, "cell_id", "left_semi")
    return _zone_profile(monthly_means(inside), years)


def profile_of(monthly: DataFrame, cells: DataFrame, years, cropland_code: int = 40) -> DataFrame:
    """The same from the monthly means of all cells."""
    crop = cells.filter(F.col("worldcover") == cropland_code).select("cell_id")
    return _zone_profile(monthly.filter(F.col("yr").between(*years)).join(crop, "cell_id", "left_semi"), years)


def _zone_profile(monthly: DataFrame, years) -> DataFrame:
    monthly = (monthly.groupBy("yr", "mo").agg((F.avg("v") * F.lit(SCALE)).alias("mean_ndvi")))
    calendar = (monthly.sparkSession.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("yr"))
                .withColumn("mo", F.explode(F.sequence(F.lit(1), F.lit(12)))))
    return calendar.join(monthly, ["yr", "mo"], "left")


def yield_proxy(vegetation: DataFrame, seasons=("aman", "boro", "aus"), years=None) -> DataFrame:
    """Zone mean and maximum of the NDVI integral of each season window per (season, year).
    An unknown season uses the whole year."""
    windows = [YIELD_WINDOWS.get(s, CALENDAR_YEAR) for s in seasons]
    tagged = temporal.assign_season(vegetation, windows, years)
    per_cell = tagged.groupBy("season", "yr", "cell_id").agg(F.sum("ndvi_dn").alias("s"))
    return per_cell.groupBy("season", "yr").agg((F.avg("s") * F.lit(SCALE)).alias("mean_integral"),
                                                (F.max("s") * F.lit(SCALE)).alias("max_integral"))


def crop_stress(vegetation: DataFrame, first: int = 2000, last: int = 2020) -> DataFrame:
    """Peak-season mean of a year minus the mean of the baseline years' means, the year itself
    left out. The window holds one row per year of a cell."""
    yearly = (temporal.assign_season(vegetation, CROP_STRESS).groupBy("cell_id", "yr").agg(F.avg("ndvi_dn").alias("v")))
    whole = Window.partitionBy("cell_id")
    inside = F.col("yr").between(first, last)
    total, count = F.sum(F.when(inside, F.col("v"))).over(whole), F.count(F.when(inside, F.col("v"))).over(whole)
    own, own_n = F.when(inside, F.col("v")).otherwise(0.0), A.flag(inside)
    base = (F.coalesce(total, F.lit(0.0)) - own) / F.nullif(count - own_n, F.lit(0))
    return yearly.select("cell_id", "yr", ((F.col("v") - base) * F.lit(SCALE)).alias("crop_stress"))


def cropping_intensity(vegetation: DataFrame, cells: DataFrame, years=None, code: int = 40) -> DataFrame:
    """Harvests per (cell, year) from the number of months with mean NDVI above 0.4; cells
    outside cropland are 0."""
    if years is not None:
        vegetation = temporal.between(vegetation, f"{years[0]}-01-01", f"{years[1] + 1}-01-01")
    return intensity_of(monthly_means(vegetation), cells, code)


def intensity_of(monthly: DataFrame, cells: DataFrame, code: int = 40) -> DataFrame:
    """The same from the monthly means."""
    months = monthly.groupBy("cell_id", "yr").agg(F.sum(A.flag(F.col("v") * F.lit(SCALE) > 0.4)).alias("m"))
    masked = months.join(cells.select("cell_id", A.flag(F.col("worldcover") == code).alias("_c")), "cell_id")
    m = F.when(F.col("_c") == 1, F.col("m"))
    return masked.select("cell_id", "yr", A.where_chain(0, (m.between(3, 5), 1), (m.between(6, 8), 2), (m >= 9, 3)).alias("intensity"))
