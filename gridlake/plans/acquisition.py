"""Collections, masks and composites."""
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.indices import BANDS
from gridlake.model import DRY_MONSOON, SENSOR_DATES, SENSORS
from gridlake.operators import temporal


def mask_clouds(obs: DataFrame, sensor: str, bands=BANDS) -> DataFrame:
    """Keep every row; all bands become NULL where a cloud or shadow bit is set."""
    bits = SENSORS[sensor][3]
    clear = F.col("qa").bitwiseAND(F.lit(bits)) == 0
    return obs.withColumns({b: F.when(clear, F.col(b)) for b in bands})


def harmonise(obs: DataFrame, sensor: str, renamed: bool = True) -> DataFrame:
    """Original band names to canonical ones (unless already renamed) and integers to reflectance."""
    original, scale, offset, _ = SENSORS[sensor]
    if not renamed:
        obs = obs.withColumnsRenamed(dict(zip(original.split(), BANDS + ("qa",))))
    return obs.withColumns({b: F.col(b) * F.lit(scale) + F.lit(offset) for b in BANDS})


def sensors_for(start: str, end: str) -> list[tuple[str, str, str]]:
    """(sensor, start, end) parts of a date range, by each sensor's years of service."""
    first, last = int(start[:4]), int(end[:4])
    parts = []
    if first <= 2012:
        parts.append(("L5", start, min(end, SENSOR_DATES["L5"][1])))
    if first <= 2024 and last >= 1999:
        parts.append(("L7", start, end))
    if last >= 2013:
        parts.append(("L8", max(start, SENSOR_DATES["L8"][0]), end))
    if last >= 2021:
        parts.append(("L9", max(start, SENSOR_DATES["L9"][0]), end))
    if not parts:
        raise ValueError(f"no sensor covers {start} to {end}")
    return parts


def multi_sensor(frames: dict[str, DataFrame], start: str, end: str, area_cells: DataFrame | None = None) -> DataFrame:
    """Union of the sensors valid for a date range: filter by date and area, scale, mask, tag."""
    out = None
    for sensor, a, b in sensors_for(start, end):
        if sensor not in frames:
            continue
        part = temporal.between(frames[sensor], a, b)
        if area_cells is not None:
            part = part.join(area_cells.select("cell_id"), "cell_id", "left_semi")
        part = harmonise(mask_clouds(part, sensor), sensor).withColumn("sensor", F.lit(sensor))
        out = part if out is None else out.unionByName(part)
    return out


def low_cloud_scenes(obs: DataFrame, start: str, end: str, max_cloud_pct: int = 30) -> DataFrame:
    """Sensor family 2: scenes below a cloud share, then the bit mask."""
    scenes = temporal.between(obs, start, end).filter(F.col("scene_cloud_pct") < max_cloud_pct)
    return mask_clouds(scenes, "S2")


def seasonal_composite(obs: DataFrame, seasons=DRY_MONSOON, years=None, bits: int = 24, bands=BANDS,
                       keys=("cell_id",)) -> DataFrame:
    """Median per (cell, season year, season). Works on stored integers; scaling is affine
    and can follow."""
    clear = temporal.cloud_free(obs, bits)
    return temporal.composite(temporal.assign_season(clear, seasons, years), [*keys, "yr", "season"], bands=bands)


def yearly_composite(obs: DataFrame, bits: int = 24, bands=BANDS, method: str = "median") -> DataFrame:
    return temporal.composite(temporal.cloud_free(obs, bits), ["cell_id", "yr"], method, bands)


def run_by_zone(values: DataFrame, zone_cells: DataFrame, keys, *aggs) -> DataFrame:
    """Evaluate an aggregate per zone; the tile loop is a grouping key."""
    return values.join(zone_cells.select("cell_id", "zone"), "cell_id").groupBy("zone", *keys).agg(*aggs)


def merge_mosaic(parts: list[DataFrame], value: str) -> DataFrame:
    """Overlay tile rasters in order; the last tile with a value wins."""
    out = None
    for order, part in enumerate(parts):
        part = part.select("cell_id", value).withColumn("_o", F.lit(order))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("cell_id").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_o"))).alias(value))


def merge_series(tiles: DataFrame, year: str, columns) -> DataFrame:
    """Sum every column over tiles per year; NULL tiles are skipped."""
    return tiles.groupBy(year).agg(*[F.sum(c).alias(c) for c in columns])


def dates(start: str, end: str) -> tuple[date, date]:
    return date.fromisoformat(start), date.fromisoformat(end)
