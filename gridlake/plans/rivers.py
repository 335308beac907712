"""River corridors, channel migration and bank erosion."""
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import DECADE_YEARS, Grid
from gridlake.operators import focal, temporal, zones
from gridlake.plans.floods import conditional_masks
from gridlake.session import stored


def corridor(cells: DataFrame, waypoints: DataFrame, key: str, order: str, buffer) -> DataFrame:
    return zones.in_corridors(cells, zones.segments(waypoints, key, order), key, buffer)


def windows(years=DECADE_YEARS, reach: int = 2, early_reach: int = 5, last_day=(3, 1), today: str | None = None):
    """(year, start, end) around each year; wider before 1990, floored at 1984-03-01, capped at today."""
    out = []
    for y in years:
        w = reach if y >= 1990 else max(reach, early_reach)
        start = max(date(y - w, 12, 1), date(1984, 3, 1))
        end = date(y + w, *last_day)
        out.append((y, start, min(end, date.fromisoformat(today)) if today else end))
    return out


def wide_window(year: int, reach: int = 2, early_reach: int = 5, today: str | None = None):
    """What stands in for a window without scenes: from two more years before until today."""
    before = reach if year >= 1990 else max(reach, early_reach)
    return year, date(max(year - before - 2, 1984), 3, 1), date.fromisoformat(today) if today else date(9999, 12, 31)


def filled_windows(obs: DataFrame, years=DECADE_YEARS, reach: int = 2, early_reach: int = 5, last_day=(3, 1), today: str | None = None):
    """`windows`, where one without any scene starts two more years before and ends today.

    Runs one small job over the scene dates: a number per window reaches the driver. For one
    region; `region_masks` decides for every region of a table by itself."""
    spans = windows(years, reach, early_reach, last_day, today)
    counts = obs.agg(*[F.count(F.when(_within(a, b), 1)) for _, a, b in spans]).first()
    return [span if n else wide_window(span[0], reach, early_reach, today) for span, n in zip(spans, counts)]


def _within(start, end):
    return (F.col("t") >= F.lit(start)) & (F.col("t") < F.lit(end))


def region_masks(obs: DataFrame, region_cells: DataFrame, key: str, years=DECADE_YEARS, reach: int = 2, early_reach: int = 5,
                 last_day=(3, 1), today: str | None = None) -> DataFrame:
    """One row per (region, cell) with a 0/1 column w_<year> per window; unseen cells are 0.

    Scenes are restricted to the regions' cells before anything is composited. A window
    without a scene in a region, clear or not, is widened for that region alone."""
    spans = windows(years, reach, early_reach, last_day, today)
    wides = [wide_window(y, reach, early_reach, today) for y in years]
    cells = region_cells.select(key, "cell_id").distinct()
    near = temporal.between(obs, min(a for _, a, _ in spans + wides), max(b for _, _, b in spans + wides)).join(cells, "cell_id")
    scenes = near.groupBy(key).agg(*[F.count(F.when(_within(a, b), 1)).alias(f"_n_{y}") for y, a, b in spans])
    labels = {f"w_{y}": F.when(F.col(f"_n_{y}") > 0, _within(a, b)).otherwise(_within(wa, wb)) for (y, a, b), (_, wa, wb) in zip(spans, wides)}
    masks = conditional_masks(temporal.cloud_free(near).join(scenes, key), [key, "cell_id"], labels)
    return cells.join(masks, [key, "cell_id"], "left").withColumns({c: A.unmask(F.col(c)) for c in labels})


def at_resolution(wide: DataFrame, years, keys, factor) -> DataFrame:
    """Masks at a coarser working resolution: blocks of factor x factor cells, water where most of their cells are.

    ``factor`` may differ by key; a block has the area of its cells and the id of its first one."""
    block = {f"_{c}": F.floor(F.col(c) / factor) for c in "xy"}
    majority = [F.when(2 * F.sum(f"w_{y}") > F.count(F.lit(1)), 1).otherwise(0).alias(f"w_{y}") for y in years]
    return wide.withColumns(block).groupBy(*keys, "_x", "_y").agg(
        F.min("cell_id").alias("cell_id"), F.sum("area_m2").alias("area_m2"), *majority).drop("_x", "_y")


def window_masks(obs: DataFrame, cells: DataFrame, spans) -> DataFrame:
    """One row per grid cell with a 0/1 column w_<year> per window; unseen cells are 0."""
    clear = temporal.cloud_free(obs)
    clear = temporal.between(clear, min(s for _, s, _ in spans), max(e for _, _, e in spans))
    t = F.col("t")
    labels = {f"w_{y}": (t >= F.lit(a)) & (t < F.lit(b)) for y, a, b in spans}
    masks = conditional_masks(clear, ["cell_id"], labels)
    return cells.join(masks, "cell_id", "left").withColumns({c: A.unmask(F.col(c)) for c in labels})


def long_masks(wide: DataFrame, years) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(y).alias("period"), F.col(f"w_{y}").alias("water")) for y in years])
    keep = [c for c in wide.columns if not c.startswith("w_")]
    return wide.select(*keep, F.inline(rows))


def migration(wide: DataFrame, years) -> DataFrame:
    """Per (cell, neighbouring pair): abandonment, bank erosion, net change. Row-wise."""
    def pair(a, b):
        w1, w2 = F.col(f"w_{a}"), F.col(f"w_{b}")
        return F.struct(F.lit(a).alias("early"), F.lit(b).alias("late"),
                        A.mask_and(w1, A.mask_not(w2)).alias("abandonment"),
                        A.mask_and(w2, A.mask_not(w1)).alias("bank_erosion"), (w2 - w1).alias("net_change"))
    keep = [c for c in wide.columns if not c.startswith("w_")]
    return wide.select(*keep, F.inline(F.array(*[pair(a, b) for a, b in zip(years, years[1:])])))


def erosion_rates(moves: DataFrame, keys=("early", "late")) -> DataFrame:
    """Eroded hectares per pair and per year."""
    ha = F.coalesce(F.sum(F.col("bank_erosion") * F.col("area_m2")), F.lit(0)) / F.lit(1e4)
    return (moves.groupBy(*keys).agg(ha.alias("erosion_ha"))
            .withColumn("erosion_ha_per_year", F.col("erosion_ha") / (F.col("late") - F.col("early"))))


def hotspots(moves: DataFrame, keys=("cell_id",)) -> DataFrame:
    """Number of periods with bank erosion per cell."""
    return moves.groupBy(*keys).agg(F.sum("bank_erosion").alias("erosion_periods"))


def centerline(masks: DataFrame, keys=("period",), rounds: int = 5) -> DataFrame:
    """Erode up to ``rounds`` times per key, stopping a key before it would vanish; the
    centerline is what one more erosion removes."""
    k = list(keys)
    state = stored(masks.withColumn("_s", F.col("water")), "eroded")
    for _ in range(rounds):
        eroded = stored(focal.focal_min(state, "_s", k, "_n"), "eroded")
        alive = eroded.groupBy(*k).agg(F.sum("_n").alias("_alive"))
        if alive.filter(F.col("_alive") > 0).isEmpty():
            break
        state = (eroded.join(alive, k)
                 .withColumn("_s", F.when(F.col("_alive") > 0, F.col("_n")).otherwise(F.col("_s")))
                 .drop("_n", "_alive"))
    return (focal.focal_min(state, "_s", k, "_n")
            .withColumn("centerline", A.flag(F.col("_s") - F.col("_n") > 0)).drop("_s", "_n"))


def resolution(buffer_m):
    """Working cell size in metres by corridor width; a number or a column."""
    if isinstance(buffer_m, (int, float)):
        return 300 if buffer_m >= 8000 else 100 if buffer_m >= 5000 else 30
    return F.when(buffer_m >= 8000, 300).when(buffer_m >= 5000, 100).otherwise(30)


def river_report(obs: DataFrame, corridors: DataFrame, key: str, grid: Grid, buffer_m, years=DECADE_YEARS, cell_m: int = 30, **windows_of) -> DataFrame:
    """Erosion area and rate per (river, pair): one job for all rivers and periods.

    Windows are widened per river, and each river is measured at the resolution of its width;
    ``buffer_m`` is a column of the key and the corridors."""
    factor = corridors.select(key, F.floor(resolution(buffer_m) / F.lit(cell_m)).alias("_factor")).distinct()
    wide = grid.attach(region_masks(obs, corridors, key, years, **windows_of)).join(factor, key)
    return erosion_rates(migration(at_resolution(wide, years, [key], F.col("_factor")), years), (key, "early", "late"))
