"""Time windows, composites and per-period reductions."""
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.indices import BANDS
from gridlake.model import Season


def between(df: DataFrame, start, end, t: str = "t") -> DataFrame:
    """Rows with start <= t < end; a plain predicate, so it reaches the scan."""
    return df.filter((F.col(t) >= F.lit(_day(start))) & (F.col(t) < F.lit(_day(end))))


def _day(value):
    return date.fromisoformat(value) if isinstance(value, str) else value


def _shift_feb29(year: int, month: int, day: int) -> date:
    return date(year, month, min(day, 28) if month == 2 else day)


def assign_season(df: DataFrame, seasons, years: tuple | None = None, t: str = "t",
                  year: str = "yr", name: str = "season") -> DataFrame:
    """One row per (row, season window holding its date), as columns year and season.

    The season year follows from the date itself, so no calendar is joined and
    the number of years does not matter. ``years=(first, last)`` restricts the
    season years and also yields a date filter that is pushed to the scan."""
    seasons = [seasons] if isinstance(seasons, Season) else list(seasons)
    if years is not None:
        low = min(_shift_feb29(years[0] + s.start_off, *s.start) for s in seasons)
        high = max(_shift_feb29(years[1] + s.end_off, *s.end) for s in seasons)
        df = df.filter((F.col(t) >= F.lit(low)) & (F.col(t) < F.lit(high)))
    candidates = []
    for s in seasons:
        for back in range(s.start_off, s.end_off + 1):
            y = F.year(t) - F.lit(back)
            start, end = s.bounds(y)
            hit = (F.col(t) >= start) & (F.col(t) < end)
            if years is not None:
                hit = hit & y.between(*years)
            candidates.append(F.when(hit, F.struct(F.lit(s.name).alias("s"), y.cast("int").alias("y"))))
    if len(candidates) == 1:
        tagged = df.withColumn("_w", candidates[0]).filter(F.col("_w").isNotNull())
    else:
        tagged = df.withColumn("_w", F.explode(F.array_compact(F.array(*candidates))))
    return tagged.withColumns({year: F.col("_w.y"), name: F.col("_w.s")}).drop("_w")


def assign_windows(df: DataFrame, windows, t: str = "t", name: str = "period") -> DataFrame:
    """One row per (row, window) for a short list of (label, start, end) windows; ends exclusive."""
    windows = [(label, _day(a), _day(b)) for label, a, b in windows]
    df = df.filter((F.col(t) >= F.lit(min(a for _, a, _ in windows)))
                   & (F.col(t) < F.lit(max(b for _, _, b in windows))))
    hits = [F.when((F.col(t) >= F.lit(a)) & (F.col(t) < F.lit(b)), F.lit(label)) for label, a, b in windows]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*hits))))


def reducer(method: str, column) -> Column:
    """Temporal reducer by name. Medians keep a value-to-count map per group, which is
    bounded by the number of distinct stored integers, so a hot cell stays small."""
    c = F.col(column) if isinstance(column, str) else column
    table = {"median": lambda: F.percentile(c, F.lit(0.5)), "mean": lambda: F.avg(c), "min": lambda: F.min(c),
             "max": lambda: F.max(c), "sum": lambda: F.sum(c), "count": lambda: F.count(c),
             "std": lambda: F.stddev_pop(c)}
    if method not in table:
        raise ValueError(f"unknown reducer: {method}")
    return table[method]()


def composite(df: DataFrame, keys, method: str = "median", bands=BANDS, extra=()) -> DataFrame:
    """Per-key temporal reduction of the bands; only median, mean, min and max are composites."""
    if method not in ("median", "mean", "min", "max"):
        raise ValueError(f"unknown composite method: {method}")
    return df.groupBy(*keys).agg(*[reducer(method, b).alias(b) for b in bands], *extra)


def cloud_free(df: DataFrame, bits: int = 24, qa: str = "qa") -> DataFrame:
    """Drop observations with a flagged bit before any shuffle."""
    return df.filter(F.col(qa).bitwiseAND(F.lit(bits)) == 0)


def mode_value(df: DataFrame, keys, value: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias(value))


def first_value(df: DataFrame, keys, value: str, t: str = "t", tie: str | None = None) -> DataFrame:
    """Value of the earliest date per key; ``tie`` orders rows of the same date."""
    order = F.struct(F.col(t), F.col(tie or value))
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def snap_year(year: Column, epochs) -> Column:
    """Nearest epoch; a tie goes to the earlier one."""
    epochs = sorted(epochs)
    out = F.lit(epochs[-1])
    for a, b in reversed(list(zip(epochs, epochs[1:]))):
        out = F.when(year * 2 <= F.lit(a + b), F.lit(a)).otherwise(out)
    return out


def snap_int(year: int, epochs) -> int:
    return min(sorted(epochs), key=lambda e: abs(e - year))


def calendar_years(df: DataFrame, first: int | None = None, last: int | None = None, t: str = "t") -> DataFrame:
    """Rows of whole-year windows [y-01-01, y-12-31): the end is exclusive, so 31 December
    is outside. Adds yr; the optional range is a date predicate for the scan."""
    if first is not None:
        df = df.filter(F.col(t) >= F.lit(date(first, 1, 1)))
    if last is not None:
        df = df.filter(F.col(t) < F.lit(date(last, 12, 31)))
    return (df.filter(~((F.month(t) == 12) & (F.dayofmonth(t) == 31)))
            .withColumn("yr", F.year(t)))
