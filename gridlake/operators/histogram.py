"""Histograms and automatic thresholds."""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridlake.session import stored


def attach(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Statistics beside the rows: an equi join on the keys, or scalar subqueries without keys
    (a join on a constant would become a nested-loop join)."""
    k = list(keys)
    return df.join(stats, k) if k else df.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def histogram(df: DataFrame, value: str, keys=(), buckets: int = 255) -> DataFrame:
    """Equal-width histogram between the minimum and maximum per key: bucket, n, mean."""
    k = list(keys)
    values = df.select(*k, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    bounds = values.groupBy(*k).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    position = F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)) * F.lit(buckets))
    binned = attach(values, bounds, k).withColumn(
        "bucket", F.least(F.coalesce(position, F.lit(0)), F.lit(buckets - 1)).cast("int"))
    return binned.groupBy(*k, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))


#: The narrowest bucket of a one-pass histogram is 2**NARROWEST wide.
NARROWEST = -40
#: Keys whose histograms a task holds before it passes them on and begins anew.
HELD_KEYS = 1000
#: Rows of a key that one task may sort by itself; longer keys take the brackets.
SORTED_ROWS = 100_000


def _exponent(low: float, high: float, buckets: int) -> int:
    """The smallest e at which buckets of width 2**e, aligned at its multiples, hold low to high in at most ``buckets``."""
    def fits(e):
        return math.floor(math.ldexp(high, -e)) - math.floor(math.ldexp(low, -e)) < buckets
    least = max(NARROWEST, math.frexp(max(-low, high))[1] - 52)      # no narrower than the values are exact
    e = least if high <= low else max(least, math.frexp((high - low) / buckets)[1] - 2)
    while not fits(e):
        e += 1
    return e


def _coarser(part, exponent: int):
    """Buckets of one histogram at a greater width: (exponent, bucket, n, total)."""
    e, bucket, n, total = part
    bucket, at = np.unique(bucket >> (exponent - e), return_inverse=True)
    return exponent, bucket, np.bincount(at, n, len(bucket)).astype(np.int64), np.bincount(at, total, len(bucket))


def one_pass_histogram(df: DataFrame, value: str, keys=(), buckets: int = 1024) -> DataFrame:
    """Histogram per key in a single scan: bucket, n, mean, width.

    Buckets are as wide as a power of two and lie at its multiples, so a histogram is made
    coarser by merging neighbours, and any two are merged at the wider width. Tasks double the
    width as their values spread; at the end a key has the narrowest buckets that hold its range
    in at most ``buckets``, between half and all of them where values differ by more than rounding,
    whatever the order and partitions of the rows. Only the tasks' histograms are stored and
    shuffled, which makes this a Spark job; masked and infinite values are left out."""
    k = list(keys)
    fields = [df.schema[c] for c in k]
    schema = T.StructType(fields + [T.StructField("_e", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType()),
                                    T.StructField("_total", T.DoubleType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])

    def partial(batches):
        held = {}

        def flush():
            for key, (low, high, (e, bucket, n, total)) in held.items():
                size = len(bucket)
                yield pa.RecordBatch.from_pydict({**{f.name: [v] * size for f, v in zip(fields, key)}, "_e": [e] * size, "bucket": bucket, "n": n,
                                                  "_total": total, "_lo": [low] * size, "_hi": [high] * size}, schema=to_arrow_schema(schema))
            held.clear()

        for batch in batches:
            v = batch.column(len(k)).to_numpy(zero_copy_only=False).astype(float)
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(len(k))))) if k else [()] * len(v)
            number = {}
            at = np.array([number.setdefault(r, len(number)) for r in rows])
            order = np.argsort(at, kind="stable") if len(v) else np.empty(0, int)
            cuts = np.searchsorted(at[order], np.arange(1, len(number))) if len(v) else []
            for key, own in zip(number, np.split(v[order], cuts)):
                own = own[np.isfinite(own)]
                if not len(own):
                    continue
                low, high, parts = float(own.min()), float(own.max()), []
                if key in held:
                    low, high, parts = min(low, held[key][0]), max(high, held[key][1]), [held[key][2]]
                e = _exponent(low, high, buckets)
                parts = [_coarser(p, e) for p in parts] + [(e, np.floor(np.ldexp(own, -e)).astype(np.int64), np.ones(len(own), np.int64), own)]
                held[key] = low, high, _coarser((e, *(np.concatenate(x) for x in zip(*(p[1:] for p in parts)))), e)
            if len(held) > HELD_KEYS:
                yield from flush()
        yield from flush()

    values = df.select(*k, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    parts = stored(values.mapInArrow(partial, schema), "histograms")
    bounds = parts.groupBy(*k).agg(F.min("_lo").alias("_min"), F.max("_hi").alias("_max"))

    def fits(e):
        step = F.pow(F.lit(2.0), -e)
        return F.floor(F.col("_max") * step) - F.floor(F.col("_min") * step) < buckets
    def log2(v):
        return F.coalesce(F.floor(F.log2(F.nullif(v, F.lit(0.0)))), F.lit(NARROWEST))
    exact = log2(F.greatest(-F.col("_min"), F.col("_max"))) - 50        # at least as wide as in any task
    guess = F.greatest(F.lit(NARROWEST), exact, log2((F.col("_max") - F.col("_min")) / F.lit(float(buckets))) - 1).cast("int")
    bounds = bounds.withColumn("_g", guess)
    exponent = F.coalesce(*[F.when(fits(F.col("_g") + i), F.col("_g") + i) for i in range(5)])
    bounds = bounds.select(*k, exponent.alias("_f"))
    joined = attach(parts, bounds, k).withColumn("bucket", F.expr("shiftright(bucket, _f - _e)"))
    return joined.groupBy(*k, "_f", "bucket").agg(F.sum("n").alias("n"), (F.sum("_total") / F.sum("n")).alias("mean")).select(
        *k, "bucket", "n", "mean", F.pow(F.lit(2.0), F.col("_f")).alias("width"))


def otsu(df: DataFrame, value: str, keys=(), buckets: int = 255, out: str = "threshold", one_pass: bool = False) -> DataFrame:
    """Otsu threshold per key: the bucket mean at the split with the largest
    between-class variance, where the lower class holds the buckets before the split.
    The first of equal splits wins. Windows run over at most ``buckets`` rows per key.

    With ``one_pass`` the buckets are those of ``one_pass_histogram``: the values are read once
    instead of twice, and where one split is clearly the best the threshold moves by no more
    than one bucket of either kind, (max - min) / buckets or the width of two."""
    k = list(keys)
    h = one_pass_histogram(df, value, k, buckets) if one_pass else histogram(df, value, k, buckets)
    before = Window.partitionBy(*k).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*k)
    s = F.col("n") * F.col("mean")
    h = h.withColumns({"_an": F.coalesce(F.sum("n").over(before), F.lit(0)),
                       "_as": F.coalesce(F.sum(s).over(before), F.lit(0.0)),
                       "_n": F.sum("n").over(whole), "_s": F.sum(s).over(whole)})
    mean = F.col("_s") / F.col("_n")
    bn, bs = F.col("_n") - F.col("_an"), F.col("_s") - F.col("_as")
    def spread(count, total):
        d = total / F.nullif(count, F.lit(0)) - mean
        return F.coalesce(count * d * d, F.lit(0.0))
    h = h.withColumn("_bss", spread(F.col("_an"), F.col("_as")) + spread(bn, bs))
    return h.groupBy(*k).agg(F.max_by("mean", F.struct(F.col("_bss"), -F.col("bucket"))).alias(out))


def percentiles(df: DataFrame, value: str, points: dict[str, float], keys=(), accuracy: int = 10_000,
                splits: int = 1024) -> DataFrame:
    """Exact interpolated percentiles of a real-valued column per key, {output: p}.

    The built-in exact percentile keeps every distinct value of a group in one task, which fits
    the few stored integers of a cell but not the cells of a country. Here, at every size:
    a sketch brackets each percentile; rows are counted below, above and in ``splits`` equal
    parts of the bracket, with the neighbouring values outside; only the rows of the parts that
    hold a wanted rank are shuffled and ranked. A rank outside the bracket and its two
    neighbours would break the sketch's promise and raises an error. Keys and values are
    stored once, and so are the brackets (Spark jobs that run as the query is built)."""
    return _percentiles_of(stored(_values(df, value, keys), "values"), points, keys, accuracy, splits)


def with_percentiles(df: DataFrame, value: str, points: dict[str, float], aggs, keys=(), columns=()) -> DataFrame:
    """Aggregates of a group beside exact percentiles of one of its columns. What they need, ``value``
    and the other ``columns``, is stored once, so that what made it is not evaluated for each of them."""
    k = list(keys)
    base = stored(df.select(*k, value, *columns), "values")
    if _are_small(base, k):
        return base.groupBy(*k).agg(*aggs, *_sorted_percentiles(value, points))
    return base.groupBy(*k).agg(*aggs).join(_percentiles_of(_values(base, value, k), points, k), k, "left")


def _are_small(base: DataFrame, keys) -> bool:
    """Whether every key has few rows, as zones within a year have: then each is sorted by itself."""
    return bool(keys) and (base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= SORTED_ROWS


def _sorted_percentiles(value: str, points: dict[str, float]) -> list[Column]:
    """Exact percentiles in one aggregation that holds the values of a key; the same arithmetic as by brackets."""
    values = F.sort_array(F.collect_list(F.col(value).cast("double")))
    def at(p):
        place = F.lit(float(p)) * (F.size(values) - 1)
        lower, upper = (F.get(values, f(place).cast("int")) for f in (F.floor, F.ceil))
        return lower + (upper - lower) * (place - F.floor(place))
    return [at(p).alias(name) for name, p in points.items()]


def _values(df: DataFrame, value: str, keys) -> DataFrame:
    return df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())


def _percentiles_of(base: DataFrame, points: dict[str, float], keys=(), accuracy: int = 10_000, splits: int = 1024) -> DataFrame:
    k = list(keys)
    margin = 4.0 / accuracy
    edges = [q for p in points.values() for q in (max(p - margin, 0.0), min(p + margin, 1.0))]
    # a sketch depends on the order in which its parts are merged; the rows are placed twice and must see the same bracket
    sketch = stored(base.groupBy(*k).agg(F.percentile_approx("_v", edges, accuracy).alias("_b"), F.count("_v").alias("_n")), "brackets")
    at, low, high = F.element_at(F.array([F.lit(float(p)) for p in points.values()]), F.col("_i") + 1) * (F.col("_n") - 1), \
        F.element_at("_b", 2 * F.col("_i") + 1), F.element_at("_b", 2 * F.col("_i") + 2)
    part = F.floor((F.col("_v") - low) / F.nullif(high - low, F.lit(0)) * F.lit(splits))
    placed = (attach(base, sketch, k).withColumn("_i", F.explode(F.array([F.lit(i) for i in range(len(points))])))
              .withColumn("_g", F.when(F.col("_v") < low, -1).when(F.col("_v") > high, splits)
                          .otherwise(F.least(F.coalesce(part, F.lit(0)), F.lit(splits - 1))).cast("int")))
    order = Window.partitionBy(*k, "_i").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)     # splits + 2 rows at most
    parts = placed.groupBy(*k, "_i", "_g", "_n").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    parts = parts.withColumn("_cum", F.sum("_c").over(order)).withColumns({"_r0": F.floor(at) + 1, "_r1": F.ceil(at) + 1})
    holds = [(F.col(f"_r{e}") > F.col("_cum") - F.col("_c")) & (F.col(f"_r{e}") <= F.col("_cum")) for e in (0, 1)]
    wanted = parts.filter(holds[0] | holds[1]).withColumns({f"_r{e}": F.when(holds[e], F.col(f"_r{e}")) for e in (0, 1)})
    missed = F.raise_error(F.lit("percentile rank outside the sketch bracket")).cast("double")
    def neighbour(rank):
        known = (F.when((F.col("_g") < 0) & (rank == F.col("_cum")), F.col("_hi"))
                 .when((F.col("_g") == splits) & (rank == F.col("_cum") - F.col("_c") + 1), F.col("_lo")).otherwise(missed))
        return F.when(rank.isNotNull(), known)
    inner = F.col("_g").between(0, splits - 1)
    outside = wanted.filter(~inner).select(*k, "_i", neighbour(F.col("_r0")).alias("_x0"), neighbour(F.col("_r1")).alias("_x1"))
    inside = placed.filter(inner).join(wanted.select(*k, "_i", "_g", "_r0", "_r1", (F.col("_cum") - F.col("_c")).alias("_before")), [*k, "_i", "_g"])
    inside = inside.groupBy(*k, "_i", "_g", "_v", "_r0", "_r1", "_before").agg(F.count(F.lit(1)).alias("_c"))
    rank = F.col("_before") + F.sum("_c").over(Window.partitionBy(*k, "_i", "_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_rank", rank).groupBy(*k, "_i", "_g").agg(
        *[F.min(F.when(F.col("_rank") >= F.col(f"_r{e}"), F.col("_v"))).alias(f"_x{e}") for e in (0, 1)]).drop("_g")
    found = attach(found.unionByName(outside), sketch.select(*k, "_n"), k)
    def interpolated(i):
        lower, upper = (F.max(F.when(F.col("_i") == i, F.col(f"_x{e}"))) for e in (0, 1))
        return lower + (upper - lower) * F.max(F.when(F.col("_i") == i, at - F.floor(at)))
    return found.groupBy(*k).agg(*[interpolated(i).alias(name) for i, name in enumerate(points)])


def percentile_threshold(df: DataFrame, value: str, p: float, keys=(), out: str = "threshold") -> DataFrame:
    """Exact percentile per key. Equal neighbours interpolate to themselves, bit by bit."""
    return percentiles(df, value, {out: p}, keys)
