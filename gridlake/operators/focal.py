"""Neighbourhood operators.

Radius-1 operators are range windows along rows and columns: a window holds one
raster row or column, three shuffles carry each cell once, and no neighbour list
is exploded. Wider kernels cut the grid into tiles with a halo: every cell goes
to the one to four tiles that need it, a tile is one bounded dense array, and
numpy runs the kernel. Both work on sparse grids and never depend on how many
cells share a key.
"""
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def coarsen(df: DataFrame, k: int, keys=(), aggs=()) -> DataFrame:
    """Group k x k blocks: cx = floor(x / k), cy = floor(y / k)."""
    block = {"cx": F.floor(F.col("x") / F.lit(k)).cast("int"), "cy": F.floor(F.col("y") / F.lit(k)).cast("int")}
    return df.withColumns(block).groupBy(*keys, "cx", "cy").agg(*aggs)


def _row(keys, reach):
    return Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-reach, reach)


def _column(keys, reach):
    return Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-reach, reach)


def _cross(df: DataFrame, outs: dict[str, str], keys, agg, pick, row_first: bool) -> DataFrame:
    """outs maps an output name to its value column; all values share each window pass."""
    first, second = (_row, _column) if row_first else (_column, _row)
    df = df.withColumns({f"_p_{o}": agg(v).over(first(keys, 1)) for o, v in outs.items()})
    df = df.withColumns({f"_q_{o}": agg(v).over(second(keys, 1)) for o, v in outs.items()})
    both = {o: F.when(F.col(v).isNotNull(), pick(F.col(f"_p_{o}"), F.col(f"_q_{o}"))) for o, v in outs.items()}
    return df.withColumns(both).drop(*[f"_{k}_{o}" for o in outs for k in "pq"])


def focal_min(df: DataFrame, value: str, keys=(), out: str = "eroded") -> DataFrame:
    """Minimum over the cell and its four neighbours; masked neighbours are ignored."""
    return _cross(df, {out: value}, keys, F.min, F.least, row_first=True)


def focal_max(df: DataFrame, value: str, keys=(), out: str = "dilated", row_first: bool = True) -> DataFrame:
    """Maximum over the cell and its four neighbours; masked neighbours are ignored."""
    return _cross(df, {out: value}, keys, F.max, F.greatest, row_first=row_first)


def openings(df: DataFrame, outs: dict[str, str], keys=()) -> DataFrame:
    """Erosion then dilation of several masks at once: {output: value}. Three shuffles in all,
    whatever the number of masks; the dilation starts along columns, where the erosion ended."""
    eroded = _cross(df, {f"_e_{o}": v for o, v in outs.items()}, keys, F.min, F.least, row_first=True)
    return _cross(eroded, {o: f"_e_{o}" for o in outs}, keys, F.max, F.greatest, row_first=False).drop(*[f"_e_{o}" for o in outs])


def opening(df: DataFrame, value: str, keys=(), out: str = "opened") -> DataFrame:
    return openings(df, {out: value}, keys)


def neighbour(value: str, dx: int = 0, dy: int = 0, keys=()) -> Column:
    """Value of the cell at exactly one offset along a row or a column, else NULL."""
    if dy == 0:
        w = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(dx, dx)
    elif dx == 0:
        w = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(dy, dy)
    else:
        raise ValueError("offset must lie on one axis")
    return F.max(value).over(w)


def slope_degrees(df: DataFrame, value: str, cell_m: float, keys=(), out: str = "slope") -> DataFrame:
    """Slope by central differences; NULL where one of the four neighbours is missing."""
    df = df.withColumn("_gx", (neighbour(value, 1, 0, keys) - neighbour(value, -1, 0, keys)) / F.lit(2.0 * cell_m))
    df = df.withColumn("_gy", (neighbour(value, 0, 1, keys) - neighbour(value, 0, -1, keys)) / F.lit(2.0 * cell_m))
    g = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    return df.withColumn(out, F.degrees(F.atan(g))).drop("_gx", "_gy")


def sobel_magnitude(df: DataFrame, value: str, keys=(), out: str = "gradient") -> DataFrame:
    """Magnitude of the 3 x 3 Sobel gradient; NULL where the neighbourhood is incomplete."""
    left, right = neighbour(value, -1, 0, keys), neighbour(value, 1, 0, keys)
    df = df.withColumns({"_d": right - left, "_s": left + F.lit(2.0) * F.col(value) + right})
    up, down = neighbour("_d", 0, -1, keys), neighbour("_d", 0, 1, keys)
    gx = up + F.lit(2.0) * F.col("_d") + down
    gy = neighbour("_s", 0, -1, keys) - neighbour("_s", 0, 1, keys)
    df = df.withColumns({"_gx": gx, "_gy": gy})
    return (df.withColumn(out, F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))
            .drop("_d", "_s", "_gx", "_gy"))


def apply_tiled(df: DataFrame, value: str, radius: int, outputs, kernel: Callable, keys=(),
                tile: int | None = None, tasks: int | None = None, rows_too: bool = False) -> DataFrame:
    """Run ``kernel(array) -> {output: array}`` on tiles with a halo, in ``tasks`` partitions if given.

    ``array`` is the (tile + 2 radius)^2 block with NaN for missing cells; with ``rows_too`` the kernel
    also gets a block that is true where a cell has a row, as its value may be NULL. Outputs are
    tile x tile. Result: the input rows plus one DOUBLE column per output. A block is bounded by
    its side, not by the data; beyond a radius of some 500 cells use ``coarsen`` first."""
    tile = tile or max(64, min(2 * radius, 1024))
    fields = df.schema.fields
    names = [f.name for f in fields]
    schema = T.StructType(fields + [T.StructField(o, T.DoubleType()) for o in outputs])

    def reach(axis):
        low = F.floor((F.col(axis) - F.lit(radius)) / F.lit(tile)).cast("int")
        high = F.floor((F.col(axis) + F.lit(radius)) / F.lit(tile)).cast("int")
        return F.explode(F.sequence(low, high))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ix = pdf["x"].to_numpy() - int(pdf["_tx"].iloc[0]) * tile + radius
        iy = pdf["y"].to_numpy() - int(pdf["_ty"].iloc[0]) * tile + radius
        block = np.full((tile + 2 * radius, tile + 2 * radius), np.nan)
        block[iy, ix] = pdf[value].to_numpy(dtype=float, na_value=np.nan)
        here = np.zeros(block.shape, bool)
        here[iy, ix] = True
        core = (ix >= radius) & (ix < radius + tile) & (iy >= radius) & (iy < radius + tile)
        rows = pdf.loc[core, names].copy()
        if len(rows):
            for name, array in (kernel(block, here) if rows_too else kernel(block)).items():
                rows[name] = array[iy[core] - radius, ix[core] - radius]
        else:
            rows = rows.reindex(columns=names + list(outputs))
        return rows

    spread = df.withColumn("_tx", reach("x")).withColumn("_ty", reach("y"))
    if tasks is not None:
        spread = spread.repartition(tasks, *keys, "_tx", "_ty")
    return spread.groupBy(*keys, "_tx", "_ty").applyInPandas(run, schema)


def _disc_sum(block: np.ndarray, radius: int) -> np.ndarray:
    """Sum over dx^2 + dy^2 <= r^2 by row prefix sums, one pass per row of the disc."""
    n = block.shape[0] - 2 * radius
    prefix = np.concatenate([np.zeros((block.shape[0], 1)), np.cumsum(block, axis=1)], axis=1)
    out = np.zeros((n, n))
    for dy in range(-radius, radius + 1):
        w = int(np.floor(np.sqrt(radius * radius - dy * dy)))
        rows = prefix[radius + dy:radius + dy + n]
        out += rows[:, radius + w + 1:radius + w + 1 + n] - rows[:, radius - w:radius - w + n]
    return out


def disc_kernel(df: DataFrame, value: str, radius: int, keys=(), sum_out="disc_sum", count_out="disc_count",
                tile: int | None = None, tasks: int | None = None) -> DataFrame:
    """Sum and count of unmasked cells within ``radius`` cells of every cell. Integer
    inputs stay exact; the mean is sum / count. The block is shifted by a whole number
    near its mean, which keeps the prefix sums of real values small and precise."""
    def kernel(block):
        seen = ~np.isnan(block)
        shift = float(np.rint(block[seen].mean())) if seen.any() else 0.0
        count = _disc_sum(seen.astype(float), radius)
        return {sum_out: _disc_sum(np.where(seen, block - shift, 0.0), radius) + shift * count, count_out: count}
    return apply_tiled(df, value, radius, [sum_out, count_out], kernel, keys, tile, tasks)


def disc_mean(sum_col="disc_sum", count_col="disc_count") -> Column:
    return F.col(sum_col) / F.nullif(F.col(count_col), F.lit(0.0))


def _gaussian(radius: int, sigma: float | None) -> Callable:
    """Kernel of the Gaussian mean; its result is smaller by ``radius`` on every side."""
    s = sigma or radius / 2.0
    weights = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2.0 * s * s))

    def smooth(a):
        n = a.shape[0] - 2 * radius
        rows = sum(w * a[:, i:i + n] for i, w in enumerate(weights))
        return sum(w * rows[i:i + n] for i, w in enumerate(weights))

    def mean(block):
        seen = ~np.isnan(block)
        total, weight = smooth(np.where(seen, block, 0.0)), smooth(seen.astype(float))
        return np.divide(total, weight, out=np.full_like(total, np.nan), where=weight > 0)
    return mean


def gaussian_mean(df: DataFrame, value: str, radius: int, keys=(), out="smooth", sigma: float | None = None,
                  tile: int | None = None) -> DataFrame:
    """Gaussian focal mean over the (2r+1)^2 square, sigma r/2 unless given, weights
    renormalised over unmasked cells."""
    mean = _gaussian(radius, sigma)
    return apply_tiled(df, value, radius, [out], lambda block: {out: mean(block)}, keys, tile)


def gaussian_gradient(df: DataFrame, value: str, radius: int, keys=(), out="gradient", sigma: float | None = None,
                      tile: int | None = None) -> DataFrame:
    """``sobel_magnitude`` of ``gaussian_mean``, to the bit, in one pass over tiles whose halo is one cell wider."""
    mean = _gaussian(radius, sigma)

    def kernel(block, here):
        s = np.where(here[radius:-radius, radius:-radius], mean(block), np.nan)
        left, right = s[:, :-2], s[:, 2:]
        across, along = right - left, left + 2.0 * s[:, 1:-1] + right
        gx = across[:-2] + 2.0 * across[1:-1] + across[2:]
        gy = along[:-2] - along[2:]
        return {out: np.sqrt(gx * gx + gy * gy)}
    return apply_tiled(df, value, radius + 1, [out], kernel, keys, tile, rows_too=True)


def texture_entropy(df: DataFrame, value: str, keys=(), out="entropy", tile: int | None = None) -> DataFrame:
    """Co-occurrence entropy of the 3 x 3 window, mean of the four directions.

    Per direction: -sum p ln p over the ordered value pairs whose both cells are
    unmasked; written over pairs i this is -(1/n) sum ln(c_i / n)."""
    steps = ((0, 1), (1, 0), (1, 1), (1, -1))

    def kernel(block):
        n = block.shape[0] - 2
        cell = {(dy, dx): block[1 + dy:1 + dy + n, 1 + dx:1 + dx + n]
                for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
        directions = []
        for sy, sx in steps:
            pairs = [(cell[a], cell[a[0] + sy, a[1] + sx]) for a in cell if (a[0] + sy, a[1] + sx) in cell]
            valid = [~np.isnan(a) & ~np.isnan(b) for a, b in pairs]
            count = sum(v.astype(float) for v in valid)
            total = np.zeros((n, n))
            for (a, b), v in zip(pairs, valid):
                same = sum(((a == c) & (b == d)).astype(float) for c, d in pairs)
                total += np.where(v, np.log(np.where(v, same, 1.0) / np.where(count > 0, count, 1.0)), 0.0)
            directions.append(np.where(count > 0, -total / np.where(count > 0, count, 1.0), np.nan))
        stack = np.stack(directions)
        known = ~np.isnan(stack)
        number = known.sum(axis=0)
        mean = np.where(number > 0, np.where(known, stack, 0.0).sum(axis=0) / np.maximum(number, 1), np.nan)
        return {out: np.where(np.isnan(cell[0, 0]), np.nan, mean)}
    return apply_tiled(df, value, 1, [out], kernel, keys, tile)
