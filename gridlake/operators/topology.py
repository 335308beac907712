"""Connected patches and distances.

Both cut the raster into tiles: a tile is one bounded task, and only what tiles must know of
each other, touching pairs of patches or outlines of set cells, is joined between them."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.session import stored, stored_with, tasks_for

#: Cells along the side of a tile.
TILE = 256


def _tiled(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"_tx": F.floor(F.col("x") / F.lit(tile)).cast("long"), "_ty": F.floor(F.col("y") / F.lit(tile)).cast("long")})


def _state(key_columns) -> dict:
    """Figures that tell one edge set from another."""
    return {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64(*key_columns, "a", "b").cast("decimal(38,0)"))}


def _star_contraction(edges: DataFrame, keys) -> DataFrame:
    """Alternate large-star and small-star (Kiveris et al. 2014) until the edge set is stable.

    The minimum per node is a partial aggregate joined back on the node, so a giant
    component's centre is one skewed join key, which adaptive execution splits. A round is
    one job: its edges are stored, and their number and hash are observed on the way."""
    k = list(keys)
    edges, state = stored_with(edges.select(*k, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "touching", **_state(k))
    while state["n"]:
        both = edges.unionByName(edges.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*k, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, k + ["a"]).filter(F.col("b") > F.col("a"))
                 .select(*k, F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy(*k, "a").agg(F.min("b").alias("m"))
        small = large.join(low, k + ["a"])
        edges, after = stored_with(small.select(*k, "a", F.col("m").alias("b")).unionByName(
            small.filter(F.col("b") != F.col("m")).select(*k, F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "touching", **_state(k))
        if after == state:
            break
        state = after
    return edges


def _united(cell_id: np.ndarray, x: np.ndarray, y: np.ndarray, neighbours: int) -> np.ndarray:
    """The smallest cell_id of each cell's patch within one tile: hooking of roots and pointer jumping over arrays."""
    x, y = x - x.min(), y - y.min()
    at = np.full((int(y.max()) + 1, int(x.max()) + 1), -1)
    order = np.argsort(cell_id, kind="stable")      # the smaller the position, the smaller the cell_id
    at[y[order], x[order]] = np.arange(len(order))
    pairs = [(at[:, 1:], at[:, :-1]), (at[1:], at[:-1])]
    if neighbours == 8:
        pairs += [(at[1:, 1:], at[:-1, :-1]), (at[1:, :-1], at[:-1, 1:])]
    both = [(p >= 0) & (q >= 0) for p, q in pairs]
    a = np.concatenate([p[m] for (p, _), m in zip(pairs, both)])
    b = np.concatenate([q[m] for (_, q), m in zip(pairs, both)])
    root = np.arange(len(order))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return cell_id[order][root[at[y, x]]]


def label_patches(cells: DataFrame, keys=(), neighbours: int = 4, tile: int = TILE) -> DataFrame:
    """Connected components of set cells. Adds ``label`` = smallest cell_id of the patch.

    First every tile labels its own patches, then patches that touch across a border are
    contracted: the iteration works on pairs of patches at borders, not on cells, and a
    raster of one tile needs none. Cells that stand twice get one label; no size cap.
    The labelled cells are stored once, for what made them would otherwise run twice, so
    this is a Spark job."""
    if neighbours not in (4, 8):
        raise ValueError("neighbours must be 4 or 8")
    k = list(keys)
    fields = [f for f in cells.schema.fields if f.name != "label"]
    names = [f.name for f in fields]
    local = T.StructType(fields + [T.StructField("_patch", T.LongType())])

    def within(table: pa.Table) -> pa.Table:
        own = _united(*(table[c].to_numpy().astype(np.int64) for c in ("cell_id", "x", "y")), neighbours)
        return table.select(names).append_column("_patch", pa.array(own))

    patches = stored(_tiled(cells.select(*names), tile).groupBy(*k, "_tx", "_ty").applyInArrow(within, local), "patches")
    rest = {c: F.pmod(F.col(c), F.lit(tile)) for c in "xy"}
    border = [c == F.lit(v) for c in rest.values() for v in (0, tile - 1)]
    edge = patches.filter(border[0] | border[1] | border[2] | border[3]).select(*k, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_patch").alias("a"))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if neighbours == 8 else [])
    shifted = edge.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])))
    shifted = shifted.select(*k, (F.col("_x") + F.col("_d.dx")).cast(cells.schema["x"].dataType).alias("_x"),
                             (F.col("_y") + F.col("_d.dy")).cast(cells.schema["y"].dataType).alias("_y"), F.col("a").alias("b"))
    touching = edge.join(shifted, k + ["_x", "_y"]).filter("a <> b").select(*k, "a", "b")
    roots = _star_contraction(touching, k).select(*k, F.col("a").alias("_patch"), F.col("b").alias("_root"))
    return patches.join(roots, k + ["_patch"], "left").withColumn("label", F.coalesce("_root", "_patch")).drop("_root", "_patch")


def patch_sizes(labelled: DataFrame, keys=()) -> DataFrame:
    """Cells per patch as one aggregate row per label."""
    return labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("patch_cells"))


def keep_by_size(labelled: DataFrame, low: int, high: int, keys=()) -> DataFrame:
    """Cells of patches holding low..high cells. The size is aggregated and joined back, so
    a giant patch never sits in one window partition."""
    k = list(keys)
    sizes = patch_sizes(labelled, k).filter(F.col("patch_cells").between(low, high))
    return labelled.join(sizes, k + ["label"])


def patch_table(labelled: DataFrame, keys=(), grid=None) -> DataFrame:
    """Area, centroid and bounding box per patch; with a grid also the centroid in degrees."""
    table = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("patch_cells"), F.sum("area_m2").alias("area_m2"),
        (F.sum("x") / F.count(F.lit(1))).alias("centroid_x"), (F.sum("y") / F.count(F.lit(1))).alias("centroid_y"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return table if grid is None else table.withColumns({"lon": grid.lon("centroid_x"), "lat": grid.lat("centroid_y")})


_ALL, _SET = [f"_{c}{e}" for c in "xy" for e in "01"], [f"_s{c}{e}" for c in "xy" for e in "01"]
_OUTLINES = ("_left", "_right", "_top", "_bottom")


def _outlines(x: np.ndarray, y: np.ndarray) -> list[bytes]:
    """The set cells that can be nearest to something beyond the left, right, upper and lower border:
    the outermost of each row and of each column, as pairs of 64-bit coordinates."""
    found = []
    for line, across in ((y, x), (x, y)):
        for order in (np.lexsort((across, line)), np.lexsort((-across, line))):
            first = order[np.flatnonzero(np.diff(line[order], prepend=line[order[0]] - 1))] if len(order) else order
            found.append(np.stack([x[first], y[first]], axis=1).astype("<i8").tobytes())
    return found


def _squared_in_tile(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Squared distance of every (x, y) to the nearest of the (sx, sy); both lie in one tile, whose dense form is bounded."""
    x0, y0 = x.min(), y.min()
    inside = np.full((int(y.max() - y0) + 1, int(x.max() - x0) + 1), False)
    inside[sy - y0, sx - x0] = True
    rows = np.arange(len(inside))[:, None]
    above = np.maximum.accumulate(np.where(inside, rows, -(1 << 20)), axis=0)
    below = np.minimum.accumulate(np.where(inside, rows, 1 << 20)[::-1], axis=0)[::-1]
    column = np.square(np.minimum(rows - above, below - rows).astype(np.int64))
    best, width = column.copy(), column.shape[1]
    for d in range(1, width):
        np.minimum(best[:, d:], column[:, :width - d] + d * d, out=best[:, d:])
        np.minimum(best[:, :width - d], column[:, d:] + d * d, out=best[:, :width - d])
    return best[y - y0, x - x0]


def _pruned(pairs: DataFrame, tile_key, cap: int | None) -> DataFrame:
    """Pairs of a tile and a box of set cells that can hold the nearest one for some cell of the tile: no farther at its
    best than another box at its worst, and not beyond the clamp."""
    low = far = F.lit(0).cast("long")
    for c in "xy":
        q0, q1, s0, s1 = (F.col(f"_{p}{c}{e}") for p in ("", "s") for e in "01")
        gap = F.greatest(s0 - q1, q0 - s1, F.lit(0).cast("long"))
        reach = F.greatest(q1 - s0, s1 - q0)
        low, far = low + gap * gap, far + reach * reach
    pairs = pairs.withColumns({"_low": low, "_far": far})
    pairs = pairs if cap is None else pairs.filter(F.col("_low") <= cap * cap)
    return pairs.withColumn("_far", F.min("_far").over(Window.partitionBy(*tile_key))).filter("_low <= _far").drop("_low", "_far")


def distance_to_set(df: DataFrame, mask: str, keys=(), out: str = "distance", cap: int | None = None, tile: int = 64) -> DataFrame:
    """Euclidean distance in cells to the nearest cell with mask = 1 of the same key; exact, also on sparse rasters.

    One pass summarises every tile: the boxes of its cells and of its set cells and the outlines
    of the latter. A pyramid of these boxes is descended per tile, keeping only what may hold a
    nearest set cell, so empty space is never visited. Each tile then meets the outlines that
    are left. ``cap`` is a clamp distance in cells and also stands for "no set cell"; without a
    cap that case is NULL. The summaries are stored, which makes this a Spark job."""
    k = list(keys)
    names = [f.name for f in df.schema.fields if f.name != out]
    cells = _tiled(df.select(*names), tile)
    key_fields = [df.schema[c] for c in k]
    summary_schema = T.StructType(key_fields + [T.StructField(c, T.LongType()) for c in ["_tx", "_ty", *_ALL, *_SET, "_rows"]]
                                  + [T.StructField(c, T.BinaryType()) for c in _OUTLINES])

    def summary(table: pa.Table) -> pa.Table:
        x, y = (table[c].to_numpy().astype(np.int64) for c in "xy")
        here = np.flatnonzero(table["_set"].to_numpy())
        sx, sy = x[here], y[here]
        values = [table[c][0].as_py() for c in [*k, "_tx", "_ty"]] + [int(v) for c in (x, y) for v in (c.min(), c.max())]
        values += [int(v) for c in (sx, sy) for v in (c.min(), c.max())] if len(here) else [None] * 4
        columns = dict(zip(summary_schema.names, values + [len(x)] + _outlines(sx, sy)))
        return pa.table({c: pa.array([v], table.schema.field(c).type if c in k else pa.binary() if c in _OUTLINES else pa.int64()) for c, v in columns.items()})

    marked = cells.select(*k, "_tx", "_ty", "x", "y", F.coalesce(F.col(mask) == 1, F.lit(False)).alias("_set"))
    extent = {f"{side}_{c}": getattr(F, side)(f"_t{c}") for c in "xy" for side in ("min", "max")} | {"rows": F.sum("_rows")}
    tiles, seen = stored_with(marked.groupBy(*k, "_tx", "_ty").applyInArrow(summary, summary_schema), "tiles", **extent)
    left, top = seen["min_x"] or 0, seen["min_y"] or 0
    span = max((seen["max_x"] or 0) - left, (seen["max_y"] or 0) - top)
    levels = (span.bit_length() + 1) // 2       # four tiles along a side become one

    def node(c: str, shift: int):
        return F.shiftright(F.col(f"_t{c}") - F.lit(left if c == "x" else top), shift)

    def boxes(level: int) -> DataFrame:
        """Boxes of set cells of one level, named by their own place and by that of their parent."""
        place = {"_nx": node("x", 2 * level), "_ny": node("y", 2 * level)}
        of_set = tiles.filter("_sx0 is not null").withColumns(place)
        grown = of_set.groupBy(*k, "_nx", "_ny").agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in _SET])
        return grown.withColumns({"_px": F.shiftright("_nx", 2), "_py": F.shiftright("_ny", 2)})

    tile_key = [*k, "_tx", "_ty"]
    pairs = tiles.select(*tile_key, *_ALL).withColumns({"_nx": node("x", 2 * levels), "_ny": node("y", 2 * levels)})
    pairs = _pruned(pairs.join(boxes(levels).drop("_px", "_py"), [*k, "_nx", "_ny"]), tile_key, cap)
    for level in range(levels - 1, -1, -1):
        parents = pairs.drop("_px", "_py", *_SET).withColumnsRenamed({"_nx": "_px", "_ny": "_py"})
        pairs = _pruned(parents.join(boxes(level), [*k, "_px", "_py"]), tile_key, cap)
    own_x, own_y = node("x", 0), node("y", 0)
    side = F.when(own_x > F.col("_nx"), F.lit("_right")).when(own_x < F.col("_nx"), F.lit("_left")).when(own_y > F.col("_ny"), F.lit("_bottom")).otherwise(F.lit("_top"))
    pairs = pairs.filter((own_x != F.col("_nx")) | (own_y != F.col("_ny"))).select(*tile_key, "_nx", "_ny", side.alias("_side"))
    shapes = tiles.filter("_sx0 is not null").select(*k, node("x", 0).alias("_nx"), node("y", 0).alias("_ny"), *_OUTLINES)
    points = F.coalesce(*[F.when(F.col("_side") == c, F.col(c)) for c in _OUTLINES])
    others = pairs.join(shapes, [*k, "_nx", "_ny"]).select(*tile_key, points.alias("_points"))

    def nearest(table: pa.Table, others: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(names).append_column(out, pa.nulls(0, pa.float64()))
        x, y = (table[c].to_numpy().astype(np.int64) for c in "xy")
        here = np.flatnonzero(table["_set"].to_numpy())
        best = _squared_in_tile(x, y, x[here], y[here]) if len(here) else np.full(len(x), 1 << 62)
        far = np.frombuffer(b"".join(others["_points"].to_pylist()), "<i8").reshape(-1, 2)
        for a in range(0, len(far), 1024):
            some = far[a:a + 1024]
            near = np.square(x[:, None] - some[:, 0]) + np.square(y[:, None] - some[:, 1])
            best = np.minimum(best, near.min(axis=1))
        none = best == 1 << 62
        distance = np.sqrt(best.astype(float))
        distance = pa.array(distance, mask=none) if cap is None else pa.array(np.where(none, float(cap), np.minimum(distance, cap)))
        return table.select(names).append_column(out, distance)

    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, T.DoubleType())])
    tasks = tasks_for(df.sparkSession, seen["rows"] or 0)
    whole = cells.withColumn("_set", F.coalesce(F.col(mask) == 1, F.lit(False))).repartition(tasks, *tile_key)
    return whole.groupBy(*tile_key).cogroup(others.groupBy(*tile_key)).applyInArrow(nearest, schema)
