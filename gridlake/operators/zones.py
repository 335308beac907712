"""Zone membership: discs, rings, rectangles, corridors and polygons to (zone, cell) rows.

Every constructor lists the coarse tiles a zone's bounding box touches, joins
cells on that tile (an equi join) and applies the exact predicate to the
candidates. No cross join is involved and the work per tile is bounded by the
tile area times the zones that really overlap it.
"""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.model import RECTANGLES

TILE = 32


def _tile(v, tile):
    return F.floor(v / F.lit(tile)).cast("long")


def _candidates(cells: DataFrame, zones: DataFrame, xlo, xhi, ylo, yhi, tile) -> DataFrame:
    z = (zones.withColumn("_tx", F.explode(F.sequence(_tile(xlo, tile), _tile(xhi, tile))))
         .withColumn("_ty", F.explode(F.sequence(_tile(ylo, tile), _tile(yhi, tile)))))
    c = cells.withColumns({"_tx": _tile(F.col("x"), tile), "_ty": _tile(F.col("y"), tile)})
    return c.join(z, ["_tx", "_ty"]).drop("_tx", "_ty")


def in_rectangles(cells: DataFrame, zones: DataFrame, tile: int = TILE) -> DataFrame:
    """zones(x0, x1, y0, y1) in grid units, edges included."""
    c = F.col
    return (_candidates(cells, zones, c("x0"), c("x1"), c("y0"), c("y1"), tile)
            .filter(c("x").between(c("x0"), c("x1")) & c("y").between(c("y0"), c("y1"))))


def squared_distance(cx="cx", cy="cy") -> Column:
    dx, dy = F.col("x") - F.col(cx), F.col("y") - F.col(cy)
    return dx * dx + dy * dy


def in_discs(cells: DataFrame, discs: DataFrame, tile: int = TILE) -> DataFrame:
    """discs(cx, cy, r) in grid units; a cell belongs where its centre lies within r."""
    c = F.col
    return (_candidates(cells, discs, c("cx") - c("r"), c("cx") + c("r"), c("cy") - c("r"), c("cy") + c("r"), tile)
            .filter(squared_distance() <= c("r") * c("r")))


def named_discs(places: DataFrame, grid, least: int = 0) -> DataFrame:
    """Named places (lat, lon, radius_m) as discs (cx, cy, r) in cells of a grid; r is at least ``least``."""
    cx = F.round((F.col("lon") - F.lit(grid.lon0)) / F.lit(grid.step)).cast("int")
    cy = F.round((F.lit(grid.lat0) - F.col("lat")) / F.lit(grid.step)).cast("int")
    r = F.round(F.col("radius_m") / F.lit(grid.km_per_degree * 1000.0) / F.lit(grid.step)).cast("int")
    return places.withColumns({"cx": cx, "cy": cy, "r": F.greatest(r, F.lit(least))})


def in_rings(cells: DataFrame, discs: DataFrame, inner: Column, outer: Column, tile: int = TILE) -> DataFrame:
    """Cells with inner < distance <= outer."""
    d = discs.withColumns({"_in": inner, "_out": outer})
    c = F.col
    return (_candidates(cells, d, c("cx") - c("_out"), c("cx") + c("_out"),
                        c("cy") - c("_out"), c("cy") + c("_out"), tile)
            .filter((squared_distance() > c("_in") * c("_in")) & (squared_distance() <= c("_out") * c("_out")))
            .drop("_in", "_out"))


def segments(points: DataFrame, key: str, order: str, x="cx", y="cy") -> DataFrame:
    """Consecutive waypoints per line to (ax, ay, bx, by)."""
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(order)
    return (points.withColumns({"ax": F.col(x), "ay": F.col(y),
                                "bx": F.lead(x).over(w), "by": F.lead(y).over(w)})
            .filter(F.col("bx").isNotNull()))


def in_corridors(cells: DataFrame, segs: DataFrame, key, buffer: Column, tile: int = TILE) -> DataFrame:
    """Cells within ``buffer`` of any segment of a line; one row per (key, cell).

    The test is exact in integers: with d the segment vector, w the vector from a
    to the cell and t = w.d, the squared distance times |d|^2 is compared."""
    s = segs.withColumn("_b", buffer)
    c = F.col
    cand = _candidates(cells, s, F.least("ax", "bx") - c("_b"), F.greatest("ax", "bx") + c("_b"),
                       F.least("ay", "by") - c("_b"), F.greatest("ay", "by") + c("_b"), tile)
    dx, dy, wx, wy = c("bx") - c("ax"), c("by") - c("ay"), c("x") - c("ax"), c("y") - c("ay")
    vx, vy = c("x") - c("bx"), c("y") - c("by")
    length2, t, cross = dx * dx + dy * dy, wx * dx + wy * dy, wx * dy - wy * dx
    b2 = c("_b") * c("_b")
    near = (F.when(t <= 0, wx * wx + wy * wy <= b2)
            .when(t >= length2, vx * vx + vy * vy <= b2)
            .otherwise(cross * cross <= b2 * length2))
    keys = [key] if isinstance(key, str) else list(key)
    return cand.filter(near).select(*keys, "cell_id", "x", "y").distinct()


def in_polygons(cells: DataFrame, edges: DataFrame, key: str = "zone_id") -> DataFrame:
    """Even-odd rule by scan lines. edges(key, ax, ay, bx, by): every edge yields its crossing
    with each raster row it spans; sorted crossings of a (zone, row) pair up into inside
    intervals, which are expanded to cells and joined on (x, y). The work follows the number
    of inside cells, not cells times edges; a window holds the crossings of one row."""
    from pyspark.sql import Window
    c = F.col
    rows = (edges.filter(c("ay") != c("by"))
            .withColumn("y", F.explode(F.sequence(F.ceil(F.least("ay", "by")).cast("int"), F.floor(F.greatest("ay", "by")).cast("int"))))
            .filter((F.least("ay", "by") <= c("y")) & (c("y") < F.greatest("ay", "by"))))
    cross = rows.select(key, "y", (c("ax") + (c("y") - c("ay")) * (c("bx") - c("ax")) / (c("by") - c("ay"))).alias("_c"))
    w = Window.partitionBy(key, "y").orderBy("_c")
    spans = cross.withColumns({"_n": F.row_number().over(w), "_d": F.lead("_c").over(w)}).filter(c("_n") % 2 == 1)
    spans = spans.withColumns({"_a": F.ceil("_c").cast("int"), "_b": (F.ceil("_d") - 1).cast("int")}).filter(c("_a") <= c("_b"))
    inside = spans.select(key, "y", F.explode(F.sequence("_a", "_b")).alias("x"))
    return cells.join(inside, ["x", "y"]).select(key, "cell_id", "x", "y")


def coverage(cells: DataFrame, edges: DataFrame, key: str = "zone_id") -> DataFrame:
    """Cells that a polygon covers, each with the share that it covers: (key, cell_id, x, y, weight).

    edges(key, ax, ay, bx, by) are directed and close each ring; a hole runs against its outer
    ring. A cell is the unit square around its centre. Every edge is cut at the borders of rows,
    then of columns; a piece adds the area to its right within its cell, and its height to all
    cells further right of the row. Sums along the row give border cells their exact share and
    the runs between them a whole one, so the work follows the perimeter and the inside cells;
    a window holds the border cells of one row."""
    from pyspark.sql import Window
    c = F.col
    e = edges.filter(c("ay") != c("by")).select(key, *[(c(n).cast("double") + 0.5).alias(n) for n in ("ax", "ay", "bx", "by")])
    turn = e.groupBy(key).agg(F.negative(F.signum(F.sum((c("ax") + c("bx")) * (c("by") - c("ay"))))).alias("_turn"))
    slope = (c("bx") - c("ax")) / (c("by") - c("ay"))
    rows = e.withColumn("y", F.explode(F.sequence(F.floor(F.least("ay", "by")).cast("int"), (F.ceil(F.greatest("ay", "by")) - 1).cast("int"))))
    low, high = F.greatest(F.least("ay", "by"), c("y").cast("double")), F.least(F.greatest("ay", "by"), c("y") + 1.0)
    up = c("by") > c("ay")
    rows = rows.withColumns({"_y0": F.when(up, low).otherwise(high), "_y1": F.when(up, high).otherwise(low)})
    at = {f"_x{n}": F.when(c(f"_y{n}") == c("ay"), c("ax")).when(c(f"_y{n}") == c("by"), c("bx")).otherwise(c("ax") + (c(f"_y{n}") - c("ay")) * slope) for n in (0, 1)}
    rows = rows.withColumns(at)
    left, right = F.least("_x0", "_x1"), F.greatest("_x0", "_x1")
    parts = rows.withColumn("x", F.explode(F.sequence(F.floor(left).cast("int"), F.greatest(F.ceil(right) - 1, F.floor(left)).cast("int"))))
    # the piece within column x: its share of the height is its share of the width
    a, b = F.greatest(left, c("x").cast("double")), F.least(right, c("x") + 1.0)
    height = (c("_y1") - c("_y0")) * F.when(right > left, (b - a) / (right - left)).otherwise(1.0)
    parts = parts.select(key, "x", "y", height.alias("_h"), (height * (c("x") + 1.0 - (a + b) / 2)).alias("_a"))
    border = parts.groupBy(key, "y", "x").agg(F.sum("_h").alias("_h"), F.sum("_a").alias("_a"))
    along = Window.partitionBy(key, "y").orderBy("x")
    border = border.withColumns({"_sum": F.sum("_h").over(along), "_next": F.lead("x").over(along)})
    shares = F.array(F.struct(c("x").alias("_from"), c("x").alias("_to"), (c("_sum") - c("_h") + c("_a")).alias("_w")),
                     F.struct((c("x") + 1).alias("_from"), (c("_next") - 1).alias("_to"), c("_sum").alias("_w")))
    runs = border.select(key, "y", F.inline(shares)).filter((c("_from") <= c("_to")) & (F.abs("_w") > 1e-12))
    inside = runs.select(key, "y", F.explode(F.sequence("_from", "_to")).alias("x"), "_w").join(turn, key)
    return cells.join(inside, ["x", "y"]).select(key, "cell_id", "x", "y", F.least(c("_w") * c("_turn"), F.lit(1.0)).alias("weight"))


def with_halo(zone_cells: DataFrame, grid, reach: int = 2) -> DataFrame:
    """Ids of the cells of all zones and of their neighbours within ``reach`` steps, each once.

    Rasters are semi-joined with these before composites are made; an opening reaches two cells."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = (zone_cells.select("cell_id").distinct().select((F.col("cell_id") % grid.width).alias("_x"), F.floor(F.col("cell_id") / grid.width).alias("_y"))
            .withColumn("_x", F.explode(F.transform(steps, lambda d: F.col("_x") + d))).filter(F.col("_x").between(0, grid.width - 1))
            .withColumn("_y", F.explode(F.transform(steps, lambda d: F.col("_y") + d))).filter(F.col("_y") >= 0))
    return near.select((F.col("_y") * grid.width + F.col("_x")).alias("cell_id")).distinct()


def lookup(zones: DataFrame, level: str | None = None, names=None) -> DataFrame:
    """Zones of an admin level filtered by name or list of names; None means all."""
    if names is None:
        return zones
    names = [names] if isinstance(names, str) else list(names)
    return zones.filter(F.col(level).isin(names))


def study_rectangle(scope: str, grid) -> tuple[int, int, int, int]:
    """The study area's bounds in degrees as cells (x0, x1, y0, y1) whose centres lie inside: those of the scope if it has any, else the country's."""
    named = {n.strip(): tuple(map(float, (w, s, e, h))) for n, w, s, e, h in (line.split("|") for line in RECTANGLES.strip().splitlines())}
    west, south, east, north = named.get(scope, named["national"])
    close = 1e-9        # a centre on the bound is inside
    return (math.ceil((west - grid.lon0) / grid.step - close), math.floor((east - grid.lon0) / grid.step + close),
            math.ceil((grid.lat0 - north) / grid.step - close), math.floor((grid.lat0 - south) / grid.step + close))


def study_area(zones: DataFrame, scope: str, grid) -> DataFrame:
    """Scope to zone rows: national = all zones, district:X = second level,
    a first-level name = its zones, anything else = the rectangle of the study area."""
    if scope == "national":
        return zones
    if scope.startswith("district:"):
        return zones.filter(F.col("zone") == F.lit(scope.split(":", 1)[1]))
    x0, x1, y0, y1 = study_rectangle(scope, grid)
    named = zones.filter(F.upper("division") == F.lit(scope.upper()))
    rectangle = zones.sparkSession.range(1).select(
        F.lit(-1).alias("zone_id"), F.lit(scope).alias("zone"), F.lit("rectangle").alias("division"),
        *[F.lit(v).alias(c) for c, v in zip(("x0", "x1", "y0", "y1"), (x0, x1, y0, y1))])
    none = named.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() == 0
    return named.select(*rectangle.columns).unionByName(rectangle.filter(none))
