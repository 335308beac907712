"""Spatial keys as storage order, and zones as few ranges of such keys.

A zone is cut into squares of a quadtree until a budget is spent; the squares are ranges of a
key (Morton codes, or row-major cell ids) and become plain comparisons, which reach the scan
and skip files and row groups. The ranges cover a zone and may cover more, so the exact
predicate of the zone still follows."""
from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a coordinate in a Morton key; coordinates are shifted by half the range and may be negative.
BITS = 31
OUTSIDE, PARTIAL, INSIDE = range(3)
#: Zones whose shapes are cut one by one; larger tables of zones are covered by their common box.
MANY_ZONES = 10_000


@dataclass(frozen=True)
class Rectangle:
    """Edges included."""
    x0: float
    x1: float
    y0: float
    y1: float

    def box(self):
        return self.x0, self.x1, self.y0, self.y1

    def relate(self, x0, x1, y0, y1) -> int:
        if x1 < self.x0 or x0 > self.x1 or y1 < self.y0 or y0 > self.y1:
            return OUTSIDE
        return INSIDE if self.x0 <= x0 and x1 <= self.x1 and self.y0 <= y0 and y1 <= self.y1 else PARTIAL


@dataclass(frozen=True)
class Disc:
    cx: float
    cy: float
    r: float

    def box(self):
        return self.cx - self.r, self.cx + self.r, self.cy - self.r, self.cy + self.r

    def relate(self, x0, x1, y0, y1) -> int:
        near = math.hypot(max(x0 - self.cx, self.cx - x1, 0), max(y0 - self.cy, self.cy - y1, 0))
        far = math.hypot(max(self.cx - x0, x1 - self.cx), max(self.cy - y0, y1 - self.cy))
        return OUTSIDE if near > self.r else INSIDE if far <= self.r else PARTIAL


@dataclass(frozen=True)
class Corridor:
    """All points within ``buffer`` of the line from a to b."""
    ax: float
    ay: float
    bx: float
    by: float
    buffer: float

    def box(self):
        return (min(self.ax, self.bx) - self.buffer, max(self.ax, self.bx) + self.buffer,
                min(self.ay, self.by) - self.buffer, max(self.ay, self.by) + self.buffer)

    def relate(self, x0, x1, y0, y1) -> int:
        px, py, dx, dy = (x0 + x1) / 2, (y0 + y1) / 2, self.bx - self.ax, self.by - self.ay
        length = dx * dx + dy * dy
        t = 0 if not length else min(1, max(0, ((px - self.ax) * dx + (py - self.ay) * dy) / length))
        middle, half = math.hypot(px - self.ax - t * dx, py - self.ay - t * dy), math.hypot(x1 - x0, y1 - y0) / 2
        return OUTSIDE if middle > self.buffer + half else INSIDE if middle + half <= self.buffer else PARTIAL


@dataclass(frozen=True)
class Polygon:
    """Even-odd rule over the edges ((ax, ay, bx, by), ...)."""
    edges: tuple

    def box(self):
        xs, ys = [v for e in self.edges for v in e[::2]], [v for e in self.edges for v in e[1::2]]
        return min(xs), max(xs), min(ys), max(ys)

    def relate(self, x0, x1, y0, y1) -> int:
        inside = False
        px, py = (x0 + x1) / 2, (y0 + y1) / 2
        for ax, ay, bx, by in self.edges:
            if _crosses(ax, ay, bx, by, x0, x1, y0, y1):
                return PARTIAL
            if (ay > py) != (by > py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
                inside = not inside
        return INSIDE if inside else OUTSIDE


def _crosses(ax, ay, bx, by, x0, x1, y0, y1) -> bool:
    """Whether the segment meets the box: what the box's four sides leave of it is not empty."""
    low, high = 0.0, 1.0
    for p, d, a, b in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
        if d == 0:
            if not a <= p <= b:
                return False
        else:
            enter, leave = sorted(((a - p) / d, (b - p) / d))
            low, high = max(low, enter), min(high, leave)
    return low <= high


def _spread(v: Column) -> Column:
    """The lower bits of v with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x="x", y="y") -> Column:
    """Interleaved bits of two whole coordinates between -2**30 and 2**30 as one BIGINT."""
    half = F.lit(1 << (BITS - 1))
    a, b = ((F.col(c) if isinstance(c, str) else c).cast("long") + half for c in (x, y))
    return _spread(a).bitwiseOR(F.shiftleft(_spread(b), 1))


def _interleaved(x: int, y: int) -> int:
    x, y = x + (1 << (BITS - 1)), y + (1 << (BITS - 1))
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(BITS))


def squares(shapes: Iterable, budget: int) -> list[tuple[int, int, int]]:
    """Aligned squares (x, y, side) of cells that cover the shapes, about ``budget`` of them: the largest partial one is cut next."""
    shapes = list(shapes)
    boxes = [s.box() for s in shapes]
    if not boxes:
        return []
    low, high = min(min(b[0], b[2]) for b in boxes), max(max(b[1], b[3]) for b in boxes)
    side = 1 << max(0, math.ceil(math.log2(max(high - low, 1))))
    heap, done = [], []

    def put(x, y, side, candidates):
        known = [(s.relate(x, x + side - 1, y, y + side - 1), s) for s in candidates]
        if any(k == INSIDE for k, _ in known) or (side == 1 and any(k for k, _ in known)):
            done.append((x, y, side))
        elif rest := [s for k, s in known if k == PARTIAL]:
            heapq.heappush(heap, (-side, x, y, len(done), rest))

    for x in range(math.floor(low) // side * side, math.floor(high) + 1, side):
        for y in range(math.floor(low) // side * side, math.floor(high) + 1, side):
            put(x, y, side, shapes)
    while heap and len(heap) + len(done) < budget:
        size, x, y, _, rest = heapq.heappop(heap)
        for dx in (0, -size // 2):
            for dy in (0, -size // 2):
                put(x + dx, y + dy, -size // 2, rest)
    return done + [(x, y, -size) for size, x, y, _, _ in heap]


def merged(ranges: Iterable[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges, the closest of which are joined until ``most`` are left."""
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1], reverse=True)
        cuts = [0, *sorted(gaps[:most - 1]), len(out)]
        out = [[out[a][0], out[b - 1][1]] for a, b in zip(cuts, cuts[1:])]
    return [(a, b) for a, b in out]


def morton_ranges(shapes: Iterable, most: int = 32) -> list[tuple[int, int]]:
    """At most so many ranges of Morton keys that hold every cell of the shapes."""
    return merged(((_interleaved(x, y), _interleaved(x + side - 1, y + side - 1)) for x, y, side in squares(shapes, 8 * most)), most)


def row_ranges(shapes: Iterable, width: int, most: int = 32) -> list[tuple[int, int]]:
    """The same for cell_id = y * width + x, of grids that begin at cell (0, 0): a range per raster row, then the closest joined."""
    ranges = []
    for x, y, side in squares(shapes, 8 * most):
        a, b = max(x, 0), min(x + side - 1, width - 1)
        if a <= b and y + side > 0:
            top, bottom = max(y, 0), y + side - 1
            rows = range(top, bottom + 1) if bottom - top < 1024 else ()
            ranges += [(v * width + a, v * width + b) for v in rows] or [(top * width + a, bottom * width + b)]
    return merged(ranges, most)


def in_ranges(key: str, ranges: list[tuple[int, int]]) -> Column:
    """Whether the key lies in one of the ranges; comparisons of the column alone, so they are pushed down."""
    hits = [(F.col(key) >= F.lit(a)) & (F.col(key) <= F.lit(b)) for a, b in ranges] or [F.lit(False)]
    while len(hits) > 1:
        hits = [a | b for a, b in zip(hits[::2], hits[1::2])] + hits[len(hits) // 2 * 2:]
    return hits[0]


def near_zones(raster: DataFrame, shapes: Iterable, width: int, most: int = 32, key: str = "cell_id") -> DataFrame:
    """Rows of a raster whose cell ids lie in the ranges of the shapes; a semi-join with the zones' cells decides exactly."""
    return raster.filter(in_ranges(key, row_ranges(shapes, width, most)))


def shapes_of(zones: DataFrame, make: Callable, columns: list[str]) -> list:
    """Shapes of the zones of a table, for a cover. Zone tables are short; one of more than MANY_ZONES
    rows is not brought to the driver but covered by the common box of its shapes' boxes."""
    rows = zones.select(*columns).limit(MANY_ZONES + 1).collect()
    if len(rows) <= MANY_ZONES:
        return [make(*row) for row in rows]
    if make is Rectangle:
        return [Rectangle(*zones.agg(F.min(columns[0]), F.max(columns[1]), F.min(columns[2]), F.max(columns[3])).first())]
    if make is Disc:
        x, y, r = (F.col(c) for c in columns)
        return [Rectangle(*zones.agg(F.min(x - r), F.max(x + r), F.min(y - r), F.max(y + r)).first())]
    ax, ay, bx, by, b = (F.col(c) for c in columns)
    return [Rectangle(*zones.agg(F.min(F.least(ax, bx) - b), F.max(F.greatest(ax, bx) + b), F.min(F.least(ay, by) - b), F.max(F.greatest(ay, by) + b)).first())]


def write_in_key_order(df: DataFrame, path: str, key: str = "zkey", row_group_bytes: int | None = None) -> None:
    """Parquet sorted by the Morton key of x and y, stored as column ``key``: files and row groups hold neighbouring cells."""
    rows = df.withColumn(key, morton()).repartitionByRange(key).sortWithinPartitions(key)
    writer = rows.write.mode("overwrite")
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(path)
