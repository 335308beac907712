"""Key ranges of zones: they cover every cell, cover little else, and reach the scan."""
import math
import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import ranges as R

SHAPES = {
    "disc": R.Disc(20, 31, 9), "rectangle": R.Rectangle(3, 40, 50, 58), "corridor": R.Corridor(-12, 4, 50, 33, 2),
    "polygon": R.Polygon(((2, 1, 45, 9), (45, 9, 60, 44), (60, 44, 20, 25), (20, 25, 12, 45), (12, 45, 2, 1))), "point": R.Disc(7, 7, 0),
}


def inside(shape, x, y) -> bool:
    if isinstance(shape, R.Disc):
        return math.dist((x, y), (shape.cx, shape.cy)) <= shape.r
    if isinstance(shape, R.Rectangle):
        return shape.x0 <= x <= shape.x1 and shape.y0 <= y <= shape.y1
    if isinstance(shape, R.Corridor):
        dx, dy = shape.bx - shape.ax, shape.by - shape.ay
        t = min(1, max(0, ((x - shape.ax) * dx + (y - shape.ay) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - shape.ax - t * dx, y - shape.ay - t * dy) <= shape.buffer
    return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for ax, ay, bx, by in shape.edges) % 2 == 1


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("most", [1, 8, 64])
def test_ranges_cover_the_zone(name, most):
    shape = SHAPES[name]
    wanted = [(x, y) for x in range(-20, 70) for y in range(-20, 70) if inside(shape, x, y)]
    found = R.morton_ranges([shape], most)
    assert len(found) <= most and found == sorted(found) and all(a <= b for a, b in found)
    held = {(x, y) for x in range(-20, 70) for y in range(-20, 70) if any(a <= R._interleaved(x, y) <= b for a, b in found)}
    assert held >= set(wanted) and wanted
    if most == 64:
        assert len(held) <= 2 * len(wanted) + 40
    rows = R.row_ranges([shape], 64, most)
    assert len(rows) <= most and all(any(a <= y * 64 + x <= b for a, b in rows) for x, y in wanted if 0 <= x < 64 and y >= 0)


def test_key_in_spark_equals_the_plain_one(spark):
    rng = random.Random(1)
    cells = [(rng.randrange(-2 ** 30, 2 ** 30), rng.randrange(-2 ** 30, 2 ** 30)) for _ in range(200)] + [(0, 0), (-1, 0), (2 ** 30 - 1, -2 ** 30)]
    rows = spark.createDataFrame(cells, "x long, y int").select("x", "y", R.morton().alias("k")).collect()
    assert all(r.k == R._interleaved(r.x, r.y) for r in rows) and len({r.k for r in rows}) == len(set(cells))


def test_ranges_reach_the_scan_and_skip_row_groups(spark, tmp_path):
    cells = spark.range(512 * 512).select("id", (F.col("id") % 512).cast("int").alias("x"), F.floor(F.col("id") / 512).cast("int").alias("y"),
                                          F.sha2(F.col("id").cast("string"), 512).alias("load"))
    path = str(tmp_path / "cells")
    R.write_in_key_order(cells, path, row_group_bytes=1 << 18)
    disc = R.Disc(100, 300, 12)
    wanted = (F.col("x") - 100) * (F.col("x") - 100) + (F.col("y") - 300) * (F.col("y") - 300) <= 144
    read = spark.read.parquet(path)
    result = read.filter(R.in_ranges("zkey", R.morton_ranges([disc], 16))).filter(wanted)
    plan = result._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "Or(" in pushed and "GreaterThanOrEqual(" in pushed
    assert {r.id for r in result.collect()} == {r.id for r in cells.filter(wanted).collect()}
    scan = result._jdf.queryExecution().executedPlan()
    while scan.children().size() or scan.nodeName().startswith("Adaptive"):
        scan = scan.executedPlan() if scan.nodeName().startswith("Adaptive") else scan.children().apply(0)
    assert scan.metrics().get("numOutputRows").get().value() < 512 * 512 / 8


def test_many_and_no_zones(spark, monkeypatch):
    discs = spark.createDataFrame([(3, 4, 1), (50, 60, 2)], "cx int, cy int, r int")
    assert R.shapes_of(discs, R.Disc, ["cx", "cy", "r"]) == [R.Disc(3, 4, 1), R.Disc(50, 60, 2)]
    monkeypatch.setattr(R, "MANY_ZONES", 1)
    assert R.shapes_of(discs, R.Disc, ["cx", "cy", "r"]) == [R.Rectangle(2, 52, 3, 62)]
    rectangles = spark.createDataFrame([(1, 2, 3, 4), (0, 9, 5, 6)], "x0 int, x1 int, y0 int, y1 int")
    assert R.shapes_of(rectangles, R.Rectangle, ["x0", "x1", "y0", "y1"]) == [R.Rectangle(0, 9, 3, 6)]
    lines = spark.createDataFrame([(1, 2, 3, 4, 1), (9, 9, 5, 6, 2)], "ax int, ay int, bx int, by int, b int")
    assert R.shapes_of(lines, R.Corridor, ["ax", "ay", "bx", "by", "b"]) == [R.Rectangle(0, 11, 1, 11)]
    assert R.morton_ranges([]) == [] and spark.range(3).filter(R.in_ranges("id", [])).count() == 0
