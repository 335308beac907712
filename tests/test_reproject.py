"""Projections against known points and each other; resampling against plain loops."""
import math
import random

import pytest
from pyspark.sql import functions as F

from gridlake.functions.projection import UTM, LonLat, Sinusoidal, WebMercator
from gridlake.model import Grid
from gridlake.operators.reproject import TargetGrid, reproject

PROJECTIONS = [LonLat(), UTM(46), UTM(45), UTM(23, south=True), Sinusoidal(), WebMercator()]


@pytest.mark.parametrize("projection", PROJECTIONS, ids=str)
def test_inverse_of_forward(spark, projection):
    rng = random.Random(2)
    middle = getattr(projection, "meridian", 0.0)
    points = [(middle + rng.uniform(-4, 4), rng.uniform(-79, 79)) for _ in range(60)] + [(middle, 0.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    x, y = projection.forward(F.col("lon"), F.col("lat"))
    lon, lat = projection.inverse(F.col("px"), F.col("py"))
    for r in df.withColumns({"px": x, "py": y}).withColumns({"blon": lon, "blat": lat}).collect():
        assert (r.blon, r.blat) == (pytest.approx(r.lon, abs=1e-8), pytest.approx(r.lat, abs=1e-8))


def test_known_points(spark):
    one = spark.createDataFrame([(93.0, 0.0, 90.4125, 23.8103)], "a double, b double, c double, d double")
    x, y = UTM(46).forward(F.col("a"), F.col("b"))
    assert tuple(one.select(x, y).first()) == (pytest.approx(500000.0), pytest.approx(0.0, abs=1e-6))
    x, y = UTM(46).forward(F.col("a"), F.lit(90.0) - 1e-9)
    assert one.select(y).first()[0] == pytest.approx(0.9996 * 10001965.729, abs=0.01)     # the quarter of a meridian
    x, y = WebMercator().forward(F.lit(180.0), F.lit(85.0511287798066))
    assert tuple(one.select(x, y).first()) == (pytest.approx(20037508.342789244), pytest.approx(20037508.342789, abs=1e-3))


def test_scale_is_that_of_the_grid(spark):
    """A short step north at the central meridian is 0.9996 of its length on the ellipsoid, and the same to the east."""
    one = spark.range(1)
    lat, step = 24.0, 1e-5
    e2 = (2 - 1 / 298.257223563) / 298.257223563
    s = math.sin(math.radians(lat))
    north, east = 6378137 * (1 - e2) / (1 - e2 * s * s) ** 1.5, 6378137 / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(lat))
    at = [one.select(*UTM(46).forward(F.lit(93.0 + dx), F.lit(lat + dy))).first() for dx, dy in ((0, 0), (step, 0), (0, step))]
    assert at[1][0] - at[0][0] == pytest.approx(0.9996 * east * math.radians(step), rel=1e-7)
    assert at[2][1] - at[0][1] == pytest.approx(0.9996 * north * math.radians(step), rel=1e-7)


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_resampling(spark, method):
    rng = random.Random(3)
    grid = Grid(20, lon0=90.0, lat0=25.0, step=0.1)
    cells = {(k, x, y): rng.choice([None, rng.randrange(100)]) for k in (1, 2) for x in range(20) for y in range(15) if rng.random() < 0.9}
    raster = spark.createDataFrame([(k, x, y, v) for (k, x, y), v in cells.items()], "k int, x int, y int, v int")
    target = TargetGrid(UTM(46), 200_000.0, 2_770_000.0, 7_000.0, 30, 25)
    got = {(r.k, r.cell_id): r.v for r in reproject(raster, "v", grid, target, ["k"], method).collect()}
    expected = {}
    for s in target.cells(spark).collect():
        fx, fy = (s.lon - 90.0) / 0.1, (25.0 - s.lat) / 0.1
        for k in (1, 2):
            if method == "nearest":
                at = (k, math.floor(fx + 0.5), math.floor(fy + 0.5))
                if at in cells:
                    expected[k, s.cell_id] = cells[at]
            else:
                x, y = math.floor(fx), math.floor(fy)
                near = [((k, x + dx, y + dy), (fx - x if dx else 1 - fx + x) * (fy - y if dy else 1 - fy + y)) for dx in (0, 1) for dy in (0, 1)]
                near = [(cells[p], w) for p, w in near if p in cells]
                if near:
                    seen = [(v, w) for v, w in near if v is not None]
                    expected[k, s.cell_id] = pytest.approx(sum(v * w for v, w in seen) / sum(w for _, w in seen)) if seen else None
    assert got == expected and len(got) > 200
    assert reproject(raster.limit(0), "v", grid, target, ["k"], method).count() == 0
