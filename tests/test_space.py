"""Neighbourhoods, patches, distances and zones against brute force on small sparse grids."""
import math
import random

import pytest
from pyspark.sql import functions as F

from gridlake.model import CITIES, RECTANGLES, RIVERS, Grid, zone_table
from gridlake.operators import focal, histogram, topology, zonal, zones
from gridlake.plans import water

RNG = random.Random(7)
# a sparse 23 x 17 grid: gaps, a missing row and a ragged end
CELLS = {(x, y): RNG.randrange(0, 50) for y in range(17) for x in range(23) if RNG.random() < 0.8 and y != 9 and not (y == 16 and x > 6)}
SET = {p for p in CELLS if RNG.random() < 0.45}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(y * 23 + x, x, y, v, int((x, y) in SET), 900) for (x, y), v in CELLS.items()]
    return spark.createDataFrame(rows, "cell_id long, x int, y int, v int, w int, area_m2 long").repartition(5).cache()


def by_cell(df, column):
    return {(r.x, r.y): r[column] for r in df.select("x", "y", column).collect()}


def near(p, reach):
    return [q for q in CELLS if reach(q[0] - p[0], q[1] - p[1])]


def test_focal_and_opening(grid):
    plus = lambda dx, dy: abs(dx) + abs(dy) <= 1
    erode = {p: min(int(q in SET) for q in near(p, plus)) for p in CELLS}
    opened = {p: max(erode[q] for q in near(p, plus)) for p in CELLS}
    assert by_cell(focal.focal_min(grid, "w"), "eroded") == erode
    assert by_cell(focal.opening(grid, "w"), "opened") == opened
    assert all(opened[p] <= int(p in SET) for p in CELLS)


@pytest.mark.parametrize("radius,tile", [(1, 4), (3, 5), (6, 64)])
def test_disc_kernel_any_tiling(grid, radius, tile):
    disc = lambda dx, dy: dx * dx + dy * dy <= radius * radius
    out = focal.disc_kernel(grid, "v", radius, tile=tile)
    assert by_cell(out, "disc_sum") == {p: float(sum(CELLS[q] for q in near(p, disc))) for p in CELLS}
    assert by_cell(out, "disc_count") == {p: float(len(near(p, disc))) for p in CELLS}


def test_gaussian_and_gradients(grid):
    out = by_cell(focal.gaussian_mean(grid, "v", 2, tile=6), "smooth")
    for p in CELLS:
        w = {q: math.exp(-((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2) / 2.0) for q in near(p, lambda dx, dy: max(abs(dx), abs(dy)) <= 2)}
        assert out[p] == pytest.approx(sum(CELLS[q] * k for q, k in w.items()) / sum(w.values()))
    sobel = by_cell(focal.sobel_magnitude(grid, "v"), "gradient")
    for p in CELLS:
        square = near(p, lambda dx, dy: max(abs(dx), abs(dy)) <= 1)
        if len(square) < 9:
            assert sobel[p] is None
        else:
            gx = sum(CELLS[q] * (q[0] - p[0]) * (2 - abs(q[1] - p[1])) for q in square)
            gy = sum(CELLS[q] * (p[1] - q[1]) * (2 - abs(q[0] - p[0])) for q in square)
            assert sobel[p] == pytest.approx(math.hypot(gx, gy))


def test_texture_entropy(grid):
    out = by_cell(focal.texture_entropy(grid.withColumn("k", F.col("v") % 3), "k", tile=7), "entropy")
    for p in CELLS:
        parts = []
        for sx, sy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
            square = near(p, lambda dx, dy: max(abs(dx), abs(dy)) <= 1)
            pairs = [(CELLS[q] % 3, CELLS[(q[0] + sx, q[1] + sy)] % 3) for q in square if (q[0] + sx, q[1] + sy) in square]
            if pairs:
                parts.append(-sum(pairs.count(k) / len(pairs) * math.log(pairs.count(k) / len(pairs)) for k in set(pairs)))
        assert (out[p] is None) == (not parts)
        if parts:
            assert out[p] == pytest.approx(sum(parts) / len(parts), abs=1e-12)


@pytest.mark.parametrize("neighbours, tile", [(4, 256), (8, 256), (4, 5), (8, 4), (4, 1), (8, 1)])
def test_patches(grid, neighbours, tile):
    step = (lambda dx, dy: abs(dx) + abs(dy) == 1) if neighbours == 4 else (lambda dx, dy: max(abs(dx), abs(dy)) == 1)
    left, expected = set(SET), {}
    while left:
        stack, patch = [left.pop()], []
        while stack:
            p = stack.pop()
            patch.append(p)
            for q in [q for q in left if step(q[0] - p[0], q[1] - p[1])]:
                left.remove(q)
                stack.append(q)
        label = min(y * 23 + x for x, y in patch)
        expected |= {p: label for p in patch}
    labelled = topology.label_patches(grid.filter("w = 1"), neighbours=neighbours, tile=tile)
    assert by_cell(labelled, "label") == expected
    sizes = {r.label: r.patch_cells for r in topology.patch_sizes(labelled).collect()}
    assert sum(sizes.values()) == len(SET)
    kept = by_cell(topology.keep_by_size(labelled, 3, 20), "label")
    assert kept == {p: v for p, v in expected.items() if 3 <= sizes[v] <= 20}


def test_long_snake_is_one_patch(spark):
    """A patch that winds through the grid needs many merges."""
    path = [(x, y) for y in range(0, 31, 2) for x in range(31)] + [(30 if y % 4 == 1 else 0, y) for y in range(1, 30, 2)]
    df = spark.createDataFrame([(y * 31 + x, x, y) for x, y in path], "cell_id long, x int, y int").withColumn("area_m2", F.lit(900))
    for tile in (256, 3):
        assert topology.label_patches(df, tile=tile).select("label").distinct().count() == 1


def test_spiral_over_many_tiles_takes_few_rounds(spark, monkeypatch):
    """Only pairs at borders are contracted, in far fewer rounds than the spiral has tiles on its way."""
    x = y = 64
    path, length, (dx, dy) = [(x, y)], 2, (1, 0)
    while length < 60:
        for _ in range(2):
            for _ in range(length):
                x, y = x + dx, y + dy
                path.append((x, y))
            dx, dy = -dy, dx
        length += 2
    df = spark.createDataFrame([(y * 128 + x, x, y) for x, y in path], "cell_id long, x int, y int")
    rounds, stored_with = [], topology.stored_with

    def counted(edges, name, **figures):
        back, seen = stored_with(edges, name, **figures)
        rounds.append(seen["n"])
        return back, seen
    monkeypatch.setattr(topology, "stored_with", counted)
    labels = {r.label for r in topology.label_patches(df, tile=8).select("label").distinct().collect()}
    assert labels == {min(y * 128 + x for x, y in path)}
    assert len(rounds) <= 10 and max(rounds) < len(path) / 3
    rounds.clear()
    topology.label_patches(df)
    assert rounds == [0]        # one tile: no pairs, no rounds


def test_patches_keep_columns_and_twins(spark):
    df = spark.createDataFrame([(5, 1, 1, "a", 7), (5, 1, 1, "b", 8), (9, 2, 1, None, 9), (40, 8, 1, "c", 1)], "cell_id long, x int, y int, label string, _d int")
    rows = topology.label_patches(df, tile=2).orderBy("_d")
    assert rows.columns == ["cell_id", "x", "y", "_d", "label"]
    assert [(r._d, r.label) for r in rows.collect()] == [(1, 40), (7, 5), (8, 5), (9, 5)]
    assert topology.label_patches(df.limit(0)).count() == 0


def test_patches_per_key_do_not_mix(spark):
    df = spark.createDataFrame([(k, y * 4 + x, x, y) for k in (1, 2) for x in range(4) for y in range(2) if (k, x) != (2, 1)],
                               "k int, cell_id long, x int, y int")
    labels = {(r.k, r.label) for r in topology.label_patches(df, ["k"]).collect()}
    assert labels == {(1, 0), (2, 0), (2, 2)}


@pytest.mark.parametrize("cap, tile", [(None, 64), (2, 64), (None, 3), (2, 3), (None, 1), (7, 5)])
def test_distance(grid, cap, tile):
    seeds = {p for p in SET if CELLS[p] > 40}
    marked = grid.withColumn("s", ((F.col("w") == 1) & (F.col("v") > 40)).cast("int"))
    expected = {p: min(math.dist(p, q) for q in seeds) for p in CELLS}
    out = by_cell(topology.distance_to_set(marked, "s", cap=cap, tile=tile), "distance")
    for p in CELLS:
        assert out[p] == pytest.approx(expected[p] if cap is None else min(cap, expected[p]))
        assert (out[p] == 0) == (p in seeds)


@pytest.mark.parametrize("tile", [8, 64])
def test_distance_over_empty_space(spark, tile):
    """Few cells, far apart and on both sides of the origin, several keys of which one has no set cell."""
    rng = random.Random(11)
    cells = [(k, n, rng.randrange(-3000, 3000) if n % 3 else rng.randrange(40), rng.randrange(-2000, 2000) if n % 3 else rng.randrange(40),
              rng.choice([0, 0, 0, 1, None]) if k < 3 else 0) for k in range(4) for n in range(150)]
    df = spark.createDataFrame(cells, "k int, cell_id long, x int, y long, s int")
    result = topology.distance_to_set(df, "s", ["k"], tile=tile)
    got = {(r.k, r.cell_id): r.distance for r in result.collect()}
    for k, n, x, y, _ in cells:
        near = [math.dist((x, y), (p, q)) for j, _, p, q, s in cells if j == k and s == 1]
        assert got[k, n] == (pytest.approx(min(near)) if near else None)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "sequence" not in plan        # empty space is not filled
    capped = {(r.k, r.cell_id): r.distance for r in topology.distance_to_set(df, "s", ["k"], cap=25, tile=tile).collect()}
    assert capped == {c: pytest.approx(25 if d is None else min(d, 25)) for c, d in got.items()}
    assert topology.distance_to_set(df.limit(0), "s").count() == 0


def test_zones_against_brute_force(spark, grid):
    cells = grid.select("cell_id", "x", "y")
    discs = spark.createDataFrame([(1, 5, 5, 4), (2, 20, 15, 30), (3, -9, 4, 2)], "disc_id int, cx int, cy int, r int")
    inside = {(r.disc_id, r.x, r.y) for r in zones.in_discs(cells, discs, tile=6).collect()}
    assert inside == {(d, x, y) for d, cx, cy, r in ((1, 5, 5, 4), (2, 20, 15, 30)) for x, y in CELLS if (x - cx) ** 2 + (y - cy) ** 2 <= r * r}
    shape = [(2, 1), (15, 3), (20, 14), (9, 8), (4, 15)]     # a concave polygon
    edges = [(7, *a, *b) for a, b in zip(shape, shape[1:] + shape[:1])]
    found = {(r.x, r.y) for r in zones.in_polygons(cells, spark.createDataFrame(edges, "zone_id int, ax int, ay int, bx int, by int")).collect()}

    def odd(x, y):
        return sum(1 for _, ax, ay, bx, by in edges if min(ay, by) <= y < max(ay, by) and x < ax + (y - ay) * (bx - ax) / (by - ay)) % 2 == 1
    assert found == {p for p in CELLS if odd(*p)}
    points = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (12, 4), (12, 14)])], "river int, n int, cx int, cy int")
    band = {(r.x, r.y) for r in zones.in_corridors(cells, zones.segments(points, "river", "n"), "river", F.lit(2), tile=4).collect()}

    def gap(p, a, b):
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))
        return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    assert band == {p for p in CELLS if min(gap(p, (0, 0), (12, 4)), gap(p, (12, 4), (12, 14))) <= 2}


def test_otsu_separates_two_groups_and_constant_band(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [1, 2, 2, 3] * 5 + [50, 51, 52] * 5] + [(2, 4.0)] * 3, "k int, v double")
    t = {r.k: r.threshold for r in histogram.otsu(df, "v", ["k"]).collect()}
    assert 3 < t[1] <= 50.5 and t[2] == 4.0
    assert histogram.otsu(df.filter("k = 1"), "v").first().threshold == t[1]


def test_otsu_vote_with_and_without_keys(spark):
    rows = [(1, float(g), float(100 - g), 50.0, 20.0) for g in range(100)]
    comp = spark.createDataFrame(rows, "yr int, green double, nir double, swir1 double, swir2 double")
    keyed = water.classify(comp, ["yr"], "otsu").agg(F.sum("water")).first()[0]
    assert 0 < keyed < 100 and keyed == water.classify(comp, [], "otsu").agg(F.sum("water")).first()[0]
    with pytest.raises(ValueError):
        water.classify(comp, [], "other")


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_percentiles_are_exact_with_ties_and_outliers(spark, accuracy):
    rng = random.Random(3)
    data = {1: [rng.gauss(0, 1) for _ in range(3000)] + [0.25] * 1500 + [1e9], 2: [5.0] * 400, 3: [1.0, 2.0, 4.0], 4: [7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [(1, None), (5, None)], "k int, v double").repartition(7)
    points = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "top": 1.0}
    rows = {r.k: r for r in histogram.percentiles(df, "v", points, ["k"], accuracy).collect()}
    assert set(rows) == {1, 2, 3, 4}
    for k, vs in data.items():
        vs = sorted(vs)
        for name, p in points.items():
            at = p * (len(vs) - 1)
            lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
            assert rows[k][name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12)
    assert histogram.percentiles(df.filter("k = 3"), "v", {"m": 0.5}).first().m == 2.0


def test_areas_and_coarsening(grid):
    total = grid.agg(F.sum("area_m2")).first()[0] / 1e6
    classes = zonal.area_by_class(grid.withColumn("c", F.col("v") % 3), "c", F.col("area_m2"), {0: "a", 1: "b", 2: "c", 9: "none"})
    areas = {r.class_name: r.area_km2 for r in classes.collect()}
    assert sum(areas.values()) == pytest.approx(total) and areas["none"] == 0.0
    coarse = focal.coarsen(grid, 5, aggs=[F.count(F.lit(1)).alias("n")])
    assert coarse.agg(F.sum("n")).first()[0] == len(CELLS)


def test_zone_tables_and_cell_area(spark):
    assert zone_table(spark, CITIES, "disc").count() == 10
    assert zone_table(spark, RECTANGLES, "rect").filter("west < east and south < north").count() == 9
    assert zone_table(spark, RIVERS, "river").select("zone").distinct().count() == 16
    g = Grid(width=10, lon0=88.0, lat0=24.0, step=0.01)
    area = spark.createDataFrame([(0,), (990,)], "cell_id long").select(g.area()).collect()
    assert area[0][0] == round((0.01 * 111320.0) ** 2 * math.cos(math.radians(24.0))) and area[1][0] > area[0][0]


def clipped_area(ring, x, y):
    """Area of a simple polygon within the unit square around (x, y), by clipping at its four sides."""
    for axis, bound, keep_below in ((0, x - 0.5, False), (0, x + 0.5, True), (1, y - 0.5, False), (1, y + 0.5, True)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            inside = [(v[axis] <= bound) if keep_below else (v[axis] >= bound) for v in (p, q)]
            if inside[0]:
                out.append(p)
            if inside[0] != inside[1]:
                s = (bound - p[axis]) / (q[axis] - p[axis])
                out.append(tuple(bound if k == axis else p[k] + s * (q[k] - p[k]) for k in (0, 1)))
        ring = out
    return abs(sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))) / 2


def test_coverage_of_slanted_polygons(spark):
    cells = spark.range(40 * 40).select(F.col("id").alias("cell_id"), (F.col("id") % 40).cast("int").alias("x"), F.floor(F.col("id") / 40).cast("int").alias("y"))
    rings = {1: [(2.25, 3.5), (30.1, 7.9), (25.0, 30.0), (9.3, 21.7)], 2: [(5.0, 5.0), (5.0, 9.0), (12.0, 9.0), (12.0, 5.0)],     # clockwise and not
             3: [(20.2, 20.2), (20.4, 20.3), (20.3, 20.4)], 4: [(1.5, 1.5), (3.5, 1.5), (3.5, 3.5), (1.5, 3.5)], 5: [(3.0, 33.3), (35.5, 33.4), (20.0, 38.0), (19.0, 34.0)]}
    edges = [(k, *p, *q) for k, ring in rings.items() for p, q in zip(ring, ring[1:] + ring[:1])]
    hole = [(15.0, 12.0), (15.0, 16.5), (18.2, 14.0)]       # in polygon 1 as a zone of its own ring direction
    got = {}
    for r in zones.coverage(cells, spark.createDataFrame(edges, "zone_id int, ax double, ay double, bx double, by double")).collect():
        assert (r.zone_id, r.x, r.y) not in got
        got[r.zone_id, r.x, r.y] = r.weight
    want = {(k, x, y): clipped_area(ring, x, y) for k, ring in rings.items() for x in range(40) for y in range(40)}
    for place, share in want.items():
        assert got.get(place, 0.0) == pytest.approx(share, abs=1e-9), place
    for k, ring in rings.items():
        closed = abs(sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))) / 2
        assert sum(w for (z, _, _), w in got.items() if z == k) == pytest.approx(closed, rel=1e-6)
    holed = [(1, *p, *q) for r in (rings[1], hole) for p, q in zip(r, r[1:] + r[:1])]
    turned = sum(r.weight for r in zones.coverage(cells, spark.createDataFrame(holed, "zone_id int, ax double, ay double, bx double, by double")).collect())
    area = [abs(sum(a * d - c * b for (a, b), (c, d) in zip(r, r[1:] + r[:1]))) / 2 for r in (rings[1], hole)]
    assert turned == pytest.approx(area[0] - area[1], rel=1e-9)
    values = cells.withColumns({"v": F.when(F.col("x") > 6, F.col("x")), "area_m2": F.lit(100)})
    row = zonal.weighted_stats(values, "v", zones.coverage(cells, spark.createDataFrame(edges[4:8], "zone_id int, ax double, ay double, bx double, by double"))).first()
    assert row.covered_m2 == pytest.approx(2800.0) and row["mean"] == pytest.approx((6 * 0 + sum(x * (0.5 if x == 12 else 1) for x in range(7, 13))) / 5.5)


@pytest.mark.parametrize("parts", [1, 7])
def test_one_pass_histogram_does_not_depend_on_the_order(spark, parts):
    rng = random.Random(parts)
    data = {1: [rng.gauss(0.2, 0.1) if rng.random() < 0.6 else rng.gauss(0.8, 0.05) for _ in range(3000)], 2: [5.0] * 9, 3: [-1e6, 1e-3, 3e7, 3e7 + 1],
            4: [float(rng.randrange(-9, 9)) for _ in range(500)], 5: [2.0 ** -30 * rng.randrange(3000) for _ in range(400)]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [(1, None), (6, None), (1, math.inf), (1, math.nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v double").repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = {(r.k, r.bucket): r for r in histogram.one_pass_histogram(df, "v", ["k"], 64).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    for k, vs in data.items():
        width = {r.width for (q, _), r in got.items() if q == k}
        assert len(width) == 1
        width = width.pop()
        spread = [math.floor(max(vs) / w) - math.floor(min(vs) / w) for w in (width, width / 2)]
        assert spread[0] < 64 and (spread[1] >= 64 or width == 2.0 ** histogram.NARROWEST)       # the narrowest that fits
        for b in {math.floor(v / width) for v in vs}:
            own = [v for v in vs if math.floor(v / width) == b]
            assert got[k, b].n == len(own) and got[k, b]["mean"] == pytest.approx(math.fsum(own) / len(own))
    assert {k for k, _ in got} == set(data)
    two, one = (histogram.otsu(df.filter("k = 1 and v < 9"), "v", ["k"], n, one_pass=p).first().threshold for n, p in ((255, False), (1024, True)))
    assert abs(two - one) <= (max(data[1]) - min(data[1])) / 255 + 2 * (max(data[1]) - min(data[1])) / 512
    assert histogram.otsu(df.filter("k = 1 and v < 9"), "v", one_pass=True).count() == 1 and histogram.one_pass_histogram(df.limit(0), "v", ["k"]).count() == 0
