"""Primitive operators (P-01 to P-41)."""
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlake.catalog.base import (DISC_CELLS, ZONE_CELLS, clamp as clamp_sql, nd, norm as norm_sql,
                                   opening_sql, r)
from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.functions import projection
from gridlake.model import Grid
from gridlake.operators import focal, histogram, ranges, temporal, topology, zonal, zones
from gridlake.operators.reproject import TargetGrid, reproject
from gridlake.session import shared_folder
from gridlake.sources.fixtures import GRID

c = F.col
XY = "CAST(cell_id % 64 AS INT) AS x, CAST(floor(cell_id/64) AS INT) AS y"


def yearly_mean(t, value="ndvi_dn"):
    """Per-cell yearly integer sum and count of a signal."""
    return t.signals.groupBy("cell_id", "yr").agg(F.sum(value).alias("s"), F.count(value).alias("n"))


def wet_cells(t):
    """A speckled mask: permanent water by occurrence."""
    return t.cells.select("cell_id", "x", "y", "area_m2", A.flag(c("occurrence") >= 50).alias("w"))


WET = "wet AS (SELECT cell_id, x, y, area_m2, CAST(occurrence>=50 AS INT) AS w FROM cells)"


def nearest_sql(mask, far=None, key=None):
    """Brute-force distance to the nearest set cell (of the same key); ``far`` stands for "no set cell anywhere"."""
    same = f" AND b.{key}=a.{key}" if key else ""
    found = f"(SELECT sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) FROM {mask} b WHERE b.w=1{same})"
    return found if far is None else f"coalesce({found},{far})"


PATCH_SQL = """
lab0 AS (SELECT {keys}cell_id, x, y, area_m2 FROM {src} WHERE w=1),
reach AS (SELECT {keys}cell_id AS a, cell_id AS b FROM lab0
  UNION SELECT {rkeys}r.a, n.cell_id FROM reach r JOIN lab0 m ON {on1}m.cell_id=r.b
  JOIN lab0 n ON {on2}{near}),
lab AS (SELECT {lkeys}l.cell_id, l.x, l.y, l.area_m2, min(reach.b) AS label FROM lab0 l
  JOIN reach ON {on3}reach.a=l.cell_id GROUP BY ALL)"""
NEAR4 = "abs(n.x-m.x)+abs(n.y-m.y)=1"
NEAR8 = "greatest(abs(n.x-m.x),abs(n.y-m.y))=1"


def patches_sql(src, near=NEAR4, key=""):
    k = f"{key}, " if key else ""
    return PATCH_SQL.format(
        src=src, near=near, keys=k, rkeys=f"r.{k}" if key else "", lkeys=f"l.{k}" if key else "",
        on1=f"m.{key}=r.{key} AND " if key else "", on2=f"n.{key}=m.{key} AND " if key else "",
        on3=f"reach.{key}=l.{key} AND " if key else "")


#: The test grid laid out in degrees, and a metric grid over it.
DEGREES = Grid(64, lon0=88.0, lat0=26.75, step=0.25)
UTM_TARGET = TargetGrid(projection.UTM(46), 100_000.0, 2_900_000.0, 25_000.0, 60, 30)


def spots_sql(target):
    """Where the cells of a UTM grid lie in the test grid, by the inverse series."""
    def series(name, f, g, coefficients):
        return "+".join(f"{k!r}*{f}({2 * j}*{name}){g.format(2 * j)}" for j, k in enumerate(coefficients, 1))
    scale = f"{projection.SCALE * projection.RECTIFIED!r}"
    back, up = projection.FROM_GRID, projection.TO_LATITUDE
    return f"""g AS (SELECT i AS cell_id, ({target.y0!r}-floor(i/{target.width})*{target.step!r})/{scale} AS xi,
        ({target.x0!r}+(i%{target.width})*{target.step!r}-500000e0)/{scale} AS eta FROM range({target.width * target.height}) q(i)),
        h AS (SELECT cell_id, xi-({series('xi', 'sin', '*cosh({}*eta)', back)}) AS p, eta-({series('xi', 'cos', '*sinh({}*eta)', back)}) AS q FROM g),
        k AS (SELECT cell_id, asin(sin(p)/cosh(q)) AS chi, degrees(atan2(sinh(q),cos(p)))+{target.projection.meridian!r} AS lon FROM h),
        spot AS (SELECT cell_id, (lon-{DEGREES.lon0!r})/{DEGREES.step!r} AS fx, ({DEGREES.lat0!r}-degrees(chi+{series('chi', 'sin', '', up)}))/{DEGREES.step!r} AS fy FROM k)"""


def register(q):
    q.add("P01_date_range", lambda t: temporal.between(t.obs, "1996-01-01", "1996-12-31").groupBy("mo").agg(
        F.count(F.lit(1)).alias("n"), F.sum("red").alias("red")), "obs",
        """SELECT mo, count(*) AS n, CAST(sum(red) AS BIGINT) AS red FROM obs
        WHERE t>=DATE '1996-01-01' AND t<DATE '1996-12-31' GROUP BY 1""")

    def p02(t, obs):
        asia = zones.lookup(t.zone_cells, "division", "ASIA").select("cell_id")
        return obs.join(asia, "cell_id", "left_semi").groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.sum("nir").alias("nir"))
    p02_sql = ZONE_CELLS + """ SELECT yr, count(*) AS n, CAST(sum(nir) AS BIGINT) AS nir FROM obs
        WHERE cell_id IN (SELECT cell_id FROM zc WHERE division='ASIA') GROUP BY 1"""

    def asia_shapes(t):
        return ranges.shapes_of(zones.lookup(t.zones, "division", "ASIA"), ranges.Rectangle, ["x0", "x1", "y0", "y1"])
    q.add("P02_spatial_filter", lambda t: p02(t, ranges.near_zones(t.obs, asia_shapes(t), GRID.width)), "cells zones obs", p02_sql)

    def in_key_order(t):
        path = f"{shared_folder(t.spark)}/obs-{uuid.uuid4().hex}"
        ranges.write_in_key_order(GRID.attach(t.obs).drop("area_m2"), path)
        return t.spark.read.parquet(path)
    q.add("P02b_key_order", lambda t: p02(t, in_key_order(t).filter(ranges.in_ranges("zkey", ranges.morton_ranges(asia_shapes(t))))),
          "cells zones obs", p02_sql)

    q.add("P03_property_filter", lambda t: t.obs.filter(
        (c("scene_cloud_pct") < 30) & c("mo").between(7, 9) & c("sensor_no").isin(1, 2)).groupBy("sensor_no", "yr").agg(
        F.count(F.lit(1)).alias("n")), "obs",
        """SELECT sensor_no, yr, count(*) AS n FROM obs
        WHERE scene_cloud_pct<30 AND mo BETWEEN 7 AND 9 AND sensor_no IN (1,2) GROUP BY 1,2""")

    q.add("P04_select_rename", lambda t: t.cells.select(
        "cell_id", c("elevation").alias("dem_m"), c("ph10").alias("ph_x10")), "cells",
        "SELECT cell_id, elevation AS dem_m, ph10 AS ph_x10 FROM cells")

    q.add("P05_map_collection", lambda t: t.obs.withColumn("v", I.ndvi()).groupBy("cell_id").agg(
        F.count("v").alias("n"), A.rounded(F.avg("v")).alias("mean_ndvi")), "obs",
        f"SELECT cell_id, count(v) AS n, {r('avg(v)')} AS mean_ndvi FROM (SELECT cell_id, {nd('nir','red')} AS v FROM obs) GROUP BY 1")

    q.add("P06_merge", lambda t: t.obs.filter(c("sensor_no") == 0).select("cell_id", "yr", "red").unionByName(
        t.obs.filter(c("sensor_no") > 1).select("cell_id", "yr", "red")).groupBy("yr").agg(
        F.count(F.lit(1)).alias("n"), F.sum("red").alias("red")), "obs",
        "SELECT yr, count(*) AS n, CAST(sum(red) AS BIGINT) AS red FROM obs WHERE sensor_no<>1 GROUP BY 1")

    def p07(t):
        reducers = [temporal.reducer(m, "ndvi_dn").alias(m) for m in ("mean", "median", "min", "max", "sum", "count")]
        base = t.signals.groupBy("cell_id").agg(*reducers, A.rounded(temporal.reducer("std", "ndvi_dn")).alias("std"))
        return (base.join(temporal.mode_value(t.signals, ["cell_id"], "water_month"), "cell_id")
                .join(temporal.first_value(t.signals, ["cell_id"], "light_dn"), "cell_id"))
    q.add("P07_temporal_reducers", p07, "signals",
          """m AS (SELECT cell_id, water_month, row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, water_month) AS rn
          FROM signals GROUP BY 1,2),
          f AS (SELECT cell_id, light_dn, row_number() OVER (PARTITION BY cell_id ORDER BY t, light_dn) AS rn FROM signals)
          SELECT s.cell_id, avg(ndvi_dn) AS mean, quantile_cont(ndvi_dn,0.5) AS median, min(ndvi_dn) AS min, max(ndvi_dn) AS max,
          CAST(sum(ndvi_dn) AS BIGINT) AS sum, count(ndvi_dn) AS count, CAST(CAST(round(stddev_pop(ndvi_dn),10) AS FLOAT) AS DOUBLE)+0e0 AS std,
          any_value(m.water_month) AS water_month, any_value(f.light_dn) AS light_dn
          FROM signals s JOIN m ON m.cell_id=s.cell_id AND m.rn=1 JOIN f ON f.cell_id=s.cell_id AND f.rn=1 GROUP BY 1""")

    q.add("P08_mosaic", lambda t: t.obs.withColumn("v", F.when(c("sensor_no") != 3, c("red"))).groupBy("cell_id").agg(
        F.max_by("v", F.when(c("v").isNotNull(), F.struct("t", "v"))).alias("red")), "obs",
        """SELECT cell_id, max(red) FILTER (rn=1) AS red FROM (SELECT cell_id,
        CASE WHEN sensor_no<>3 THEN red END AS red, row_number() OVER (PARTITION BY cell_id
        ORDER BY (sensor_no<>3) DESC, t DESC, red DESC) AS rn FROM obs) GROUP BY 1""")

    q.add("P09_cell_arithmetic", lambda t: t.cells.select(
        "cell_id", (c("clay") + c("sand") - c("soc") * 2).alias("lin"), A.ratio(c("clay"), c("sand")).alias("quot"),
        A.rounded(F.sqrt(F.abs("elevation"))).alias("root"), F.pow(c("soc"), F.lit(2)).alias("sq"),
        A.min2(c("clay"), F.when(c("gain") == 0, c("sand"))).alias("low"),
        A.max2(c("clay"), F.when(c("gain") == 0, c("sand"))).alias("high")), "cells",
        f"""SELECT cell_id, clay+sand-soc*2 AS lin, clay/nullif(sand,0) AS quot, {r('sqrt(abs(elevation))')} AS root,
        pow(soc,2) AS sq, CASE WHEN gain=0 THEN least(clay,sand) END AS low,
        CASE WHEN gain=0 THEN greatest(clay,sand) END AS high FROM cells""")

    def masked():
        return F.when(c("gain") == 0, c("occurrence"))
    q.add("P10_comparison", lambda t: t.cells.withColumn("o", masked()).select(
        "cell_id", *[A.flag(e).alias(n) for n, e in (("gt", c("o") > 50), ("gte", c("o") >= 50), ("lt", c("o") < 50),
                                                     ("lte", c("o") <= 50), ("eq", c("o") == 50), ("neq", c("o") != 50))]),
        "cells", "SELECT cell_id, " + ", ".join(
            f"CAST(o{op}50 AS INT) AS {n}" for n, op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="),
                                                         ("neq", "<>")))
        + " FROM (SELECT cell_id, CASE WHEN gain=0 THEN occurrence END AS o FROM cells)")

    def pair():
        return A.flag(masked() >= 50), A.flag(c("elevation") < 12)
    q.add("P11_mask_logic", lambda t: t.cells.select("cell_id", A.mask_and(*pair()).alias("both"), A.mask_or(*pair()).alias("any"),
                                                     A.mask_not(pair()[0]).alias("neg")), "cells",
          """SELECT cell_id, a*b AS both, CAST(a+b>0 AS INT) AS any, 1-a AS neg FROM (SELECT cell_id,
          CAST(CASE WHEN gain=0 THEN occurrence END >= 50 AS INT) AS a, CAST(elevation<12 AS INT) AS b FROM cells)""")

    q.add("P12_bit_test", lambda t: t.obs.groupBy(A.flag(A.bits_clear(c("qa"), 24)).alias("clear24"),
                                                  A.flag(A.bits_clear(c("qa"), 3072)).alias("clear3072")).agg(
        F.count(F.lit(1)).alias("n")), "obs",
        "SELECT CAST((qa & 24)=0 AS INT) AS clear24, CAST((qa & 3072)=0 AS INT) AS clear3072, count(*) AS n FROM obs GROUP BY 1,2")

    q.add("P13_masking", lambda t: t.cells.select(
        "cell_id", A.update_mask(c("elevation"), c("gain")).alias("upd"), A.self_mask(c("lossyear")).alias("own"),
        A.unmask(A.self_mask(c("lossyear")), -1).alias("filled")), "cells",
        """SELECT cell_id, CASE WHEN gain<>0 THEN elevation END AS upd, nullif(lossyear,0) AS own,
        coalesce(nullif(lossyear,0),-1) AS filled FROM cells""")

    q.add("P14_where_chain", lambda t: t.cells.select("cell_id", A.where_chain(
        0, (c("occurrence") > 0, 1), (c("occurrence") >= 25, 2), (c("occurrence") >= 75, 3),
        (c("elevation") > 30, 9)).alias("cls")), "cells",
        """SELECT cell_id, CASE WHEN elevation>30 THEN 9 WHEN occurrence>=75 THEN 3 WHEN occurrence>=25 THEN 2
        WHEN occurrence>0 THEN 1 ELSE 0 END AS cls FROM cells""")

    q.add("P15_clamp_scale", lambda t: t.cells.select(
        "cell_id", A.clamp(masked().cast("double"), 10.0, 60.0).alias("clamped"), A.unit_scale(c("clay"), 0, 80).alias("scaled"),
        A.norm(c("clay"), 10, 50).alias("n"), A.norm(c("clay"), 60, 20).alias("reversed")), "cells",
        f"""SELECT cell_id, {clamp_sql('CAST(CASE WHEN gain=0 THEN occurrence END AS DOUBLE)', 10, 60)} AS clamped,
        clay/80e0 AS scaled, {norm_sql('clay', 10, 50)} AS n, {norm_sql('clay', 60, 20)} AS reversed FROM cells""")

    q.add("P16_normalised_difference", lambda t: t.obs.select("cell_id", "yr", I.ndwi().alias("v")).groupBy("yr").agg(
        F.count("v").alias("n"), F.sum(A.flag(c("v") >= 0)).alias("pos"), F.min("v").alias("lo"), F.max("v").alias("hi")),
        "obs", f"""SELECT yr, count(v) AS n, CAST(sum(CAST(v>=0 AS INT)) AS BIGINT) AS pos, min(v) AS lo, max(v) AS hi
        FROM (SELECT yr, {nd('green','nir')} AS v FROM obs) GROUP BY 1""")

    q.add("P17_expression", lambda t: t.cells.select("cell_id", A.expression(
        "(CL - SA) * 2 + SO", CL="clay", SA="sand", SO="soc").alias("v")), "cells",
        "SELECT cell_id, (clay-sand)*2+soc AS v FROM cells")

    q.add("P18_band_stack", lambda t: t.signals.groupBy("cell_id", "yr").pivot("water_month", [0, 1, 2]).agg(
        F.count(F.lit(1))).select("cell_id", "yr", *[F.coalesce(c(str(i)), F.lit(0)).alias(f"m{i}") for i in range(3)]),
        "signals", "SELECT cell_id, yr, " + ", ".join(f"count(*) FILTER (water_month={i}) AS m{i}" for i in range(3))
        + " FROM signals GROUP BY 1,2")

    q.add("P19_constant", lambda t: t.cells.select("cell_id", F.lit(25).alias("k"), (c("soc") + F.lit(0.5)).alias("v")), "cells",
          "SELECT cell_id, 25 AS k, soc+0.5e0 AS v FROM cells")

    q.add("P20_casts", lambda t: t.cells.select(
        "cell_id", c("clay").cast("double").alias("f"), (c("ph10") / 10).cast("int").alias("i"),
        A.clamp(c("elevation"), 0, 255).cast("smallint").cast("int").alias("u8")), "cells",
        "SELECT cell_id, CAST(clay AS DOUBLE) AS f, CAST(trunc(ph10/10) AS INT) AS i, least(greatest(elevation,0),255) AS u8 FROM cells")

    from gridlake.model import Grid
    geo = Grid(width=64, lon0=88.0, lat0=26.7, step=0.01)
    q.add("P21_cell_area", lambda t: t.cells.select("cell_id", geo.area().alias("area_m2")), "cells",
          "SELECT cell_id, CAST(round((0.01e0*111.32e0*1000e0)*(0.01e0*111.32e0*1000e0)*cos(radians(26.7e0-y*0.01e0))) AS BIGINT) AS area_m2 FROM cells")

    q.add("P22_zonal_one", lambda t: zonal.stats(
        t.signals, "ndvi_dn", [], ("sum", "mean", "median", "min", "max", "count", "p90", "std")).select(
        "sum", "mean", "median", "min", "max", "count", A.rounded(c("p90")).alias("p90"), A.rounded(c("std")).alias("std")),
        "signals", f"""SELECT CAST(sum(ndvi_dn) AS BIGINT) AS sum, avg(ndvi_dn) AS mean, quantile_cont(ndvi_dn,0.5) AS median,
        min(ndvi_dn) AS min, max(ndvi_dn) AS max, count(ndvi_dn) AS count, {r('quantile_cont(ndvi_dn,0.9)')} AS p90,
        {r('stddev_pop(ndvi_dn)')} AS std FROM signals""")

    q.add("P23_zonal_many", lambda t: zonal.by_zone(
        yearly_mean(t), t.zone_cells.select("cell_id", "zone"), ["zone", "yr"],
        F.sum("s").alias("total"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")), "cells zones signals",
        ZONE_CELLS + """ SELECT zone, yr, CAST(sum(ndvi_dn) AS BIGINT) AS total, count(ndvi_dn) AS n,
        count(DISTINCT cell_id) AS cells FROM signals JOIN zc USING (cell_id) GROUP BY 1,2""")

    # slanted zones: the triangle (x0,y0), (x1,y0), (x0,y1) of every zone; the integral of the clamped width over the height in closed form
    def clamped(u):
        return f"(CASE WHEN {u}<=0 THEN 0 WHEN {u}<l THEN {u}*{u}/2 ELSE l*l/2+l*({u}-l) END)"
    q.add("P23b_covered_zones", lambda t: zonal.weighted_stats(t.cells, "elevation", zones.coverage(t.cells.select("cell_id", "x", "y"), zone_edges(t))).withColumns(
        {n: A.rounded(c(n)) for n in ("covered_m2", "total", "mean")}), "cells zones", f"""
        b AS (SELECT zone_id, elevation, greatest(x-0.5e0,x0) AS xa, x+0.5e0 AS xb, greatest(y-0.5e0,y0) AS ya, least(y+0.5e0,y1) AS yb,
          x1, y0, CAST(x1-x0 AS DOUBLE)/(y1-y0) AS s FROM cells JOIN zones ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
        d AS (SELECT zone_id, elevation, xb-xa AS l, s, x1-(ya-y0)*s-xa AS u, x1-(yb-y0)*s-xa AS v FROM b WHERE yb>ya),
        w AS (SELECT zone_id, elevation, ({clamped('u')}-{clamped('v')})/s AS w FROM d)
        SELECT zone_id, count(elevation) AS cells, {r('sum(w*900)')} AS covered_m2, {r('sum(w*elevation)')} AS total, {r('sum(w*elevation)/sum(w)')} AS mean,
        min(elevation) AS min, max(elevation) AS max FROM w WHERE w>1e-12 GROUP BY 1""")

    q.add("P24_histogram", lambda t: histogram.histogram(t.signals.withColumn("v", c("ndvi_dn")), "v", ["yr"], 255).select(
        "yr", "bucket", "n", "mean"), "signals",
        """b AS (SELECT yr, min(ndvi_dn) AS lo, max(ndvi_dn) AS hi FROM signals GROUP BY 1)
        SELECT yr, CAST(least(floor((ndvi_dn-lo)/(hi-lo)*255),254) AS INT) AS bucket, count(*) AS n, avg(ndvi_dn) AS mean
        FROM signals JOIN b USING (yr) GROUP BY 1,2""")

    q.add("P25_correlation", lambda t: t.cells.agg(A.rounded(A.correlation("clay", "occurrence")).alias("pearson_r")), "cells",
          f"SELECT {r('corr(clay, occurrence)')} AS pearson_r FROM cells")

    def months():
        return F.months_between(F.trunc("t", "month"), F.lit("2002-01-01").cast("date"))
    q.add("P26_linear_fit", lambda t: t.signals.withColumn("m", months()).groupBy("cell_id").agg(
        A.rounded(F.regr_slope("tws_cm", "m")).alias("slope"), A.rounded(F.regr_intercept("tws_cm", "m")).alias("intercept")),
        "signals", f"""SELECT cell_id, {r('regr_slope(tws_cm, m)')} AS slope, {r('regr_intercept(tws_cm, m)')} AS intercept
        FROM (SELECT cell_id, tws_cm, CAST((yr-2002)*12+mo-1 AS DOUBLE) AS m FROM signals) GROUP BY 1""")

    q.add("P27_time_arithmetic", lambda t: t.discs.select(
        "disc_id", F.add_months("event_date", -3).alias("before"), F.add_months("event_date", 3).alias("after"),
        F.date_add("event_date", -48).alias("d48"),
        F.months_between(F.trunc("event_date", "month"), F.lit("2002-01-01").cast("date")).alias("months")), "discs",
        """SELECT disc_id, CAST(event_date - INTERVAL 3 MONTH AS DATE) AS before, CAST(event_date + INTERVAL 3 MONTH AS DATE) AS after,
        CAST(event_date - INTERVAL 48 DAY AS DATE) AS d48, CAST((year(event_date)-2002)*12+month(event_date)-1 AS DOUBLE) AS months FROM discs""")

    def p28(t):
        h = t.cells.groupBy("worldcover", "occurrence").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("worldcover").orderBy("occurrence")
        before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return h.withColumn("before", before).groupBy("worldcover").agg(
            F.max_by("occurrence", F.struct(c("n"), -c("occurrence"))).alias("peak"), F.max("before").alias("before"))
    q.add("P28_prefix_argmax", p28, "cells",
          """h AS (SELECT worldcover, occurrence, count(*) AS n FROM cells GROUP BY 1,2),
          p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY worldcover ORDER BY occurrence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before,
          row_number() OVER (PARTITION BY worldcover ORDER BY n DESC, occurrence) AS rn FROM h)
          SELECT worldcover, max(CASE WHEN rn=1 THEN occurrence END) AS peak, CAST(max(before) AS BIGINT) AS before FROM p GROUP BY 1""")

    q.add("P29_set_sort_list", lambda t: t.zones.groupBy("division").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("zone")), ",").alias("zones")), "zones",
        "SELECT division, count(*) AS n, string_agg(zone, ',' ORDER BY zone) AS zones FROM zones GROUP BY 1")

    q.add("P30_resample", lambda t: focal.coarsen(t.cells, 4, [], [
        F.count(F.lit(1)).alias("n"), F.avg("elevation").alias("elevation")]), "cells",
        """SELECT CAST(floor(x/4) AS INT) AS cx, CAST(floor(y/4) AS INT) AS cy, count(*) AS n, avg(elevation) AS elevation
        FROM cells GROUP BY 1,2""")

    utm_sql = spots_sql(UTM_TARGET)
    q.add("P30b_reproject_nearest", lambda t: reproject(t.cells, ["elevation", "worldcover"], DEGREES, UTM_TARGET), "cells",
          utm_sql + """ SELECT s.cell_id, elevation, worldcover FROM spot s JOIN cells c ON c.x=floor(fx+0.5e0) AND c.y=floor(fy+0.5e0)""")
    q.add("P30c_reproject_bilinear", lambda t: reproject(t.cells, "elevation", DEGREES, UTM_TARGET, method="bilinear").withColumn(
        "elevation", A.rounded(c("elevation"))), "cells", utm_sql + f""", n AS (SELECT s.cell_id, elevation, (1-abs(c.x-fx))*(1-abs(c.y-fy)) AS w
        FROM spot s JOIN cells c ON c.x IN (floor(fx),floor(fx)+1) AND c.y IN (floor(fy),floor(fy)+1))
        SELECT cell_id, {r('sum(w*elevation)/sum(w)')} AS elevation FROM n WHERE w>0 GROUP BY 1""")

    q.add("P31_focal_min_max", lambda t: focal.opening(focal.focal_max(focal.focal_min(wet_cells(t), "w"), "w"), "w").select(
        "cell_id", "eroded", "dilated", "opened"), "cells",
        WET + "," + opening_sql("wet", "w", "") + """,
        dil AS (SELECT a.cell_id, max(b.w) AS w FROM wet a JOIN (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) ON true
          JOIN wet b ON b.x=a.x+o.dx AND b.y=a.y+o.dy GROUP BY 1)
        SELECT op.cell_id, op_er.w AS eroded, dil.w AS dilated, op.w AS opened FROM op JOIN op_er USING (cell_id) JOIN dil USING (cell_id)""")

    q.add("P32_disc_kernel", lambda t: focal.disc_kernel(t.cells.select("cell_id", "x", "y", "occurrence"), "occurrence", 5, tile=16).select(      # several tiles even on the test grid

        "cell_id", c("disc_sum").cast("bigint").alias("disc_sum"), c("disc_count").cast("bigint").alias("disc_count")), "cells",
        """SELECT a.cell_id, CAST(sum(b.occurrence) AS BIGINT) AS disc_sum, count(*) AS disc_count FROM cells a
        JOIN cells b ON b.y BETWEEN a.y-5 AND a.y+5 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=25 GROUP BY 1""")

    q.add("P33_convolution", lambda t: focal.slope_degrees(focal.sobel_magnitude(focal.gaussian_mean(
        t.cells.select("cell_id", "x", "y", "elevation"), "elevation", 3, tile=16), "elevation"), "elevation", 30.0).select(
        "cell_id", *[A.rounded(c(n)).alias(n) for n in ("smooth", "gradient", "slope")]), "cells",
        f"""g AS (SELECT a.cell_id, sum(b.elevation*exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/4.5e0))/
          sum(exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/4.5e0)) AS smooth
          FROM cells a JOIN cells b ON b.x BETWEEN a.x-3 AND a.x+3 AND b.y BETWEEN a.y-3 AND a.y+3 GROUP BY 1),
        s AS (SELECT a.cell_id, count(*) AS n, sum(b.elevation*(b.x-a.x)*(2-abs(b.y-a.y))) AS gx,
          sum(b.elevation*(a.y-b.y)*(2-abs(b.x-a.x))) AS gy FROM cells a
          JOIN cells b ON b.x BETWEEN a.x-1 AND a.x+1 AND b.y BETWEEN a.y-1 AND a.y+1 GROUP BY 1),
        d AS (SELECT a.cell_id, (e.elevation-w.elevation)/60e0 AS zx, (s.elevation-n.elevation)/60e0 AS zy FROM cells a
          JOIN cells e ON e.x=a.x+1 AND e.y=a.y JOIN cells w ON w.x=a.x-1 AND w.y=a.y
          JOIN cells n ON n.x=a.x AND n.y=a.y-1 JOIN cells s ON s.x=a.x AND s.y=a.y+1)
        SELECT cell_id, {r('smooth')} AS smooth, CASE WHEN n=9 THEN {r('sqrt(CAST(gx*gx+gy*gy AS DOUBLE))')} END AS gradient,
        {r('degrees(atan(sqrt(zx*zx+zy*zy)))')} AS slope FROM g JOIN s USING (cell_id) LEFT JOIN d USING (cell_id)""")

    def forest(t):
        return t.cells.filter(c("treecover") >= 45).select("cell_id", "x", "y", "area_m2")
    forest_sql = "f AS (SELECT cell_id, x, y, area_m2, CAST(treecover>=45 AS INT) AS w FROM cells),"
    q.add("P34_connected_components", lambda t: topology.label_patches(forest(t), tile=16).select("cell_id", "label"), "cells",
          forest_sql + patches_sql("f") + " SELECT cell_id, label FROM lab")

    q.add("P35_component_size", lambda t: topology.keep_by_size(topology.label_patches(forest(t), neighbours=8, tile=16), 5, 5000).select(
        "cell_id", "label", "patch_cells"), "cells",
        forest_sql + patches_sql("f", NEAR8) + """ SELECT cell_id, label, patch_cells FROM lab JOIN
        (SELECT label, count(*) AS patch_cells FROM lab GROUP BY 1 HAVING count(*) BETWEEN 5 AND 5000) USING (label)""")

    q.add("P36_distance", lambda t: topology.distance_to_set(t.cells.select(
        "cell_id", "x", "y", A.flag(c("clay") >= 88).alias("w")), "w", tile=8).select("cell_id", A.rounded(c("distance")).alias("distance")),
        "cells", "m AS (SELECT cell_id, x, y, CAST(clay>=88 AS INT) AS w FROM cells) "
        f"SELECT a.cell_id, {r(nearest_sql('m'))} AS distance FROM m a")

    q.add("P37_patch_table", lambda t: topology.patch_table(topology.label_patches(forest(t), tile=16)), "cells",
          forest_sql + patches_sql("f") + """ SELECT label, count(*) AS patch_cells, CAST(sum(area_m2) AS BIGINT) AS area_m2,
          CAST(sum(x) AS DOUBLE)/count(*) AS centroid_x, CAST(sum(y) AS DOUBLE)/count(*) AS centroid_y,
          min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM lab GROUP BY 1""")

    q.add("P38_texture", lambda t: focal.texture_entropy(t.cells.select("cell_id", "x", "y", "worldcover"), "worldcover", tile=16).select(
        "cell_id", A.rounded(c("entropy")).alias("entropy")), "cells", "v AS (SELECT cell_id, x, y, worldcover AS v FROM cells),"
        + TEXTURE_SQL + f" SELECT cell_id, {r('entropy')} AS entropy FROM v LEFT JOIN ent USING (cell_id)")

    def p39(t):
        cells = t.cells.select("cell_id", "x", "y")
        segs = zones.segments(t.discs.withColumn("line", c("disc_id") % 4), "line", "disc_id")
        edges = zone_edges(t)
        parts = [("disc", t.disc_cells), ("rect", t.zone_cells),
                 ("ring", zones.in_rings(cells, t.discs, c("r"), c("r") * 2)),
                 ("corridor", zones.in_corridors(cells, segs, "line", F.lit(1))),
                 ("polygon", zones.in_polygons(cells, edges))]
        out = None
        for kind, df in parts:
            row = df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("cell_id").alias("ids"))
            out = row if out is None else out.unionByName(row)
        return out
    q.add("P39_zone_constructors", p39, "cells zones discs", ZONE_CELLS + "," + DISC_CELLS + """,
        p AS (SELECT disc_id%4 AS line, cx AS ax, cy AS ay, lead(cx) OVER w AS bx, lead(cy) OVER w AS byy FROM discs
          WINDOW w AS (PARTITION BY disc_id%4 ORDER BY disc_id)),
        cor AS (SELECT DISTINCT line, cell_id FROM (SELECT line, cell_id, x, y, ax, ay, bx, byy, (bx-ax)*(bx-ax)+(byy-ay)*(byy-ay) AS l2,
          (x-ax)*(bx-ax)+(y-ay)*(byy-ay) AS tt, (x-ax)*(byy-ay)-(y-ay)*(bx-ax) AS cr FROM cells JOIN p ON bx IS NOT NULL
          AND x BETWEEN least(ax,bx)-1 AND greatest(ax,bx)+1 AND y BETWEEN least(ay,byy)-1 AND greatest(ay,byy)+1)
          WHERE CASE WHEN tt<=0 THEN (x-ax)*(x-ax)+(y-ay)*(y-ay)<=1 WHEN tt>=l2 THEN (x-bx)*(x-bx)+(y-byy)*(y-byy)<=1 ELSE cr*cr<=l2 END),
        tri AS (SELECT zone_id, cell_id FROM cells JOIN zones ON x>=x0 AND x<=x1+0 AND y>=y0 AND y<y1
          AND x < x1-(y-y0)*(x1-x0)/(y1-y0))
        SELECT 'disc' AS kind, count(*) AS n, CAST(sum(cell_id) AS BIGINT) AS ids FROM dc
        UNION ALL SELECT 'rect', count(*), CAST(sum(cell_id) AS BIGINT) FROM zc
        UNION ALL SELECT 'ring', count(*), CAST(sum(cell_id) AS BIGINT) FROM cells c JOIN discs d ON
          (c.x-cx)*(c.x-cx)+(c.y-cy)*(c.y-cy)>r*r AND (c.x-cx)*(c.x-cx)+(c.y-cy)*(c.y-cy)<=4*r*r
        UNION ALL SELECT 'corridor', count(*), CAST(sum(cell_id) AS BIGINT) FROM cor
        UNION ALL SELECT 'polygon', count(*), CAST(sum(cell_id) AS BIGINT) FROM tri""")

    q.add("P40_null_guards", lambda t: t.cells.groupBy("worldcover").agg(
        A.unmask(F.sum(F.when(c("elevation") > 36, c("area_m2")))).alias("m2")), "cells",
        "SELECT worldcover, CAST(coalesce(sum(CASE WHEN elevation>36 THEN 900 END),0) AS BIGINT) AS m2 FROM cells GROUP BY 1")

    q.add("P41_step_years", lambda t: t.signals.agg(F.min("yr").alias("a"), F.max("yr").alias("b")).select(
        F.explode(F.sequence("a", "b", F.lit(2))).alias("yr")).join(
        t.signals.groupBy("yr").agg(F.count(F.lit(1)).alias("n")), "yr"), "signals",
        "SELECT yr, count(*) AS n FROM signals WHERE (yr-(SELECT min(yr) FROM signals))%2=0 GROUP BY 1")


TEXTURE_SQL = """
pr AS (SELECT c.cell_id, d.k, a.v AS v1, b.v AS v2 FROM v c
  JOIN v a ON a.x BETWEEN c.x-1 AND c.x+1 AND a.y BETWEEN c.y-1 AND c.y+1
  JOIN (VALUES (1,0,1),(2,1,0),(3,1,1),(4,1,-1)) d(k,dy,dx) ON true
  JOIN v b ON b.x=a.x+d.dx AND b.y=a.y+d.dy AND b.x BETWEEN c.x-1 AND c.x+1 AND b.y BETWEEN c.y-1 AND c.y+1
  WHERE c.v IS NOT NULL AND a.v IS NOT NULL AND b.v IS NOT NULL),
pc AS (SELECT cell_id, k, v1, v2, count(*) AS n FROM pr GROUP BY ALL),
pe AS (SELECT cell_id, k, -sum(n*ln(n/tot))/max(tot) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY cell_id, k) AS tot FROM pc) GROUP BY 1,2),
ent AS (SELECT cell_id, avg(e) AS entropy FROM pe GROUP BY 1)"""


def zone_edges(t):
    """A triangle per zone: (x0,y0), (x1,y0), (x0,y1)."""
    corners = F.array(F.struct(c("x0").alias("ax"), c("y0").alias("ay"), c("x1").alias("bx"), c("y0").alias("by")),
                      F.struct(c("x1").alias("ax"), c("y0").alias("ay"), c("x0").alias("bx"), c("y1").alias("by")),
                      F.struct(c("x0").alias("ax"), c("y1").alias("ay"), c("x0").alias("bx"), c("y0").alias("by")))
    return t.zones.select("zone_id", F.inline(corners))
