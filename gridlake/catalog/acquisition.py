"""Acquisition, masking, compositing and spectral indices (A-*, I-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import AWEI, BANDS, MEDIANS, ZONE_CELLS, nd, r, seasonal
from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import BUILT_EPOCHS, DRY_MONSOON, SMOD_EPOCHS, Grid
from gridlake.operators import ranges, temporal, zones
from gridlake.plans import acquisition as acq
from gridlake.plans import incremental
from gridlake.sources.fixtures import GRID

c = F.col
#: The test grid as a part of the study area, a tenth of a degree per cell.
STUDY_GRID = Grid(64, lon0=87.5, lat0=26.95, step=0.1)


def register(q):
    def a01(t):
        parts = [("country", None, None), ("first", "division", "EUROPE"), ("first_list", "division", ["ASIA", "AFRICA"]),
                 ("second", "zone", "CANADA"), ("second_list", "zone", ["CHINA", "INDIA"])]
        out = None
        for label, level, names in parts:
            df = zones.lookup(t.zones, level, names).select(F.lit(label).alias("lookup"), "zone", "division")
            out = df if out is None else out.unionByName(df)
        return out
    q.add("A01_zone_lookup", a01, "zones", """SELECT 'country' AS lookup, zone, division FROM zones
        UNION ALL SELECT 'first', zone, division FROM zones WHERE division='EUROPE'
        UNION ALL SELECT 'first_list', zone, division FROM zones WHERE division IN ('ASIA','AFRICA')
        UNION ALL SELECT 'second', zone, division FROM zones WHERE zone='CANADA'
        UNION ALL SELECT 'second_list', zone, division FROM zones WHERE zone IN ('CHINA','INDIA')""")

    def a02(t):
        out = None
        for scope in ("national", "district:FRANCE", "Europe", "sylhet", "somewhere"):
            area = zones.study_area(t.zones, scope, STUDY_GRID)
            cells = zones.in_rectangles(t.cells.select("cell_id", "x", "y"), area).select("cell_id").distinct()
            df = t.obs.join(cells, "cell_id", "left_semi").groupBy("yr").agg(F.count(F.lit(1)).alias("n")).withColumn(
                "scope", F.lit(scope))
            out = df if out is None else out.unionByName(df)
        return out
    sel = "SELECT '{0}' AS scope, yr, count(*) AS n FROM obs WHERE cell_id IN (SELECT cell_id FROM {1}) GROUP BY yr"
    q.add("A02_study_area", a02, "cells zones obs", ZONE_CELLS + " " + " UNION ALL ".join([
        sel.format("national", "zc"), sel.format("district:FRANCE", "zc WHERE zone='FRANCE'"),
        sel.format("Europe", "zc WHERE division='EUROPE'"),
        *[sel.format(scope, f"cells WHERE 87.5e0+x*0.1e0 BETWEEN {w - 1e-9} AND {e + 1e-9} AND 26.95e0-y*0.1e0 BETWEEN {s - 1e-9} AND {n + 1e-9}")
          for scope, w, s, e, n in (("sylhet", 90.5, 24.0, 92.2, 25.2), ("somewhere", 88.0, 20.5, 92.7, 26.7))]]))

    q.add("A03_cloud_mask", lambda t: acq.mask_clouds(t.obs, "L5").groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("red").alias("clear"), F.sum("red").alias("red")).join(
        acq.mask_clouds(t.obs, "S2").groupBy("cell_id").agg(F.count("nir").alias("clear_s2")), "cell_id"), "obs",
        """SELECT cell_id, count(*) AS rows, count(*) FILTER ((qa&24)=0) AS clear,
        CAST(sum(red) FILTER ((qa&24)=0) AS BIGINT) AS red, count(*) FILTER ((qa&3072)=0) AS clear_s2 FROM obs GROUP BY 1""")

    q.add("A04_harmonise", lambda t: acq.harmonise(t.obs, "L5").groupBy("cell_id").agg(
        F.min("blue").alias("blue"), F.max("swir2").alias("swir2"), F.max("nir").alias("nir")), "obs",
        """SELECT cell_id, min(blue*2.75e-05+(-0.2e0)) AS blue, max(swir2*2.75e-05+(-0.2e0)) AS swir2,
        max(nir*2.75e-05+(-0.2e0)) AS nir FROM obs GROUP BY 1""")

    def a05(t):
        shapes = ranges.shapes_of(zones.lookup(t.zones, "division", "AMERICA"), ranges.Rectangle, ["x0", "x1", "y0", "y1"])
        obs = ranges.near_zones(t.obs, shapes, GRID.width)
        frames = {s: obs.filter(c("sensor_no") == i) for i, s in enumerate(("L5", "L7", "L8", "L9"))}
        area = zones.lookup(t.zone_cells, "division", "AMERICA")
        return acq.multi_sensor(frames, "1997-01-01", "2000-01-01", area).groupBy("sensor", "yr").agg(
            F.count(F.lit(1)).alias("n"), F.count("red").alias("clear"), F.max("red").alias("red"))
    q.add("A05_multi_sensor", a05, "cells zones obs", ZONE_CELLS + """
        SELECT CASE sensor_no WHEN 0 THEN 'L5' ELSE 'L7' END AS sensor, yr, count(*) AS n,
        count(*) FILTER ((qa&24)=0) AS clear, max(red*2.75e-05+(-0.2e0)) FILTER ((qa&24)=0) AS red FROM obs
        WHERE sensor_no IN (0,1) AND t>=DATE '1997-01-01' AND t<DATE '2000-01-01'
        AND cell_id IN (SELECT cell_id FROM zc WHERE division='AMERICA') GROUP BY 1,2""")

    q.add("A06_low_cloud_scenes", lambda t: acq.low_cloud_scenes(t.obs, "1996-01-01", "1999-01-01").groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("scenes"), F.count("red").alias("clear"), F.sum("red").alias("red")), "obs",
        """SELECT cell_id, count(*) AS scenes, count(*) FILTER ((qa&3072)=0) AS clear, CAST(sum(red) FILTER ((qa&3072)=0) AS BIGINT) AS red
        FROM obs WHERE t>=DATE '1996-01-01' AND t<DATE '1999-01-01' AND scene_cloud_pct<30 GROUP BY 1""")

    def a07(t):
        median = acq.yearly_composite(t.obs)
        others = [acq.yearly_composite(t.obs, bands=("red",), method=m).withColumnRenamed("red", f"red_{m}")
                  for m in ("mean", "min", "max")]
        for other in others:
            median = median.join(other, ["cell_id", "yr"])
        return median
    q.add("A07_composite", a07, "obs", f"""SELECT cell_id, yr, {MEDIANS}, avg(red) AS red_mean, min(red) AS red_min,
        max(red) AS red_max FROM obs WHERE (qa&24)=0 GROUP BY 1,2""")

    def a07b(t):
        # history up to June 1998 is a state; the later scenes come in two batches, the second with a late one of 1996
        late = (c("yr") == 1996) & (c("mo") == 12)
        old = (c("t") < F.lit("1998-07-01").cast("date")) & ~late
        batches = [t.obs.filter(old), t.obs.filter(~old & ~late & (c("yr") <= 1998)), t.obs.filter(~old & (late | (c("yr") > 1998)))]
        state = incremental.state_of(batches[0])
        for batch in batches[1:]:
            state = incremental.merged(state, incremental.state_of(batch))
        return incremental.composites(state)
    q.add("A07b_incremental_composite", a07b, "obs", f"SELECT cell_id, yr, {MEDIANS} FROM obs WHERE (qa&24)=0 GROUP BY 1,2")

    q.add("A08_seasonal_composite", lambda t: acq.seasonal_composite(t.obs), "obs",
          f"s AS ({seasonal('obs', DRY_MONSOON)}) SELECT cell_id, sy AS yr, season, {MEDIANS} FROM s WHERE (qa&24)=0 GROUP BY 1,2,3")

    q.add("A09_static_layers", lambda t: t.cells.select("cell_id", "occurrence", "elevation").join(
        t.signals.groupBy("cell_id").agg(F.sum(A.flag(c("water_month") == 2)).alias("wet_months")), "cell_id", "left"),
        "cells signals", """SELECT c.cell_id, occurrence, elevation, w.wet_months FROM cells c LEFT JOIN
        (SELECT cell_id, CAST(sum(CAST(water_month=2 AS INT)) AS BIGINT) AS wet_months FROM signals GROUP BY 1) w USING (cell_id)""")

    q.add("A10_run_by_zone", lambda t: acq.run_by_zone(
        t.obs.groupBy("cell_id", "yr").agg(F.sum("nir").alias("nir"), F.count(F.lit(1)).alias("n")), t.zone_cells, ["yr"],
        F.sum("nir").alias("nir"), F.sum("n").alias("n")), "cells zones obs",
        ZONE_CELLS + " SELECT zone, yr, CAST(sum(nir) AS BIGINT) AS nir, count(*) AS n FROM obs JOIN zc USING (cell_id) GROUP BY 1,2")

    def a11(t):
        halves = [t.zone_cells.filter(c("division") == d).join(t.cells.select("cell_id", "elevation", "occurrence"), "cell_id")
                  .select("cell_id", F.when(c("occurrence") > 20, c("elevation") + i).alias("v"))
                  for i, d in enumerate(("ASIA", "EUROPE", "ASIA", "AFRICA"))]
        return acq.merge_mosaic(halves, "v")
    q.add("A11_merge_mosaic", a11, "cells zones", ZONE_CELLS + """
        SELECT zc.cell_id, CASE WHEN occurrence>20 THEN elevation + CASE division WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 1 ELSE 3 END END AS v
        FROM zc JOIN cells USING (cell_id) WHERE division IN ('ASIA','EUROPE','AFRICA')""")

    q.add("A12_merge_series", lambda t: acq.merge_series(acq.run_by_zone(
        t.obs.groupBy("cell_id", "yr").agg(F.sum("nir").alias("nir")), t.zone_cells, ["yr"], F.sum("nir").alias("nir"),
        F.count(F.lit(1)).alias("cells")), "yr", ["nir", "cells"]), "cells zones obs",
        ZONE_CELLS + """ SELECT yr, CAST(sum(nir) AS BIGINT) AS nir, count(DISTINCT (zone, cell_id)) AS cells
        FROM obs JOIN zc USING (cell_id) GROUP BY 1""")

    q.add("A13_epoch_snap", lambda t: t.signals.groupBy("yr").agg(F.count(F.lit(1)).alias("n")).select(
        "yr", "n", temporal.snap_year(c("yr"), BUILT_EPOCHS).alias("built_epoch"),
        temporal.snap_year(c("yr") + 40, SMOD_EPOCHS).alias("smod_epoch")), "signals",
        f"""y AS (SELECT yr, count(*) AS n FROM signals GROUP BY 1)
        SELECT yr, n, (SELECT arg_min(e, abs(e-yr)*10000+e) FROM (SELECT CAST(unnest({list(BUILT_EPOCHS)}) AS INT) AS e)) AS built_epoch,
        (SELECT arg_min(e, abs(e-yr-40)*10000+e) FROM (SELECT CAST(unnest({list(SMOD_EPOCHS)}) AS INT) AS e)) AS smod_epoch FROM y""")

    comp = f"comp AS (SELECT cell_id, yr, {MEDIANS} FROM obs WHERE (qa&24)=0 GROUP BY 1,2)"
    refl = ("s AS (SELECT cell_id, yr, " + ", ".join(f"{b}*1e-4 AS {b}" for b in BANDS) + " FROM comp)")

    def reflectance(t):
        return acq.yearly_composite(t.obs).withColumns({b: c(b) * F.lit(1e-4) for b in BANDS})

    def index(name, columns, sql):
        q.add(name, lambda t: reflectance(t).select("cell_id", "yr", *columns()), "obs",
              f"{comp},{refl} SELECT cell_id, yr, {sql} FROM s")
    index("I01_ndwi_mndwi", lambda: [I.ndwi().alias("ndwi"), I.mndwi().alias("mndwi")],
          f"{nd('green','nir')} AS ndwi, {nd('green','swir1')} AS mndwi")
    index("I02_awei", lambda: [I.awei().alias("awei")], f"{AWEI} AS awei")
    q.add("I03_water_indices", lambda t: I.with_water_indices(acq.yearly_composite(t.obs, bands=("green", "nir", "swir1", "swir2"))),
          "obs", f"""{comp} SELECT cell_id, yr, green, nir, swir1, swir2, {nd('green','nir')} AS ndwi, {nd('green','swir1')} AS mndwi,
          {AWEI} AS awei FROM comp""")
    index("I04_ndvi", lambda: [I.ndvi().alias("ndvi")], f"{nd('nir','red')} AS ndvi")
    index("I05_evi", lambda: [A.rounded(I.evi()).alias("evi")],
          r("2.5e0*(nir-red)/nullif(nir+6e0*red-7.5e0*blue+1e0,0)") + " AS evi")
    index("I06_savi", lambda: [A.rounded(I.savi()).alias("savi"), A.rounded(I.savi(soil=0.25)).alias("savi25")],
          r("(nir-red)*1.5e0/(nir+red+0.5e0)") + " AS savi, " + r("(nir-red)*1.25e0/(nir+red+0.25e0)") + " AS savi25")
    index("I07_lswi", lambda: [I.lswi().alias("lswi")], f"{nd('nir','swir1')} AS lswi")
    index("I08_gcvi", lambda: [I.gcvi().alias("gcvi")], "nir/nullif(green,0)-1e0 AS gcvi")
    index("I09_built_indices", lambda: [I.ndbi().alias("ndbi"), I.urban_index().alias("ui"), I.bui().alias("bui")],
          f"{nd('swir1','nir')} AS ndbi, {nd('swir2','nir')} AS ui, {nd('swir1','nir')}-{nd('nir','red')} AS bui")
    index("I10_turbidity", lambda: [A.rounded(I.turbidity()).alias("turbidity")],
          r("(green-nir)/(green+nir+1e-6)") + " AS turbidity")
