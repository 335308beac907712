"""Coast, new land, storms and ponds (C-*, D-*, Y-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import (AWEI, BANDS, DISC_CELLS, MEDIANS, ZONE_CELLS, km2, nd, r, seasonal, vote)
from gridlake.catalog.primitives import NEAR8, patches_sql
from gridlake.catalog.water import REPORT_YEARS, region_win_sql, win_sql
from gridlake.functions import algebra as A
from gridlake.model import DRY, LOW_WATER, Grid
from gridlake.plans import coast, cyclones, ponds, rivers
from gridlake.sources.fixtures import GRID

c = F.col
XY = "CAST(cell_id % 64 AS INT) AS x, CAST(floor(cell_id/64) AS INT) AS y"
LAND_YEARS = (1996, 1998, 2000)
CALENDAR = "NOT (month(t)=12 AND day(t)=31)"

#: The test grid laid out in degrees, for coordinates of patches.
DEGREES = Grid(64, lon0=88.0, lat0=26.75, step=0.25)


def round_all(df, *names):
    return df.withColumns({n: A.rounded(c(n)) for n in names})


def land_wide(t):
    spans = rivers.filled_windows(t.obs, LAND_YEARS, reach=1, last_day=(2, 28))
    return GRID.attach(rivers.window_masks(t.obs, t.cells.select("cell_id"), spans))


LAND_SQL = win_sql(rivers.windows(LAND_YEARS, reach=1, last_day=(2, 28)), "lw")
DRY_YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)
DRY_SQL = (f"ds AS ({seasonal('obs', DRY)}), dm AS (SELECT cell_id, sy, {vote()} AS w FROM (SELECT cell_id, sy, {MEDIANS} FROM ds "
           "WHERE (qa&24)=0 GROUP BY 1,2))")
HEALTH_SQL = f"pc AS (SELECT cell_id, yr, avg(ndvi_dn) AS v FROM signals WHERE {CALENDAR} GROUP BY 1,2)"
WINDOWS_SQL = (DISC_CELLS + ", nr AS (SELECT disc, event_date, dc.cell_id, t, " + ", ".join(BANDS) + " FROM dc JOIN obs ON obs.cell_id=dc.cell_id "
               "AND (qa&24)=0 AND t>=event_date-48 AND t<event_date+50), wc AS (SELECT disc, event_date, cell_id, "
               + ", ".join(f"quantile_cont({b},0.5) FILTER (t>=event_date-48 AND t<event_date+12) AS pre_{b}" for b in BANDS) + ", "
               + ", ".join(f"quantile_cont({b},0.5) FILTER (t>=event_date-10 AND t<event_date+50) AS post_{b}" for b in BANDS)
               + " FROM nr GROUP BY 1,2,3)")
POST_WATER = (f"CAST((CAST({nd('post_green','post_nir')}>=0 AS INT)+CAST({nd('post_green','post_swir1')}>=0 AS INT)+CAST("
              "(4e0*(post_green-post_swir1)-(0.25e0*post_nir+2.75e0*post_swir2))>=0 AS INT))>=2 AS INT)")
DAMAGE_SQL = (WINDOWS_SQL + f", dg AS (SELECT disc, cell_id, {nd('pre_nir','pre_red')} AS ndvi_pre, {nd('post_nir','post_red')} AS ndvi_post, "
              f"{nd('pre_nir','pre_red')}-{nd('post_nir','post_red')} AS d, {POST_WATER} AS flooded FROM wc)")
TIERS = (f"sum(CASE WHEN d IS NULL THEN NULL WHEN {{0}} THEN 900 ELSE 0 END)")


def tier(cond):
    return f"CAST({TIERS.format(cond)} AS DOUBLE)/1e6"


TIER_SQL = (f"ta AS (SELECT disc, {tier('d>=0.2')} AS severe_km2, {tier('d>=0.1 AND d<0.2')} AS moderate_km2, {tier('d>=0.05 AND d<0.1')} AS mild_km2, "
            f"{tier('d>=0.05')} AS damaged_km2, CAST(sum(flooded*900) AS DOUBLE)/1e6 AS flood_km2 FROM dg GROUP BY 1)")
POND_RULES = dict(occurrence=(20, 95), ndwi_min=-0.2, turbidity_min=-0.3, limit=20)
POND_YEARS = (1994, 2001)
POND_SQL = (f"ps AS ({seasonal('obs', LOW_WATER)}), pc0 AS (SELECT cell_id, sy AS yr, {MEDIANS} FROM ps WHERE (qa&24)=0 AND sy BETWEEN 1994 AND 2001 GROUP BY 1,2), "
            f"pd AS (SELECT p.cell_id, yr, c.x, c.y, c.area_m2, 1 AS w FROM pc0 p JOIN cells c USING (cell_id) WHERE {nd('green','nir')}>-0.2 AND {nd('green','swir1')}>-0.2 "
            "AND (green*1e-4-nir*1e-4)/(green*1e-4+nir*1e-4+1e-6)>-0.3 AND occurrence BETWEEN 20 AND 95 AND elevation BETWEEN 0 AND 20),"
            + patches_sql("pd", NEAR8, "yr") + ", sz AS (SELECT yr, label, count(*) AS patch_cells FROM lab GROUP BY 1,2 HAVING count(*) BETWEEN 3 AND 5000), "
            "pond AS (SELECT lab.*, patch_cells FROM lab JOIN sz ON sz.yr=lab.yr AND sz.label=lab.label)")


def pond_cells(t):
    return ponds.detect(t.obs, t.cells, GRID, POND_YEARS, min_cells=3, **POND_RULES)


def ponds_of(t):
    return ponds.area_by_zone(pond_cells(t), t.zone_cells, t.zones, years=range(POND_YEARS[0], POND_YEARS[1] + 1))


def event_damage(t):
    return cyclones.with_damage(cyclones.window_composites(t.obs, t.disc_cells))


def register(q):
    q.add("C01_low_coast_area", lambda t: coast.low_coast_areas(t.cells), "cells", " UNION ALL ".join(
        f"SELECT {h} AS threshold_m, {km2(f'elevation>=0 AND elevation<{h}')} AS area_km2 FROM cells" for h in (1, 2, 3, 5, 10)))
    q.add("C02_low_coast_population", lambda t: coast.low_coast_population(t.cells, t.settlement, 5, ["epoch"]), "cells settlement",
          """SELECT epoch, CAST(sum(population) AS BIGINT) AS population_in_zone FROM settlement JOIN cells USING (cell_id)
          WHERE elevation>=0 AND elevation<5 GROUP BY 1""")
    q.add("C03_shoreline_change", lambda t: coast.shoreline_change(coast.dry_water_years(t.obs, DRY_YEARS), DRY_YEARS, GRID.area()), "obs",
          DRY_SQL + ", cl AS (SELECT DISTINCT cell_id FROM dm) " + " UNION ALL ".join(
              f"SELECT {a} AS year1, {b} AS year2, CAST(sum(m1.w*(1-m2.w)*900) AS DOUBLE)/1e6 AS accretion_km2, CAST(sum(m2.w*(1-m1.w)*900) AS DOUBLE)/1e6 AS erosion_km2 "
              f"FROM cl LEFT JOIN dm m1 ON m1.cell_id=cl.cell_id AND m1.sy={a} LEFT JOIN dm m2 ON m2.cell_id=cl.cell_id AND m2.sy={b}"
              for a, b in zip(DRY_YEARS, DRY_YEARS[1:])))
    q.add("C04_mangrove_extent", lambda t: coast.mangrove_areas(t.cells, (2000, 2015, 2020, 2021)), "cells", " UNION ALL ".join(
        f"SELECT {y} AS yr, {km2('worldcover=95' if y >= 2020 else 'treecover>30 AND elevation<10')} AS mangrove_km2 FROM cells"
        for y in (2000, 2015, 2020, 2021)))
    q.add("C05_mangrove_health", lambda t: round_all(coast.mangrove_health(t.signals, t.cells), "mean_ndvi", "std_ndvi"), "cells signals",
          HEALTH_SQL + """ SELECT yr, CAST(CAST(round(avg(v)*1e-4,10) AS FLOAT) AS DOUBLE)+0e0 AS mean_ndvi, CAST(CAST(round(stddev_pop(v)*1e-4,10) AS FLOAT) AS DOUBLE)+0e0 AS std_ndvi FROM pc JOIN cells USING (cell_id)
          WHERE treecover>30 AND elevation<10 GROUP BY 1""")
    q.add("C06_mangrove_loss", lambda t: coast.mangrove_loss(t.cells, 2003, 2015), "cells",
          f"SELECT {km2('lossyear>0 AND lossyear BETWEEN 3 AND 15 AND treecover>30 AND elevation<10')} AS mangrove_loss_km2 FROM cells")
    q.add("C07_cyclone_ndvi_drop", lambda t: round_all(cyclones.ndvi_drop(t.signals, t.disc_cells), "mean_drop", "max_drop"), "cells discs signals",
          DISC_CELLS + """, pc AS (SELECT disc, dc.cell_id, (avg(ndvi_dn) FILTER (t<event_date)-avg(ndvi_dn) FILTER (t>=event_date))*1e-4 AS d
          FROM dc JOIN signals s ON s.cell_id=dc.cell_id AND t>=event_date - INTERVAL 3 MONTH AND t<event_date + INTERVAL 3 MONTH GROUP BY 1,2)
          SELECT disc, CAST(CAST(round(avg(d),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_drop, CAST(CAST(round(max(d),10) AS FLOAT) AS DOUBLE)+0e0 AS max_drop FROM pc GROUP BY 1""")
    q.add("C08_new_land", lambda t: coast.new_land(land_wide(t), 1996, 2000).select("cell_id", "new_land"), "cells obs",
          LAND_SQL + " SELECT cell_id, w_1996*(1-w_2000) AS new_land FROM lw")
    q.add("C09_accretion_series", lambda t: coast.accretion_series(land_wide(t), LAND_YEARS, t.zone_cells), "cells zones obs",
          ZONE_CELLS + "," + LAND_SQL + " SELECT zone, early, late, k AS accretion_km2, k/(late-early) AS km2_per_year FROM ("
          + " UNION ALL ".join(f"SELECT zone, {a} AS early, {b} AS late, CAST(sum(w_{a}*(1-w_{b})*900) AS DOUBLE)/1e6 AS k FROM lw JOIN zc USING (cell_id) GROUP BY 1"
                               for a, b in zip(LAND_YEARS, LAND_YEARS[1:])) + ")")
    def filled(t):
        return rivers.window_masks(t.obs, t.cells.select("cell_id"), rivers.filled_windows(t.obs, (1996, 2003), reach=1, last_day=(2, 28)))
    q.add("C08b_new_land_widened", lambda t: coast.new_land(filled(t), 1996, 2003).select("cell_id", "new_land"), "cells obs",
          win_sql([(1996, "1995-12-01", "1997-02-28"), (2003, "2000-03-01", "9999-12-31")], "lf") + " SELECT cell_id, w_1996*(1-w_2003) AS new_land FROM lf")
    # discs of 0.25 to 2.25 square degrees, so that all three resolutions occur
    q.add("C09b_accretion_report", lambda t: coast.accretion_report(t.obs, t.disc_cells, "r", GRID, F.pow((2 * c("r") + 1) * 0.1, 2), REPORT_YEARS, reach=1), "cells discs obs",
          DISC_CELLS + "," + region_win_sql("r", "dc", REPORT_YEARS, "(CASE WHEN pow((2*r+1)*0.1e0,2)>=2 THEN 10 WHEN pow((2*r+1)*0.1e0,2)>=0.5 THEN 3 ELSE 1 END)", "zw", (2, 28))
          + " SELECT r, early, late, k AS accretion_km2, k/(late-early) AS km2_per_year FROM (" + " UNION ALL ".join(
              f"SELECT r, {a} AS early, {b} AS late, CAST(sum(w_{a}*(1-w_{b})*area_m2) AS DOUBLE)/1e6 AS k FROM zw GROUP BY 1"
              for a, b in zip(REPORT_YEARS, REPORT_YEARS[1:])) + ")")
    islands = LAND_SQL + ", nl AS (SELECT cell_id, x, y, area_m2, w_1996*(1-w_2000) AS w FROM lw)," + patches_sql("nl")
    q.add("C10_major_islands", lambda t: coast.major_islands(coast.new_land(land_wide(t), 1996, 2000), 2700, grid=DEGREES, period="1996-2000").withColumns(
        {n: A.rounded(c(n)) for n in ("lon", "lat")}), "cells obs",
          islands + """ SELECT label, count(*) AS patch_cells, CAST(sum(area_m2) AS BIGINT) AS area_m2, CAST(sum(x) AS DOUBLE)/count(*) AS centroid_x,
          CAST(sum(y) AS DOUBLE)/count(*) AS centroid_y, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
          """ + f"{r(f'{DEGREES.lon0!r}+avg(x)*{DEGREES.step!r}')} AS lon, {r(f'{DEGREES.lat0!r}-avg(y)*{DEGREES.step!r}')} AS lat, '1996-2000' AS period" + """
          FROM lab GROUP BY 1 HAVING sum(area_m2)>=2700 ORDER BY area_m2 DESC, label""")
    q.add("C11_vulnerability", lambda t: round_all(coast.vulnerability(coast.new_land(land_wide(t), 1996, 2000).join(
        t.cells.select("cell_id", "occurrence"), "cell_id")), "mean_occurrence"), "cells obs",
        LAND_SQL + f""" SELECT {km2('w_1996*(1-w_2000)=1 AND occurrence>=25', 'lw.area_m2')} AS vulnerable_km2,
        CAST(CAST(round(coalesce(avg(occurrence) FILTER (w_1996*(1-w_2000)=1),0),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_occurrence FROM lw JOIN cells USING (cell_id)""")

    q.add("D01_window_composites", lambda t: cyclones.window_composites(t.obs, t.disc_cells), "cells discs obs", WINDOWS_SQL + " SELECT * FROM wc")
    stats = ("mean_drop", "max_drop", "p25_drop", "p75_drop", "mean_pre", "mean_post")
    q.add("D02_vegetation_damage", lambda t: round_all(cyclones.vegetation_damage(event_damage(t)), *stats), "cells discs obs",
          DAMAGE_SQL + f""" SELECT disc, {r('avg(d)')} AS mean_drop, {r('max(d)')} AS max_drop, {r('quantile_cont(d,0.25)')} AS p25_drop,
          {r('quantile_cont(d,0.75)')} AS p75_drop, {r('avg(ndvi_pre)')} AS mean_pre, {r('avg(ndvi_post)')} AS mean_post FROM dg GROUP BY 1""")
    q.add("D03_flood_extent", lambda t: cyclones.flood_extent(event_damage(t), GRID.area()), "cells discs obs",
          DAMAGE_SQL + " SELECT disc, CAST(sum(flooded*900) AS DOUBLE)/1e6 AS flood_km2 FROM dg GROUP BY 1")
    q.add("D04_damage_tiers", lambda t: cyclones.damage_areas(event_damage(t), GRID.area()), "cells discs obs",
          DAMAGE_SQL + "," + TIER_SQL + " SELECT * FROM ta")
    q.add("D05_all_events", lambda t: cyclones.compare_all(t.discs, event_damage(t), GRID.area()), "cells discs obs",
          DAMAGE_SQL + "," + TIER_SQL + """ SELECT d.disc, event_date, severe_km2, moderate_km2, mild_km2, damaged_km2, flood_km2,
          CASE WHEN damaged_km2 IS NULL THEN 'no data' ELSE 'ok' END AS status FROM discs d LEFT JOIN ta ON ta.disc=d.disc ORDER BY event_date, d.disc""")

    q.add("Y01_coastal_elevation", lambda t: t.cells.select("cell_id", ponds.coastal_low().alias("coastal")), "cells",
          "SELECT cell_id, CAST(elevation>=0 AND elevation<=10 AS INT) AS coastal FROM cells")
    q.add("Y02_pond_detection", lambda t: pond_cells(t).select("yr", "cell_id", "label", "patch_cells"), "cells obs",
          POND_SQL + " SELECT yr, cell_id, label, patch_cells FROM pond")
    q.add("Y03_pond_series", lambda t: ponds.area_series(pond_cells(t), *POND_YEARS, 1), "cells obs", POND_SQL
          + ", ys AS (SELECT CAST(unnest(range(1994,2002)) AS INT) AS yr) SELECT yr, coalesce((SELECT CAST(sum(area_m2) AS DOUBLE)/1e6 FROM pond WHERE pond.yr=ys.yr),0) AS pond_km2 FROM ys")
    q.add("Y04_mangrove_conversion", lambda t: ponds.mangrove_conversion(pond_cells(t), t.cells, 20), "cells obs",
          POND_SQL + """ SELECT yr, CAST(sum(p.area_m2) AS DOUBLE)/1e6 AS conversion_km2 FROM pond p JOIN cells USING (cell_id)
          WHERE (treecover>30 OR (lossyear>0 AND lossyear<=20)) AND elevation BETWEEN 0 AND 10 GROUP BY 1""")
    zp = ZONE_CELLS + "," + POND_SQL + ", zp AS (SELECT z.zone, z.yr, coalesce(CAST(sum(area_m2) AS DOUBLE)/1e6,0) AS pond_km2 FROM (SELECT zone, CAST(unnest(range(1994,2002)) AS INT) AS yr FROM zones) z LEFT JOIN (SELECT zone, yr, area_m2 FROM pond JOIN zc USING (cell_id)) p ON p.zone=z.zone AND p.yr=z.yr GROUP BY 1,2)"
    q.add("Y05_pond_by_zone", lambda t: ponds_of(t), "cells zones obs", zp + " SELECT * FROM zp")

    def truth(t):
        return (t.cells.filter(c("occurrence") >= 50).join(t.zone_cells.select("cell_id", "zone"), "cell_id").groupBy("zone")
                .agg((F.sum("area_m2") / F.lit(1e6)).alias("census_km2")))
    def yearly_ponds(t):
        return pond_cells(t).join(t.zone_cells.select("zone", "cell_id"), "cell_id").groupBy("zone", "yr").agg((F.sum("area_m2") / F.lit(1e6)).alias("pond_km2"))
    q.add("Y06b_errors", lambda t: ponds.errors(yearly_ponds(t), truth(t), "zone", "pond_km2", "census_km2", ("yr",)), "cells zones obs",
          ZONE_CELLS + "," + POND_SQL + """, tr AS (SELECT zone, CAST(count(*)*900 AS DOUBLE)/1e6 AS census_km2 FROM cells JOIN zc USING (cell_id) WHERE occurrence>=50 GROUP BY 1),
          zy AS (SELECT zone, yr, CAST(sum(area_m2) AS DOUBLE)/1e6 AS k FROM pond JOIN zc USING (cell_id) GROUP BY 1,2)
          SELECT zone, yr, k AS satellite, census_km2 AS reference, k-census_km2 AS error FROM zy JOIN tr USING (zone)""")
    q.add("Y06_accuracy", lambda t: round_all(ponds.accuracy(ponds_of(t), truth(t), "zone", "pond_km2", "census_km2", ["yr"]),
                                              "r_squared", "rmse", "mae"), "cells zones obs",
          zp + """, tr AS (SELECT zone, CAST(count(*)*900 AS DOUBLE)/1e6 AS census_km2 FROM cells JOIN zc USING (cell_id) WHERE occurrence>=50 GROUP BY 1),
          j AS (SELECT yr, pond_km2-census_km2 AS e, census_km2 FROM zp JOIN tr USING (zone))
          SELECT yr, count(*) AS n, CAST(CAST(round(1e0-sum(e*e)/nullif(var_pop(census_km2)*count(*),0),10) AS FLOAT) AS DOUBLE)+0e0 AS r_squared, CAST(CAST(round(sqrt(avg(e*e)),10) AS FLOAT) AS DOUBLE)+0e0 AS rmse,
          CAST(CAST(round(avg(abs(e)),10) AS FLOAT) AS DOUBLE)+0e0 AS mae FROM j GROUP BY yr""")
