"""Lights, settlement, infrastructure and transport (N-*, U-*, J-*, T-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import DISC_CELLS, MEDIANS, ZONE_CELLS, clamp, km2, nd, norm, r
from gridlake.catalog.coast import CALENDAR, round_all
from gridlake.catalog.crops import MODE_SQL
from gridlake.catalog.primitives import nearest_sql
from gridlake.functions import algebra as A
from gridlake.model import ECONOMIC_ZONES, SMOD_CLASSES, Grid, zone_table
from gridlake.operators import temporal, zones
from gridlake.plans import acquisition as acq
from gridlake.plans import landcover, lights, settlement, transport
from gridlake.sources.fixtures import EPOCHS, GRID

c = F.col
ZONE_GRID = Grid(64, lon0=88.0, lat0=26.7, step=1.0)
LAST_A = 1998   # the test series spans 1995 to 2001, so both sensors occur
LIGHT_SQL = (f"li AS (SELECT cell_id, yr, CASE WHEN yr<={LAST_A} THEN quantile_cont(light_dn,0.5) ELSE avg(light_dn) END AS light FROM signals WHERE {CALENDAR} GROUP BY 1,2)")
SENSOR = f"CASE WHEN yr<={LAST_A} THEN 'A' ELSE 'B' END"
SNAP_SQL = "CASE WHEN yr*2<=3985 THEN 1990 WHEN yr*2<=3995 THEN 1995 ELSE 2000 END"
# light of every year (median) beside the settlement layers of the nearest epoch, for all grid cells
RASTER_SQL = f"""lm AS (SELECT cell_id, yr, quantile_cont(light_dn,0.5) AS light FROM signals WHERE {CALENDAR} GROUP BY 1,2),
ra AS (SELECT s.cell_id, s.x, s.y, y.yr, built, population, smod, light FROM settlement s
  JOIN (SELECT DISTINCT yr FROM lm) y ON s.epoch={SNAP_SQL} LEFT JOIN lm ON lm.cell_id=s.cell_id AND lm.yr=y.yr)"""


def annual(t):
    return lights.annual(t.signals, last_a=LAST_A)


def raster(t):
    light = temporal.calendar_years(t.signals).groupBy("cell_id", "yr").agg(F.percentile("light_dn", F.lit(0.5)).alias("light"))
    layers = settlement.layer_at(t.settlement.drop("area_m2"), temporal.calendar_years(t.signals).select("yr").distinct(), EPOCHS)
    return layers.drop("epoch").join(light, ["cell_id", "yr"], "left")


def economic_cells(t):
    """The named zones on a grid of one degree laid over the test cells; a zone has at least the cells next to its centre."""
    discs = zones.named_discs(zone_table(t.spark, ECONOMIC_ZONES, "disc"), ZONE_GRID, least=1)
    return zones.in_discs(t.cells.select("cell_id", "x", "y"), discs)


def modes(t):
    return landcover.yearly_mode(t.classes)


def register(q):
    years = "yrs AS (SELECT DISTINCT yr FROM signals)"
    q.add("N01_sensor_rules", lambda t: lights.sensor_rules(t.signals.select("yr").distinct(), LAST_A), "signals",
          years + f" SELECT yr, {SENSOR} AS sensor, CASE WHEN yr<={LAST_A} THEN 3e0 ELSE 0.5e0 END AS lit_min, CASE WHEN yr<={LAST_A} THEN 63 ELSE 200 END AS range_max FROM yrs")
    q.add("N02_annual_lights", annual, "signals", LIGHT_SQL + " SELECT * FROM li")
    q.add("N03_light_series", lambda t: round_all(lights.stats(annual(t), last_a=LAST_A), "mean_light", "max_light", "sum_light"), "signals",
          LIGHT_SQL + f" SELECT yr, {r('avg(light)')} AS mean_light, {r('max(light)')} AS max_light, {r('sum(light)')} AS sum_light, {SENSOR} AS sensor FROM li GROUP BY 1")
    q.add("N04_light_change", lambda t: lights.change(annual(t), 1995, 1998, LAST_A).unionByName(lights.change(annual(t), 1999, 2001, LAST_A)), "signals",
          LIGHT_SQL + " " + " UNION ALL ".join(
              f"SELECT cell_id, l2-l1 AS diff, (l2-l1)/CASE WHEN l1 IS NOT NULL THEN greatest(l1,0.01e0) END AS relative FROM (SELECT cell_id, max(light) FILTER (yr={a}) AS l1, "
              f"max(light) FILTER (yr={b}) AS l2 FROM li WHERE yr IN ({a},{b}) GROUP BY 1)" for a, b in ((1995, 1998), (1999, 2001))))
    q.add("N05_electrification", lambda t: lights.lit_area(annual(t), GRID.area(), LAST_A), "signals",
          LIGHT_SQL + f" SELECT yr, CAST(sum(CASE WHEN light>CASE WHEN yr<={LAST_A} THEN 3 ELSE 0.5 END THEN 900 ELSE 0 END) AS DOUBLE)/1e6 AS lit_km2 FROM li GROUP BY 1")
    q.add("N06_light_per_capita", lambda t: lights.per_capita(settlement.at_year(annual(t), t.settlement, ["population"], EPOCHS)).select(
        "cell_id", "yr", "light_per_capita"), "signals settlement",
        LIGHT_SQL + f" SELECT li.cell_id, yr, light/greatest(CAST(population AS DOUBLE),1e0) AS light_per_capita FROM li JOIN settlement s ON s.cell_id=li.cell_id AND s.epoch={SNAP_SQL}")
    q.add("N07_city_lights", lambda t: round_all(lights.by_zone(annual(t), t.disc_cells, "disc", LAST_A), "mean_light", "max_light", "sum_light"),
          "cells discs signals", DISC_CELLS + "," + LIGHT_SQL + f""" SELECT disc, yr, {r('avg(light)')} AS mean_light, {r('max(light)')} AS max_light,
          {r('sum(light)')} AS sum_light, {SENSOR} AS sensor FROM li JOIN dc USING (cell_id) GROUP BY 1,2""")

    q.add("U01_settlement_layers", lambda t: settlement.layer_at(t.settlement, t.signals.select("yr").distinct(), EPOCHS).select(
        "cell_id", "yr", "built", "smod", "population"), "settlement signals",
        years + f" SELECT cell_id, yr, built, smod, population FROM yrs JOIN settlement ON epoch={SNAP_SQL}")
    q.add("U02_builtup_series", lambda t: settlement.builtup_series(t.settlement), "settlement",
          "SELECT epoch, CAST(sum(built) AS DOUBLE)/1e6 AS built_km2 FROM settlement GROUP BY 1")
    pairs = ((1990, 1995), (1995, 2000), (1990, 2000), (1990, 1991))
    snap = {1990: 1990, 1991: 1990, 1995: 1995, 2000: 2000}
    q.add("U03_urbanisation_rate", lambda t: settlement.urbanisation_rate(t.settlement, pairs, EPOCHS), "settlement", " UNION ALL ".join(
        f"SELECT {a} AS year1, {b} AS year2, d AS change_km2, d/{b - a} AS km2_per_year, {int(snap[a] == snap[b])} AS same_epoch FROM (SELECT CAST(sum(built) FILTER (epoch={snap[b]}) "
        f"- sum(built) FILTER (epoch={snap[a]}) AS DOUBLE)/1e6 AS d FROM settlement)" for a, b in pairs))
    q.add("U04_urban_expansion", lambda t: settlement.expansion(t.settlement, 1990, 2000, EPOCHS, 5000), "settlement",
          """SELECT a.cell_id, CAST(b.built>5000 AND NOT a.built>5000 AS INT) AS new_urban, CAST(a.built>5000 AND NOT b.built>5000 AS INT) AS lost_urban
          FROM settlement a JOIN settlement b ON a.cell_id=b.cell_id AND a.epoch=1990 AND b.epoch=2000""")
    q.add("U05_settlement_classes", lambda t: settlement.class_areas(t.settlement, c("area_m2")), "settlement", " UNION ALL ".join(
        f"SELECT epoch, {k} AS class, '{n}' AS class_name, {km2(f'smod={k}')} AS area_km2 FROM settlement GROUP BY 1" for k, n in SMOD_CLASSES.items()))
    city = DISC_CELLS + " SELECT disc, epoch, CAST(sum(built) AS DOUBLE)/1e6 AS built_km2 FROM settlement JOIN dc USING (cell_id) GROUP BY 1,2"
    q.add("U06_city_growth", lambda t: settlement.growth_by_zone(t.settlement, t.disc_cells, "disc"), "cells discs settlement", city)

    cons = MODE_SQL + """, co AS (SELECT b.cell_id, a.yr AS year1, b.yr AS year2, CAST(a.label<>6 AND b.label=6 AS INT) AS n, CAST(a.label=6 AND b.label<>6 AS INT) AS d
        FROM md a JOIN md b ON b.cell_id=a.cell_id AND b.yr=a.yr+1)"""
    q.add("J01_construction_series", lambda t: settlement.construction_areas(settlement.construction(modes(t)), GRID.area()), "classes",
          cons + " SELECT year1, year2, CAST(sum(n*900) AS DOUBLE)/1e6 AS new_construction_km2, CAST(sum(d*900) AS DOUBLE)/1e6 AS demolished_km2 FROM co GROUP BY 1,2")
    q.add("J02_spectral_construction", lambda t: settlement.spectral_construction(
        acq.yearly_composite(t.obs, bands=("red", "nir", "swir1")), 1996, 2000), "obs",
        f"""comp AS (SELECT cell_id, yr, {MEDIANS} FROM obs WHERE (qa&24)=0 AND yr IN (1996,2000) GROUP BY 1,2),
        ix AS (SELECT cell_id, yr, {nd('swir1','nir')} AS b, {nd('nir','red')} AS v FROM comp)
        SELECT k.cell_id, CAST(q.b-p.b>0.1e0 AS INT)*CAST(p.v-q.v>0.1e0 AS INT) AS construction FROM (SELECT DISTINCT cell_id FROM ix) k
        LEFT JOIN ix p ON p.cell_id=k.cell_id AND p.yr=1996 LEFT JOIN ix q ON q.cell_id=k.cell_id AND q.yr=2000""")
    def economic(t):
        return settlement.growth_by_zone(t.settlement, economic_cells(t), "zone")
    listed = [[p.strip() for p in line.split("|")] for line in ECONOMIC_ZONES.strip().splitlines()]
    values = ", ".join(f"('{n}', {lat}, {lon}, {radius})" for n, lat, lon, radius in listed)
    q.add("J03_economic_zones", economic, "cells settlement", f"""ez AS (SELECT zone, round(lon-88.0) AS cx, round(26.7-lat) AS cy,
        greatest(round(radius/111320.0),1) AS r FROM (VALUES {values}) v(zone, lat, lon, radius))
        SELECT zone, epoch, CAST(sum(built) AS DOUBLE)/1e6 AS built_km2 FROM settlement s JOIN ez
        ON (s.x-cx)*(s.x-cx)+(s.y-cy)*(s.y-cy)<=r*r GROUP BY 1,2""")
    q.add("J04_buildup_density", lambda t: settlement.buildup_density(t.settlement, 10, tile=16), "settlement",
          """SELECT a.epoch, a.cell_id, CAST(sum(b.built) AS DOUBLE)/1e6 AS density_km2 FROM settlement a JOIN settlement b ON a.epoch=b.epoch
          AND b.x BETWEEN a.x-10 AND a.x+10 AND b.y BETWEEN a.y-10 AND a.y+10 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=100 GROUP BY 1,2""")
    q.add("J05_connectivity", lambda t: round_all(transport.connectivity(raster(t), c("yr"), ["yr"], 1000.0, 9500.0).select(
        "cell_id", "yr", "connectivity"), "connectivity"), "settlement signals",
        RASTER_SQL + ", m AS (SELECT cell_id, yr, x, y, CAST(built>9500 AS INT) AS w FROM ra), "
        f"dd AS (SELECT a.cell_id, a.yr, {nearest_sql('m', '1e9', 'yr')} AS d FROM m a) SELECT cell_id, yr, CAST(CAST(round({clamp('((1-' + norm('d*1000e0', 0, 50000) + ')*(' + norm('light', 0, 63) + '+0.1e0))', 0, 1)},10) AS FLOAT) AS DOUBLE)+0e0 AS connectivity FROM ra JOIN dd USING (cell_id, yr)")
    q.add("J06_construction_hotspots", lambda t: settlement.hotspots(
        GRID.attach(settlement.construction_between(modes(t), 1996, 2000)), 6), "classes",
        MODE_SQL + """, co AS (SELECT p.cell_id, CAST(p.cell_id%64 AS INT) AS x, CAST(floor(p.cell_id/64) AS INT) AS y, CAST(p.c1<>6 AS INT)*CAST(p.c2=6 AS INT) AS w FROM
          (SELECT cell_id, max(label) FILTER (yr=1996) AS c1, max(label) FILTER (yr=2000) AS c2 FROM md WHERE yr IN (1996,2000) GROUP BY 1) p),
        de AS (SELECT a.cell_id, CAST(coalesce(sum(b.w),0) AS DOUBLE) AS density FROM co a JOIN co b ON b.x BETWEEN a.x-6 AND a.x+6 AND b.y BETWEEN a.y-6 AND a.y+6
          AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=36 GROUP BY 1),
        th AS (SELECT quantile_cont(density,0.75) AS threshold FROM de WHERE density>0)
        SELECT cell_id, density, threshold, CAST(density>=threshold AS INT) AS hotspot FROM de, th""")

    q.add("T01_settlement_masks", lambda t: transport.settlement_areas(t.settlement, c("area_m2")), "settlement",
          f"SELECT epoch, {km2('smod>=22')} AS urban_km2, {km2('smod=21')} AS peri_urban_km2, {km2('smod=13')} AS rural_cluster_km2, {km2('smod IN (11,12)')} AS low_density_km2 FROM settlement GROUP BY 1")
    q.add("T02_accessibility", lambda t: round_all(transport.accessibility(raster(t), ["yr"]).select("cell_id", "yr", "accessibility"), "accessibility"),
          "settlement signals", RASTER_SQL + ", m AS (SELECT cell_id, yr, x, y, CAST(smod>=22 AS INT) AS w FROM ra), "
          f"dd AS (SELECT a.cell_id, a.yr, {nearest_sql('m', '1e9', 'yr')} AS d FROM m a) SELECT cell_id, yr, CAST(CAST(round({clamp('(' + norm('light', 0, 50) + '*0.4e0+' + norm('population', 0, 5000) + '*0.4e0+(1-' + norm('d*1000e0', 0, 100000) + ')*0.2e0)', 0, 1)},10) AS FLOAT) AS DOUBLE)+0e0 AS accessibility FROM ra JOIN dd USING (cell_id, yr)")
    under = RASTER_SQL + f", un AS (SELECT *, {clamp('(' + norm('population', 0, 5000) + '*(1-' + norm('light', 0, 50) + '))', 0, 1)} AS ui FROM ra)"
    q.add("T03_underserved", lambda t: round_all(transport.underserved_population(transport.underserved(raster(t)), keys=["yr"]), "threshold"), "settlement signals",
          under + """, th AS (SELECT yr, quantile_cont(ui,0.6) AS threshold FROM un GROUP BY 1), hit AS (SELECT * FROM un JOIN th USING (yr) WHERE ui>=threshold)
          SELECT yr, CAST(CAST(round(max(threshold),10) AS FLOAT) AS DOUBLE)+0e0 AS threshold, count(*) AS cells, CAST(sum(population) AS BIGINT) AS population_at_risk FROM hit GROUP BY yr""")
    q.add("T04_connectivity_gap", lambda t: round_all(transport.gap_by_zone(transport.underserved(raster(t)), t.zone_cells, ["division", "yr"]), "mean_gap", "p75_gap"),
          "cells zones settlement signals", ZONE_CELLS + "," + under
          + " SELECT division, yr, CAST(CAST(round(avg(ui),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_gap, CAST(CAST(round(quantile_cont(ui,0.75),10) AS FLOAT) AS DOUBLE)+0e0 AS p75_gap FROM un JOIN zc USING (cell_id) GROUP BY 1,2")
    q.add("T05_market_access", lambda t: round_all(transport.market_access(raster(t), ["yr"], bright=50.0).select("cell_id", "yr", "light_gradient", "market_access"),
                                                   "light_gradient", "market_access"), "settlement signals",
          RASTER_SQL + f""", m AS (SELECT cell_id, yr, x, y, CAST(light>50 AS INT) AS w FROM ra), dd AS (SELECT a.cell_id, a.yr, {nearest_sql('m', '1e9', 'yr')} AS d FROM m a),
          g AS (SELECT a.cell_id, a.yr, a.x, a.y, sum(b.light*exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/4.5e0))/
            sum(exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/4.5e0)) AS s FROM ra a JOIN ra b ON b.yr=a.yr AND b.light IS NOT NULL AND b.x BETWEEN a.x-3 AND a.x+3 AND b.y BETWEEN a.y-3 AND a.y+3 GROUP BY 1,2,3,4),
          sb AS (SELECT a.cell_id, a.yr, count(*) AS n, sum(b.s*(b.x-a.x)*(2-abs(b.y-a.y))) AS gx, sum(b.s*(a.y-b.y)*(2-abs(b.x-a.x))) AS gy FROM g a
            JOIN g b ON b.yr=a.yr AND b.x BETWEEN a.x-1 AND a.x+1 AND b.y BETWEEN a.y-1 AND a.y+1 GROUP BY 1,2)
          SELECT ra.cell_id, ra.yr, CASE WHEN n=9 THEN CAST(CAST(round(sqrt(gx*gx+gy*gy),10) AS FLOAT) AS DOUBLE)+0e0 END AS light_gradient, CAST(CAST(round(1-{norm('d*1000e0', 0, 80000)},10) AS FLOAT) AS DOUBLE)+0e0 AS market_access
          FROM ra JOIN dd USING (cell_id, yr) LEFT JOIN sb USING (cell_id, yr)""")
    q.add("T06_clamped_inputs", lambda t: transport.annual_light(t.signals, t.spark.range(1993, 2004).select(c("id").cast("int").alias("yr")), 1996, 2000).groupBy("yr").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("light").alias("light")), "signals",
        f"""l AS (SELECT cell_id, yr AS y, quantile_cont(light_dn,0.5) AS light FROM signals WHERE {CALENDAR} AND yr BETWEEN 1996 AND 2000 GROUP BY 1,2),
        w AS (SELECT CAST(unnest(range(1993,2004)) AS INT) AS yr) SELECT w.yr, count(*) AS cells, sum(light) AS light FROM w JOIN l ON l.y=greatest(least(w.yr,2000),1996) GROUP BY 1""")
