"""Composite indices and kilns (X-*, B-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import DISC_CELLS, MEDIANS, ZONE_CELLS, clamp, km2, nd, norm, r, seasonal
from gridlake.catalog.climate import LST_SQL, NDVI_SQL, qa
from gridlake.catalog.coast import round_all
from gridlake.catalog.lights import LAST_A, LIGHT_SQL, SNAP_SQL
from gridlake.catalog.primitives import TEXTURE_SQL
from gridlake.catalog.water import SEASON_W
from gridlake.functions import algebra as A
from gridlake.model import DRY, HEAT_SEASON, KILN_SPECTRAL, KILN_THERMAL, MONSOON, POLLUTION_SEASON
from gridlake.operators import temporal
from gridlake.plans import acquisition as acq
from gridlake.plans import climate, composite, floods, kilns, settlement, vegetation
from gridlake.session import tasks_for
from gridlake.sources.fixtures import EPOCHS, GRID

c = F.col
NO2, AEROSOL = 4e-7, 0.02   # stored integers to mol/m2 and index units
XY = "CAST(cell_id % 64 AS INT) AS x, CAST(floor(cell_id/64) AS INT) AS y"


def inputs(t):
    """(cell, yr): light, settlement layers of the nearest epoch, greenness."""
    return settlement.at_year(composite.yearly_inputs(t.signals, LAST_A), t.settlement, ["built", "population", "smod"], EPOCHS).drop("lst_day")


INPUT_SQL = LIGHT_SQL + "," + NDVI_SQL + f""", inp AS (SELECT li.cell_id, li.yr, light, built, population, smod, ndvi FROM li
    JOIN settlement s ON s.cell_id=li.cell_id AND s.epoch={SNAP_SQL.replace('yr', 'li.yr')} LEFT JOIN nv ON nv.cell_id=li.cell_id AND nv.yr=li.yr)"""
LNORM = f"(CASE WHEN yr<={LAST_A} THEN {norm('light', 0, 63)} ELSE {norm('light', 0, 200)} END)"
DEP_SQL = INPUT_SQL + f", dep AS (SELECT cell_id, yr, ((1e0-{LNORM})+(1e0-{clamp('(built/10000e0)', 0, 1)})+{norm('population', 0, 25000)}*(1e0-{LNORM})+(1e0-{norm('ndvi', 0, 0.9)}))/4e0 AS d FROM inp)"


def deprivation(t):
    return composite.deprivation_index(inputs(t), LAST_A)


def lst(t):
    return GRID.attach(climate.annual_lst(t.signals, bands=("day",))).drop("area_m2")


DENSITY_SQL = """bd AS (SELECT a.epoch, a.cell_id, CAST(sum(b.built) AS DOUBLE)/count(*) AS building_density FROM settlement a JOIN settlement b ON a.epoch=b.epoch
    AND b.x BETWEEN a.x-5 AND a.x+5 AND b.y BETWEEN a.y-5 AND a.y+5 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=25 GROUP BY 1,2)"""
ANOM_SQL = LST_SQL + f""", lx AS (SELECT cell_id, yr, {XY}, lst_day FROM ls), la AS (SELECT a.cell_id, a.yr, any_value(a.lst_day)-avg(b.lst_day) AS lst_anomaly FROM lx a JOIN lx b ON a.yr=b.yr
    AND b.x BETWEEN a.x-5 AND a.x+5 AND b.y BETWEEN a.y-5 AND a.y+5 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=25 GROUP BY 1,2)"""


def slum(t):
    """The layers pass through the discs beside their values, so that years and epochs are joined once."""
    layers = composite.building_density(t.settlement, 5, beside=["built", "population", "smod"], tasks=tasks_for(t.spark, t.settlement.count()))
    yearly = GRID.attach(composite.yearly_inputs(t.signals, LAST_A)).drop("area_m2")
    df = settlement.at_year(composite.temperature_anomaly(yearly, 5, tasks=tasks_for(t.spark, t.signals.count(), 2_000_000)), layers, ["built", "population", "smod", "building_density"], EPOCHS)
    return composite.settlement_index(df, LAST_A).select("cell_id", "yr", "slum_index")


CROWD = norm("(population/greatest(CAST(built AS DOUBLE),1e0))", 0, 0.1)
LDEF = f"(1e0-{clamp(f'({LNORM}/greatest({norm('built', 0, 10000)},0.01e0))', 0, 1)})"
VDEF = f"(1e0-{clamp('ndvi', 0, 0.6)}/0.6e0)"
SLUM_SQL = (INPUT_SQL + "," + DENSITY_SQL + "," + ANOM_SQL + f""", sl AS (SELECT i.cell_id, i.yr, CASE WHEN smod>=21 THEN {norm('building_density', 0, 5000)}*0.25e0+{VDEF}*0.2e0+{CROWD}*0.25e0
    +{norm('lst_anomaly', -5, 5)}*0.15e0+{LDEF}*0.15e0 END AS v FROM (SELECT *, {SNAP_SQL} AS ep FROM inp) i JOIN bd ON bd.cell_id=i.cell_id AND bd.epoch=i.ep LEFT JOIN la ON la.cell_id=i.cell_id AND la.yr=i.yr)""").replace(
        "CASE WHEN yr<=" + str(LAST_A) + " THEN (CASE WHEN ((light", "CASE WHEN i.yr<=" + str(LAST_A) + " THEN (CASE WHEN ((light")


def waterlog(t):
    return floods.seasonal_masks(t.obs).select("cell_id", "yr", c("flood").alias("waterlog"))


def pollution(t):
    return composite.pollution_risk(t.signals, qa(), NO2, AEROSOL, 1996)


POLLUTION_SQL = f"""pz AS ({seasonal('signals', POLLUTION_SEASON)}), pm AS (SELECT cell_id, sy AS yr, avg(no2_dn) FILTER (qa_pct>=75)*4e-7 AS n, avg(aai_dn) FILTER (qa_pct>50 AND aai_dn>0)*0.02e0 AS a FROM pz GROUP BY 1,2),
    po AS (SELECT cell_id, CAST(yr AS INT) AS yr, ({norm('n', 0, 0.0002)}+{norm('a', -1, 3)})/2e0 AS pollution_risk FROM pm WHERE yr>=1996)"""
HEAT_SQL = f"hz AS ({seasonal('signals', HEAT_SEASON)}), ht AS (SELECT cell_id, CAST(sy AS INT) AS yr, CAST(sum(CAST(lst_day_dn*0.02e0+(-273.15e0)>40e0 AS INT)) AS BIGINT) AS hot_images FROM hz GROUP BY 1,2)"


def health(t, without=()):
    df = inputs(t).join(waterlog(t), ["cell_id", "yr"], "left").join(composite.heat_count(t.signals), ["cell_id", "yr"], "left")
    df = df.join(pollution(t), ["cell_id", "yr"], "left")
    return composite.health_index(df, without)


HEALTH_SQL = INPUT_SQL + "," + SEASON_W + "," + POLLUTION_SQL + "," + HEAT_SQL + """, hi AS (SELECT i.*, fl.w AS waterlog, hot_images, pollution_risk FROM inp i
    LEFT JOIN fl ON fl.cell_id=i.cell_id AND fl.yr=i.yr LEFT JOIN ht ON ht.cell_id=i.cell_id AND ht.yr=i.yr LEFT JOIN po ON po.cell_id=i.cell_id AND po.yr=i.yr)"""
HEALTH_PARTS = [("waterlog*1e0", 0.25), (norm("hot_images", 0, 90), 0.2), (norm("population", 0, 10000), 0.2), ("pollution_risk", 0.2), (VDEF, 0.15)]


def weighted_sql(parts):
    total = sum(w for _, w in parts)
    return "+".join(f"{e}*{w / total!r}::DOUBLE" for e, w in parts)


KLST_SQL = f"kz AS ({seasonal('signals', KILN_THERMAL)}), kl AS (SELECT cell_id, CAST(sy AS INT) AS yr, avg(lst_day_dn)*0.02e0+(-273.15e0) AS lst_c FROM kz GROUP BY 1,2), kb AS (SELECT yr, avg(lst_c)+2e0*stddev_pop(lst_c) AS threshold FROM kl GROUP BY 1), kh AS (SELECT cell_id, yr, lst_c, threshold, CAST(lst_c>=threshold AS INT) AS hotspot FROM kl JOIN kb USING (yr))"
KSPEC_SQL = (f"ks AS ({seasonal('obs', KILN_SPECTRAL)}), kc AS (SELECT cell_id, CAST(sy AS INT) AS yr, {MEDIANS} FROM ks WHERE scene_cloud_pct<20 AND sensor_no=CASE WHEN sy>=2014 THEN 2 WHEN sy>=2000 THEN 1 ELSE 0 END GROUP BY 1,2), "
             f"km AS (SELECT cell_id, yr, CAST({nd('(swir1+red)', '(nir+blue)')}>0.05e0 AS INT)*CAST(swir1/nullif(nir,0)>1e0 AS INT)*CAST({nd('nir','red')}<0.2e0 AS INT)*CAST(cell_id IN (SELECT cell_id FROM dc) AS INT) AS kiln FROM kc)")


def hot(t):
    return kilns.hotspots(kilns.dry_lst(t.signals))


def kiln_composite(t):
    y = c("yr")
    return kilns.season_composite(t.obs, F.when(y >= 2014, 2).when(y >= 2000, 1).otherwise(0))


def kiln_mask(t):
    return kilns.spectral_mask(kiln_composite(t), t.disc_cells)


def register(q):
    def x01(t):
        crop = composite.cropland_fraction(t.cells, 5)
        return inputs(t).join(crop, "cell_id").select("cell_id", "yr", "light", composite.built_fraction(c("built")).alias("built_fraction"), "ndvi", "cropland_fraction")
    q.add("X01_deprivation_inputs", x01, "cells settlement signals", INPUT_SQL + f""", cf AS (SELECT a.cell_id, CAST(sum(CAST(b.worldcover=40 AS INT)) AS DOUBLE)/count(*) AS cropland_fraction FROM cells a JOIN cells b
        ON b.x BETWEEN a.x-5 AND a.x+5 AND b.y BETWEEN a.y-5 AND a.y+5 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=25 GROUP BY 1)
        SELECT inp.cell_id, yr, light, {clamp('(built/10000e0)', 0, 1)} AS built_fraction, ndvi, cropland_fraction FROM inp JOIN cf USING (cell_id)""")
    q.add("X02_deprivation_index", lambda t: round_all(deprivation(t).select("cell_id", "yr", "deprivation"), "deprivation"), "settlement signals",
          DEP_SQL + " SELECT cell_id, yr, CAST(CAST(round(d,10) AS FLOAT) AS DOUBLE)+0e0 AS deprivation FROM dep")
    q.add("X03_deprivation_levels", lambda t: deprivation(t).select("cell_id", "yr", composite.deprivation_level(F.round("deprivation", 10)).alias("level")), "settlement signals",
          DEP_SQL + " SELECT cell_id, yr, CASE WHEN d IS NULL THEN NULL WHEN round(d,10)<0.25 THEN 1 WHEN round(d,10)<0.5 THEN 2 WHEN round(d,10)<0.75 THEN 3 ELSE 4 END AS level FROM dep")
    q.add("X04_division_stats", lambda t: round_all(composite.stats_by_zone(deprivation(t), "deprivation", t.zone_cells, "division"), "mean", "median"), "cells zones settlement signals",
          ZONE_CELLS + "," + DEP_SQL + " SELECT division, yr, CAST(CAST(round(avg(d),10) AS FLOAT) AS DOUBLE)+0e0 AS mean, CAST(CAST(round(quantile_cont(d,0.5),10) AS FLOAT) AS DOUBLE)+0e0 AS median FROM dep JOIN zc USING (cell_id) GROUP BY 1,2")
    q.add("X05_index_change", lambda t: round_all(composite.index_change(deprivation(t), "deprivation", 1996, 2000), "change"), "settlement signals",
          DEP_SQL + " SELECT cell_id, CAST(CAST(round(max(d) FILTER (yr=2000)-max(d) FILTER (yr=1996),10) AS FLOAT) AS DOUBLE)+0e0 AS change FROM dep WHERE yr IN (1996,2000) GROUP BY 1")
    q.add("X06_zone_ranking", lambda t: round_all(composite.zone_ranking(deprivation(t), "deprivation", t.zone_cells, "zone"), "mean"), "cells zones settlement signals",
          ZONE_CELLS + "," + DEP_SQL + """, zm AS (SELECT zone, yr, avg(d) AS m FROM dep JOIN zc USING (cell_id) GROUP BY 1,2)
          SELECT zone, yr, CAST(CAST(round(m,10) AS FLOAT) AS DOUBLE)+0e0 AS mean, CAST(row_number() OVER (PARTITION BY yr ORDER BY round(m,9) DESC, zone) AS INT) AS rank FROM zm""")
    q.add("X08_building_density", lambda t: composite.building_density(t.settlement, 5), "settlement", DENSITY_SQL + " SELECT epoch, cell_id, building_density FROM bd")
    q.add("X09_vegetation_deficit", lambda t: vegetation.annual_max(t.signals).select("cell_id", "yr", composite.vegetation_deficit(c("ndvi")).alias("veg_deficit")), "signals",
          NDVI_SQL + f" SELECT cell_id, yr, {VDEF} AS veg_deficit FROM nv")
    q.add("X10_texture_entropy", lambda t: round_all(composite.texture(GRID.attach(acq.seasonal_composite(t.obs, (DRY,), bands=("nir",)).withColumn("nir", c("nir") / 1000))).select(
        "cell_id", "yr", "entropy"), "entropy"), "obs", f"dz AS ({seasonal('obs', DRY)}), v0 AS (SELECT cell_id, CAST(sy AS INT) AS yr, {XY}, CAST(trunc(quantile_cont(nir,0.5)/1000) AS INT) AS v FROM dz WHERE (qa&24)=0 GROUP BY 1,2,3,4), "
        "v AS (SELECT CAST(yr AS BIGINT)*10000000+cell_id AS cell_id, x, yr*100000+y AS y, v FROM v0)," + TEXTURE_SQL
        + f" SELECT cell_id%10000000 AS cell_id, CAST(cell_id//10000000 AS INT) AS yr, {r('entropy')} AS entropy FROM v LEFT JOIN ent USING (cell_id)")
    q.add("X11_lst_anomaly", lambda t: round_all(composite.temperature_anomaly(lst(t), 5).select("cell_id", "yr", "lst_anomaly"), "lst_anomaly"), "signals",
          ANOM_SQL + f" SELECT cell_id, yr, {r('lst_anomaly')} AS lst_anomaly FROM la")
    q.add("X12_overcrowding", lambda t: t.settlement.select("cell_id", "epoch", composite.overcrowding(c("population"), c("built")).alias("overcrowding")), "settlement",
          f"SELECT cell_id, epoch, {CROWD} AS overcrowding FROM settlement")
    q.add("X13_light_deficit", lambda t: inputs(t).select("cell_id", "yr", composite.light_deficit(composite.L.light_norm(c("light"), c("yr"), LAST_A), c("built")).alias("light_deficit")), "settlement signals",
          INPUT_SQL + f" SELECT cell_id, yr, {LDEF} AS light_deficit FROM inp")
    q.add("X14_settlement_index", lambda t: round_all(slum(t), "slum_index"), "settlement signals", SLUM_SQL + " SELECT cell_id, yr, CAST(CAST(round(v,10) AS FLOAT) AS DOUBLE)+0e0 AS slum_index FROM sl")
    q.add("X15_risk_classes", lambda t: slum(t).select("cell_id", "yr", composite.risk_class(F.round("slum_index", 10)).alias("risk")), "settlement signals",
          SLUM_SQL + ", rr AS (SELECT cell_id, yr, round(v,10) AS v FROM sl) SELECT cell_id, yr, CASE WHEN v IS NULL THEN 0 WHEN v<0.3 THEN 1 WHEN v<0.5 THEN 2 WHEN v<0.7 THEN 3 ELSE 4 END AS risk FROM rr")
    q.add("X16_index_area", lambda t: composite.index_area(slum(t), GRID.area(), 0.5), "settlement signals",
          SLUM_SQL + " SELECT yr, CAST(sum(CASE WHEN v>0.5 THEN 900 WHEN v IS NOT NULL THEN 0 END) AS DOUBLE)/1e6 AS slum_km2 FROM sl GROUP BY 1")
    q.add("X16b_index_growth", lambda t: composite.index_growth(slum(t), GRID.area(), 1996, 2000, 0.5), "settlement signals",
          SLUM_SQL + """, w AS (SELECT cell_id, CAST(max(v) FILTER (yr=1996)>0.5 AS INT) AS s1, CAST(max(v) FILTER (yr=2000)>0.5 AS INT) AS s2 FROM sl WHERE yr IN (1996,2000) GROUP BY 1)
          SELECT CAST(sum(s2*(1-s1)*900) AS DOUBLE)/1e6 AS new_slum_km2, CAST(sum(s1*(1-s2)*900) AS DOUBLE)/1e6 AS cleared_slum_km2 FROM w""")
    q.add("X17_known_areas", lambda t: round_all(composite.known_areas(slum(t), t.disc_cells, "disc"), "mean_index", "max_index"), "cells discs settlement signals",
          DISC_CELLS + "," + SLUM_SQL + " SELECT disc, yr, CAST(CAST(round(avg(v),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_index, CAST(CAST(round(max(v),10) AS FLOAT) AS DOUBLE)+0e0 AS max_index FROM sl JOIN dc USING (cell_id) GROUP BY 1,2")
    q.add("X18_waterlogging", waterlog, "obs", SEASON_W + " SELECT s.cell_id, s.yr, fl.w AS waterlog FROM (SELECT DISTINCT cell_id, yr FROM sw) s LEFT JOIN fl ON fl.cell_id=s.cell_id AND fl.yr=s.yr")
    q.add("X19_heat_stress", lambda t: composite.heat_count(t.signals), "signals", HEAT_SQL + " SELECT * FROM ht")

    def x20(t):
        comp = acq.seasonal_composite(t.obs, (MONSOON,), bands=("nir", "swir1")).drop("season")
        mode = temporal.mode_value(temporal.assign_season(t.classes, MONSOON), ["cell_id", "yr"], "label")
        return composite.water_habitat(comp, mode)
    q.add("X20_water_habitat", x20, "obs classes", f"""mz AS ({seasonal('obs', MONSOON)}), mc AS (SELECT cell_id, CAST(sy AS INT) AS yr, {MEDIANS} FROM mz WHERE (qa&24)=0 GROUP BY 1,2),
        cz AS ({seasonal('classes', MONSOON)}), cm AS (SELECT cell_id, sy, label FROM (SELECT cell_id, sy, label, row_number() OVER (PARTITION BY cell_id, sy ORDER BY count(*) DESC, label) AS rn FROM cz GROUP BY 1,2,3) WHERE rn=1)
        SELECT mc.cell_id, mc.yr, CAST(CAST({nd('nir','swir1')}>0 AS INT)+CAST(label=3 AS INT)>0 AS INT) AS habitat FROM mc JOIN cm ON cm.cell_id=mc.cell_id AND cm.sy=mc.yr""")
    q.add("X21_pollution_risk", lambda t: round_all(pollution(t), "pollution_risk"), "signals", POLLUTION_SQL + " SELECT cell_id, yr, CAST(CAST(round(pollution_risk,10) AS FLOAT) AS DOUBLE)+0e0 AS pollution_risk FROM po")
    q.add("X22_hazard_map", lambda t: composite.hazard_map(t.cells, t.disc_cells), "cells discs",
          DISC_CELLS + " SELECT cell_id, CAST(cell_id IN (SELECT cell_id FROM dc) AS INT) AS hazard FROM cells")
    q.add("X23_health_index", lambda t: round_all(health(t).select("cell_id", "yr", "health_risk"), "health_risk"), "obs settlement signals",
          HEALTH_SQL + f" SELECT cell_id, yr, CAST(CAST(round({weighted_sql(HEALTH_PARTS)},10) AS FLOAT) AS DOUBLE)+0e0 AS health_risk FROM hi")
    q.add("X23b_health_series", lambda t: round_all(health(t, ("pollution",)).groupBy("yr").agg(F.avg("health_risk").alias("mean_risk")), "mean_risk"), "obs settlement signals",
          HEALTH_SQL + f" SELECT yr, CAST(CAST(round(avg({weighted_sql(HEALTH_PARTS[:3] + HEALTH_PARTS[4:])}),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_risk FROM hi GROUP BY 1")

    q.add("B01_dry_season_lst", lambda t: kilns.dry_lst(t.signals), "signals", KLST_SQL + " SELECT cell_id, yr, lst_c FROM kl")
    q.add("B02_season_composite", lambda t: kiln_composite(t), "cells discs obs", DISC_CELLS + "," + KSPEC_SQL + " SELECT cell_id, yr, blue, red, nir, swir1 FROM kc")
    q.add("B03_thermal_hotspots", lambda t: round_all(kilns.hotspot_areas(hot(t), GRID.area()), "threshold"), "signals",
          KLST_SQL + f" SELECT yr, {r('max(threshold)')} AS threshold, CAST(sum(hotspot*900) AS DOUBLE)/1e6 AS hotspot_km2 FROM kh GROUP BY 1")
    q.add("B04_spectral_mask", lambda t: kilns.candidate_areas(kiln_mask(t), GRID.area()), "cells discs obs",
          DISC_CELLS + "," + KSPEC_SQL + " SELECT yr, CAST(sum(kiln*900) AS DOUBLE)/1e6 AS candidate_km2 FROM km GROUP BY 1")
    q.add("B05_zone_density", lambda t: round_all(kilns.density_by_zone(hot(t), t.zone_cells, "zone"), "hotspot_share"), "cells zones signals",
          ZONE_CELLS + "," + KLST_SQL + " SELECT zone, yr, CAST(sum(hotspot) AS BIGINT) AS hotspot_cells, CAST(CAST(round(avg(hotspot),10) AS FLOAT) AS DOUBLE)+0e0 AS hotspot_share FROM kh JOIN zc USING (cell_id) GROUP BY 1,2")
    ser = DISC_CELLS + "," + KLST_SQL + "," + KSPEC_SQL + """, ka AS (SELECT yr, CAST(sum(hotspot*900) AS DOUBLE)/1e6 AS hotspot_km2 FROM kh GROUP BY 1),
        kk AS (SELECT yr, CAST(sum(kiln*900) AS DOUBLE)/1e6 AS candidate_km2 FROM km GROUP BY 1), kse AS (SELECT yr, hotspot_km2, candidate_km2 FROM ka FULL JOIN kk USING (yr))"""

    def series(t):
        return kilns.series(kilns.hotspot_areas(hot(t), GRID.area()), kilns.candidate_areas(kiln_mask(t), GRID.area()))
    q.add("B06_kiln_series", series, "cells discs obs signals", ser + " SELECT * FROM kse")
    q.add("B07_emissions", lambda t: kilns.emissions(series(t)).select("yr", "kilns", "co2_tonnes", "pm25_tonnes"), "cells discs obs signals",
          ser + " SELECT yr, candidate_km2/0.04e0 AS kilns, candidate_km2/0.04e0*4600e0 AS co2_tonnes, candidate_km2/0.04e0*1.5e0 AS pm25_tonnes FROM kse")
