"""Air, climate, groundwater, soil and energy (AQ-*, K-*, G-*, S-*, E-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import DISC_CELLS, MEDIANS, ZONE_CELLS, clamp, km2, nd, norm, r, seasonal
from gridlake.catalog.coast import CALENDAR, round_all
from gridlake.catalog.lights import LAST_A, LIGHT_SQL, SNAP_SQL, annual as annual_lights
from gridlake.functions import algebra as A
from gridlake.model import AIR_SEASONS, DRY, RAIN_MONSOON, SOLAR_SEASONS
from gridlake.plans import acquisition as acq
from gridlake.plans import air, climate, energy, groundwater, settlement, soil, vegetation
from gridlake.sources.fixtures import EPOCHS, GRID

c = F.col
VALID = {"no2": "no2_dn) FILTER (qa_pct>=75", "so2": "so2_dn) FILTER (qa_pct>=50", "co": "co_dn) FILTER (qa_pct>=50",
         "aerosol": "aai_dn) FILTER (qa_pct>50 AND aai_dn>0", "hcho": "hcho_dn) FILTER (qa_pct>=50"}
POLL = ", ".join(f"avg({v}) AS {p}" for p, v in VALID.items())
YEARLY_AIR = f"ya AS (SELECT cell_id, yr, {POLL} FROM signals WHERE {CALENDAR} GROUP BY 1,2)"
RAIN_SQL = f"ra AS (SELECT cell_id, yr, CAST(sum(precip_dmm) AS DOUBLE)/10e0 AS rain_mm FROM signals WHERE {CALENDAR} GROUP BY 1,2)"
LST_SQL = (f"ls AS (SELECT cell_id, yr, avg(lst_day_dn) FILTER ((qc_day&3)=0)*0.02e0+(-273.15e0) AS lst_day, "
           f"avg(lst_night_dn) FILTER ((qc_night&3)=0)*0.02e0+(-273.15e0) AS lst_night FROM signals WHERE {CALENDAR} GROUP BY 1,2)")
NDVI_SQL = f"nv AS (SELECT cell_id, yr, max(ndvi_dn) FILTER (summary_qa<=1)*1e-4 AS ndvi FROM signals WHERE {CALENDAR} GROUP BY 1,2)"
SLOPE_SQL = """sp AS (SELECT a.cell_id, degrees(atan(sqrt(((e.elevation-w.elevation)/60e0)*((e.elevation-w.elevation)/60e0)+((s.elevation-n.elevation)/60e0)*((s.elevation-n.elevation)/60e0)))) AS slope
    FROM cells a JOIN cells e ON e.x=a.x+1 AND e.y=a.y JOIN cells w ON w.x=a.x-1 AND w.y=a.y JOIN cells n ON n.x=a.x AND n.y=a.y-1 JOIN cells s ON s.x=a.x AND s.y=a.y+1)"""


def qa():
    return c("qa_pct") / F.lit(100.0)


def yearly_air(t):
    return air.yearly(t.signals, qa(), reliable=None)


def soil_long(t):
    """Unpivoted soil properties at two depths."""
    rows = [F.struct(F.lit(d).alias("depth"), F.lit(p).alias("property"), (c(col) + k).alias("value"))
            for k, d in enumerate(("b0", "b10")) for p, col in (("clay", "clay"), ("sand", "sand"), ("soc", "soc"), ("ph", "ph10"))]
    return t.cells.select("cell_id", F.inline(F.array(*rows)))


def land_factors(t):
    """(cell, year) rows with soil, slope, rain and greenness."""
    static = soil.slope(t.cells.select("cell_id", "x", "y", "elevation", "clay", "soc", (c("ph10") / F.lit(10.0)).alias("ph"))).drop("x", "y")
    rain = climate.annual_rain(t.signals)
    green = vegetation.annual_max(t.signals).select("cell_id", "yr", "ndvi")
    return rain.join(green, ["cell_id", "yr"], "left").join(static, "cell_id")


FACTORS_SQL = RAIN_SQL + "," + NDVI_SQL + "," + SLOPE_SQL + """, fa AS (SELECT ra.cell_id, ra.yr, rain_mm, ndvi, clay, soc, ph10/10e0 AS ph, slope, elevation FROM ra
    LEFT JOIN nv ON nv.cell_id=ra.cell_id AND nv.yr=ra.yr JOIN cells c ON c.cell_id=ra.cell_id LEFT JOIN sp ON sp.cell_id=ra.cell_id)"""
DRYC_SQL = f"dz AS ({seasonal('obs', DRY)}), dc0 AS (SELECT cell_id, CAST(sy AS INT) AS yr, {MEDIANS} FROM dz WHERE (qa&24)=0 GROUP BY 1,2)"
PROXY = f"sqrt((blue*1e-4)*(red*1e-4))*(1e0-{clamp(nd('nir','red'), 0, 1)})"


EROSION = f"({norm('rain_mm', 500, 4000)}*0.3e0+({norm('clay', 0, 80)}+(1e0-{norm('soc', 0, 30)}))/2e0*0.2e0+{norm('slope', 0, 30)}*0.25e0+(1e0-{clamp('ndvi', 0, 0.8)}/0.8e0)*0.25e0)"
SUITABLE = f"(({norm('soc', 0, 20)}+{clamp('(1e0-greatest(abs(ph-6.5e0)-1e0,0e0)/2e0)', 0, 1)})/2e0*0.4e0+(1e0-{norm('slope', 0, 15)})*0.3e0+least({norm('rain_mm', 800, 1500)},{norm('rain_mm', 3000, 2000)})*0.3e0)"
SALT_RISK = f"({norm('p', 0, 0.3)}*CAST(elevation>=0 AND elevation<5 AS INT))"


def salinity(t):
    comp = acq.seasonal_composite(t.obs, (DRY,), bands=("blue", "red", "nir"))
    return comp.select("cell_id", "yr", soil.salinity_proxy().alias("salinity_proxy"))


def access(t):
    return energy.access(annual_lights(t), LAST_A)


ACCESS_SQL = LIGHT_SQL + f", ac AS (SELECT cell_id, yr, CASE WHEN yr<={LAST_A} THEN CAST(light>3 AS INT)*{norm('light', 0, 63)} ELSE CAST(light>0.5 AS INT)*{norm('light', 0, 200)} END AS energy_access FROM li)"


def register(q):
    q.add("AQ01_pollutant_composite", yearly_air, "signals", YEARLY_AIR + " SELECT * FROM ya")
    q.add("AQ02_pollutant_series", lambda t: round_all(air.stats(yearly_air(t), "no2"), "mean", "max", "median"), "signals",
          YEARLY_AIR + f" SELECT yr, {r('avg(no2)')} AS mean, {r('max(no2)')} AS max, {r('quantile_cont(no2,0.5)')} AS median FROM ya GROUP BY 1")
    names = [s.name for s in AIR_SEASONS]
    q.add("AQ03_seasonal_pollutant", lambda t: round_all(air.seasonal(t.signals, qa(), "so2"), *names), "signals",
          f"s AS ({seasonal('signals', AIR_SEASONS)}), pc AS (SELECT cell_id, sy, season, avg(so2_dn) FILTER (qa_pct>=50) AS v FROM s GROUP BY 1,2,3) SELECT CAST(sy AS INT) AS yr, "
          + ", ".join(f"CAST(CAST(round(avg(v) FILTER (season='{n}'),10) AS FLOAT) AS DOUBLE)+0e0 AS {n}" for n in names) + " FROM pc GROUP BY 1")
    q.add("AQ04_city_pollution", lambda t: round_all(air.by_zone(yearly_air(t), t.disc_cells, "disc", "no2"), "mean", "max", "median"), "cells discs signals",
          DISC_CELLS + "," + YEARLY_AIR + f" SELECT disc, yr, {r('avg(no2)')} AS mean, {r('max(no2)')} AS max, {r('quantile_cont(no2,0.5)')} AS median FROM ya JOIN dc USING (cell_id) GROUP BY 1,2")
    q.add("AQ05_pollution_hotspots", lambda t: round_all(air.hotspots(yearly_air(t).select("cell_id", "yr", "no2"), "no2").select("cell_id", "yr", "threshold", "hotspot"), "threshold"), "signals",
          YEARLY_AIR + f""", th AS (SELECT yr, quantile_cont(no2,0.9) AS threshold FROM ya GROUP BY 1)
          SELECT cell_id, yr, {r('threshold')} AS threshold, CAST(no2>=threshold AS INT) AS hotspot FROM ya JOIN th USING (yr)""")
    q.add("AQ06_pollutant_stack", lambda t: air.stack(t.signals, qa(), "1990-01-01", "2010-01-01", "1996-05-01", ("cell_id", "yr")), "signals",
          f"SELECT cell_id, yr, {POLL} FROM signals WHERE t>=DATE '1996-05-01' AND t<DATE '2010-01-01' GROUP BY 1,2")

    q.add("K01_lst_quality", lambda t: t.signals.groupBy("cell_id").agg(
        F.count(climate.quality_lst("day")).alias("day"), F.count(climate.quality_lst("night")).alias("night"), F.sum(climate.quality_lst("day")).alias("dn")), "signals",
        "SELECT cell_id, count(*) FILTER ((qc_day&3)=0) AS day, count(*) FILTER ((qc_night&3)=0) AS night, CAST(sum(lst_day_dn) FILTER ((qc_day&3)=0) AS BIGINT) AS dn FROM signals GROUP BY 1")
    q.add("K02_annual_rain", lambda t: climate.annual_rain(t.signals), "signals", RAIN_SQL + " SELECT * FROM ra")
    q.add("K02b_monthly_rain", lambda t: climate.monthly_rain(t.signals), "signals",
          "SELECT cell_id, yr, mo, CAST(sum(precip_dmm) AS DOUBLE)/10e0 AS rain_mm FROM signals GROUP BY 1,2,3")
    q.add("K02c_monsoon_rain", lambda t: round_all(climate.monsoon_rain(t.signals), "monsoon_mm"), "signals",
          f"s AS ({seasonal('signals', RAIN_MONSOON)}), pc AS (SELECT cell_id, sy, CAST(sum(precip_dmm) AS BIGINT) AS s FROM s GROUP BY 1,2) SELECT CAST(sy AS INT) AS yr, CAST(CAST(round(avg(s)/10e0,10) AS FLOAT) AS DOUBLE)+0e0 AS monsoon_mm FROM pc GROUP BY 1")
    q.add("K03_rain_series", lambda t: round_all(climate.rain_series(t.signals), "mean_mm", "max_mm"), "signals",
          RAIN_SQL + " SELECT yr, CAST(CAST(round(avg(rain_mm),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_mm, CAST(CAST(round(max(rain_mm),10) AS FLOAT) AS DOUBLE)+0e0 AS max_mm FROM ra GROUP BY 1")
    q.add("K04_rain_anomaly", lambda t: round_all(climate.rain_anomaly(t.signals, 1995, 2000), "anomaly_mm"), "signals",
          RAIN_SQL + """, b AS (SELECT cell_id, avg(rain_mm) AS m FROM ra WHERE yr BETWEEN 1995 AND 2000 GROUP BY 1)
          SELECT ra.cell_id, yr, CAST(CAST(round(rain_mm-m,10) AS FLOAT) AS DOUBLE)+0e0 AS anomaly_mm FROM ra JOIN b USING (cell_id)""")
    q.add("K05_lst_series", lambda t: round_all(climate.lst_series(t.signals), "day_c", "night_c"), "signals",
          LST_SQL + f" SELECT yr, {r('avg(lst_day)')} AS day_c, {r('avg(lst_night)')} AS night_c FROM ls GROUP BY 1")
    q.add("K06_heat_island", lambda t: round_all(climate.heat_island(climate.annual_lst(t.signals), t.cells, t.discs, c("r"), c("r") + 2, c("r") + 6),
                                                 "urban_c", "rural_c", "uhi_c"), "cells discs signals",
          LST_SQL + """, zz AS (SELECT disc, cell_id, 1 AS u FROM cells c JOIN discs d ON (c.x-cx)*(c.x-cx)+(c.y-cy)*(c.y-cy)<=r*r UNION ALL
          SELECT disc, cell_id, 0 FROM cells c JOIN discs d ON (c.x-cx)*(c.x-cx)+(c.y-cy)*(c.y-cy)>(r+2)*(r+2) AND (c.x-cx)*(c.x-cx)+(c.y-cy)*(c.y-cy)<=(r+6)*(r+6) WHERE worldcover IN (10,20,40)),
          g AS (SELECT disc, yr, avg(lst_day) FILTER (u=1) AS a, avg(lst_day) FILTER (u=0) AS b FROM ls JOIN zz USING (cell_id) GROUP BY 1,2)
          SELECT disc, yr, CAST(CAST(round(a,10) AS FLOAT) AS DOUBLE)+0e0 AS urban_c, CAST(CAST(round(b,10) AS FLOAT) AS DOUBLE)+0e0 AS rural_c, CAST(CAST(round(a-b,10) AS FLOAT) AS DOUBLE)+0e0 AS uhi_c FROM g""")
    q.add("K07_seasonal_temperature", lambda t: round_all(climate.seasonal_temperature(t.signals), *[f"{n}_c" for n in names]), "signals",
          f"s AS ({seasonal('signals', AIR_SEASONS)}), pc AS (SELECT cell_id, sy, season, avg(lst_day_dn) FILTER ((qc_day&3)=0) AS v FROM s GROUP BY 1,2,3) SELECT CAST(sy AS INT) AS yr, "
          + ", ".join(f"CAST(CAST(round(avg(v) FILTER (season='{n}')*0.02e0+(-273.15e0),10) AS FLOAT) AS DOUBLE)+0e0 AS {n}_c" for n in names) + " FROM pc GROUP BY 1")
    q.add("K08_drought", lambda t: round_all(climate.drought(t.signals, 1995, 2000, 1995), "drought"), "signals",
          RAIN_SQL + "," + LST_SQL + """, rb AS (SELECT cell_id, avg(rain_mm) AS m, stddev_pop(rain_mm) AS s FROM ra WHERE yr BETWEEN 1995 AND 2000 GROUP BY 1),
          lb AS (SELECT cell_id, avg(lst_day) AS m, stddev_pop(lst_day) AS s FROM ls WHERE yr BETWEEN 1995 AND 2000 GROUP BY 1),
          lt AS (SELECT ls.cell_id, yr, CASE WHEN lst_day IS NOT NULL THEN (lst_day-m)/greatest(s,0.5e0) END AS h FROM ls JOIN lb USING (cell_id))
          SELECT ra.cell_id, ra.yr, CAST(CAST(round((least(greatest((rain_mm-m)/greatest(s,50e0),-2e0),2e0)-h)/2e0,10) AS FLOAT) AS DOUBLE)+0e0 AS drought FROM ra JOIN rb ON rb.cell_id=ra.cell_id LEFT JOIN lt ON lt.cell_id=ra.cell_id AND lt.yr=ra.yr""")
    q.add("K10_rain_summary", lambda t: round_all(climate.rain_summary(t.signals), "annual_mm", "max_mm", "monsoon_mm"), "signals",
          """m AS (SELECT cell_id, yr, mo, CAST(sum(precip_dmm) AS DOUBLE)/10e0 AS v FROM signals GROUP BY 1,2,3), k AS (SELECT yr, mo, avg(v) AS a, max(v) AS x FROM m WHERE v>0 GROUP BY 1,2)
          SELECT yr, CAST(CAST(round(sum(a),10) AS FLOAT) AS DOUBLE)+0e0 AS annual_mm, CAST(CAST(round(max(x),10) AS FLOAT) AS DOUBLE)+0e0 AS max_mm, CAST(CAST(round(sum(a) FILTER (mo BETWEEN 6 AND 9),10) AS FLOAT) AS DOUBLE)+0e0 AS monsoon_mm FROM k GROUP BY 1""")
    q.add("K11_population_summary", lambda t: climate.population_summary(t.settlement, c("area_m2"), ["epoch"]), "settlement",
          "SELECT epoch, CAST(sum(population) AS BIGINT) AS population, CAST(sum(population) AS DOUBLE)/(CAST(count(*)*900 AS DOUBLE)/1e6) AS density_km2 FROM settlement WHERE population>0 GROUP BY 1")

    q.add("G01_storage_series", lambda t: round_all(groundwater.storage_series(t.signals), "mean_cm", "min_cm", "max_cm"), "signals",
          f"""pc AS (SELECT cell_id, yr, avg(tws_cm) AS v FROM signals WHERE {CALENDAR} GROUP BY 1,2), n AS (SELECT yr, count(DISTINCT t) AS scenes FROM signals WHERE {CALENDAR} GROUP BY 1)
          SELECT yr, CAST(CAST(round(avg(v),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_cm, CAST(CAST(round(min(v),10) AS FLOAT) AS DOUBLE)+0e0 AS min_cm, CAST(CAST(round(max(v),10) AS FLOAT) AS DOUBLE)+0e0 AS max_cm, any_value(scenes) AS scenes FROM pc JOIN n USING (yr) GROUP BY 1""")
    trend = "tr AS (SELECT cell_id, regr_slope(tws_cm,m) AS slope, regr_intercept(tws_cm,m) AS intercept FROM (SELECT cell_id, tws_cm, CAST((yr-2002)*12+mo-1 AS DOUBLE) AS m FROM signals) GROUP BY 1)"
    q.add("G02_storage_trend", lambda t: round_all(groundwater.trend(t.signals), "slope", "intercept"), "signals",
          trend + " SELECT cell_id, CAST(CAST(round(slope,10) AS FLOAT) AS DOUBLE)+0e0 AS slope, CAST(CAST(round(intercept,10) AS FLOAT) AS DOUBLE)+0e0 AS intercept FROM tr")
    q.add("G03_soil_moisture", lambda t: groundwater.soil_moisture(t.signals), "signals",
          f"SELECT cell_id, yr, avg(sm1+sm2+sm3+sm4)/10e0 AS sm_cm FROM signals WHERE {CALENDAR} GROUP BY 1,2")
    q.add("G04_surface_water", lambda t: groundwater.surface_water(t.signals), "signals",
          f"SELECT cell_id, yr, avg(CAST(water_month>=1 AS INT))*50e0 AS sw_cm FROM signals WHERE {CALENDAR} GROUP BY 1,2")
    q.add("G05_groundwater", lambda t: round_all(groundwater.decomposition(t.signals, 1996, 1999), "tws_cm", "sm_cm", "sw_cm", "gws_cm"), "signals",
          f"""pc AS (SELECT cell_id, yr, avg(tws_cm) AS tws, avg(sm1+sm2+sm3+sm4)/10e0 AS sm, avg(CAST(water_month>=1 AS INT))*50e0 AS sw FROM signals WHERE {CALENDAR} GROUP BY 1,2),
          b AS (SELECT cell_id, avg(sm) AS b FROM pc WHERE yr BETWEEN 1996 AND 1999 GROUP BY 1)
          SELECT yr, CAST(CAST(round(avg(tws),10) AS FLOAT) AS DOUBLE)+0e0 AS tws_cm, CAST(CAST(round(avg(sm-b),10) AS FLOAT) AS DOUBLE)+0e0 AS sm_cm, CAST(CAST(round(avg(sw),10) AS FLOAT) AS DOUBLE)+0e0 AS sw_cm, CAST(CAST(round(avg(tws-(sm-b)-sw),10) AS FLOAT) AS DOUBLE)+0e0 AS gws_cm FROM pc JOIN b USING (cell_id) GROUP BY 1""")
    q.add("G06_depletion_hotspots", lambda t: round_all(groundwater.depletion(groundwater.trend(t.signals), t.disc_cells, "disc", GRID.area(), -0.1),
                                                        "mean_slope", "min_slope"), "cells discs signals",
          DISC_CELLS + "," + trend + """ SELECT disc, CAST(CAST(round(avg(slope),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_slope, CAST(CAST(round(min(slope),10) AS FLOAT) AS DOUBLE)+0e0 AS min_slope,
          CAST(sum(CASE WHEN slope IS NULL THEN NULL WHEN slope < -0.1 THEN 900 ELSE 0 END) AS BIGINT) AS depleting_m2 FROM tr JOIN dc USING (cell_id) GROUP BY 1""")

    q.add("S01_soil_properties", lambda t: soil.properties(soil_long(t), "b10"), "cells",
          "SELECT cell_id, clay+1 AS clay, sand+1 AS sand, soc+1 AS soc, (ph10+1)/10e0 AS ph FROM cells")
    stats = [f"{p}_{n}" for p in soil.PROPERTIES for n in ("mean", "std")]
    q.add("S02_soil_stats", lambda t: round_all(soil.property_stats(soil.properties(soil_long(t), "b0").join(
        t.zone_cells.select("cell_id", "zone"), "cell_id"), ["zone"]), *stats), "cells zones", ZONE_CELLS + " SELECT zone, " + ", ".join(
            f"CAST(CAST(round({f}({p}),10) AS FLOAT) AS DOUBLE)+0e0 AS {n}_{m}" for n, p in (("clay", "clay"), ("sand", "sand"), ("soc", "soc"), ("ph", "ph10/10e0"))
            for m, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM cells JOIN zc USING (cell_id) GROUP BY 1")
    q.add("S03_slope", lambda t: round_all(soil.slope(t.cells.select("cell_id", "x", "y", "elevation")).select("cell_id", "slope"), "slope"), "cells",
          SLOPE_SQL + f" SELECT c.cell_id, {r('slope')} AS slope FROM cells c LEFT JOIN sp USING (cell_id)")
    q.add("S04_erosion_risk", lambda t: round_all(soil.erosion_risk(land_factors(t)).select("cell_id", "yr", "erosion_risk"), "erosion_risk"), "cells signals",
          FACTORS_SQL + f" SELECT cell_id, yr, CAST(CAST(round({EROSION},10) AS FLOAT) AS DOUBLE)+0e0 AS erosion_risk FROM fa")
    q.add("S05_salinity_proxy", lambda t: round_all(salinity(t), "salinity_proxy"), "obs",
          DRYC_SQL + f" SELECT cell_id, yr, CAST(CAST(round({PROXY},10) AS FLOAT) AS DOUBLE)+0e0 AS salinity_proxy FROM dc0")
    q.add("S06_salinity_risk", lambda t: round_all(salinity(t).join(t.cells.select("cell_id", "elevation"), "cell_id").select(
        "cell_id", "yr", soil.salinity_risk().alias("salinity_risk")), "salinity_risk"), "cells obs",
        DRYC_SQL + f", pr AS (SELECT cell_id, yr, {PROXY} AS p FROM dc0) SELECT cell_id, yr, CAST(CAST(round({SALT_RISK},10) AS FLOAT) AS DOUBLE)+0e0 AS salinity_risk FROM pr JOIN cells USING (cell_id)")
    q.add("S07_suitability", lambda t: round_all(soil.suitability(land_factors(t)).select("cell_id", "yr", "suitability"), "suitability"), "cells signals",
          FACTORS_SQL + f" SELECT cell_id, yr, CAST(CAST(round({SUITABLE},10) AS FLOAT) AS DOUBLE)+0e0 AS suitability FROM fa")

    irr = f"ir AS (SELECT cell_id, yr, avg(solar_mj)*1e6/2.628e6 AS irradiance FROM signals WHERE {CALENDAR} GROUP BY 1,2)"
    q.add("E01_solar_stats", lambda t: round_all(energy.solar_stats(energy.solar_irradiance(t.signals)), "mean_wm2", "max_wm2"), "signals",
          irr + f" SELECT yr, {r('avg(irradiance)')} AS mean_wm2, {r('max(irradiance)')} AS max_wm2 FROM ir GROUP BY 1")
    q.add("E02_solar_potential", lambda t: round_all(energy.solar_potential(t.signals, t.cells), "solar_potential"), "cells signals",
          irr + f""", s AS ({seasonal('signals', SOLAR_SEASONS)}), sm AS (SELECT cell_id, sy, avg(solar_mj) FILTER (season='dry')*1e6 AS d, avg(solar_mj) FILTER (season='monsoon')*1e6 AS m FROM s GROUP BY 1,2)
          SELECT ir.cell_id, yr, CAST(CAST(round({norm('irradiance', 0, 250)}*{clamp('(m/CASE WHEN d IS NULL THEN NULL ELSE greatest(d,1e0) END)', 0, 1)}*CAST(worldcover NOT IN (80,50,40) AS INT),10) AS FLOAT) AS DOUBLE)+0e0 AS solar_potential
          FROM ir JOIN sm ON sm.cell_id=ir.cell_id AND sy=yr JOIN cells c ON c.cell_id=ir.cell_id""")
    q.add("E03_wind_potential", lambda t: round_all(energy.wind(t.signals), "wind_speed", "wind_potential"), "signals",
          f"w AS (SELECT cell_id, yr, avg(sqrt(wind_u*wind_u+wind_v*wind_v)) AS s FROM signals GROUP BY 1,2) SELECT cell_id, yr, CAST(CAST(round(s,10) AS FLOAT) AS DOUBLE)+0e0 AS wind_speed, CAST(CAST(round({norm('pow(s,3)', 0, 500)},10) AS FLOAT) AS DOUBLE)+0e0 AS wind_potential FROM w")
    q.add("E04_biomass_stats", lambda t: round_all(energy.biomass_stats(vegetation.annual_max(t.signals)), "mean_biomass", "total_biomass"), "signals",
          NDVI_SQL + " SELECT yr, CAST(CAST(round(avg(ndvi*ndvi*100e0),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_biomass, CAST(CAST(round(sum(ndvi*ndvi*100e0),10) AS FLOAT) AS DOUBLE)+0e0 AS total_biomass FROM nv GROUP BY 1")
    q.add("E05_energy_access", lambda t: access(t).select("cell_id", "yr", "energy_access"), "signals", ACCESS_SQL + " SELECT * FROM ac")
    q.add("E06_energy_poverty", lambda t: round_all(energy.energy_poor(settlement.at_year(access(t), t.settlement, ["population"], EPOCHS)),
                                                    "energy_poor_population"), "signals settlement",
          ACCESS_SQL + f" SELECT yr, CAST(CAST(round(sum(population*(1e0-energy_access)),10) AS FLOAT) AS DOUBLE)+0e0 AS energy_poor_population FROM ac JOIN settlement s ON s.cell_id=ac.cell_id AND s.epoch={SNAP_SQL} GROUP BY 1")
