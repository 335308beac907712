"""Survey microdata, calibration and outputs (M-*, Z-*, OUT-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import ZONE_CELLS, clamp, nd, r, seasonal, vote
from gridlake.catalog.coast import CALENDAR, round_all
from gridlake.catalog.lights import LAST_A
from gridlake.catalog.water import SEASON_W
from gridlake.model import DEPRIVED_CODES, DIVISION_CODES, NDVI_FRAME, RELIGIONS, WATER_FRAME, Grid
from gridlake.plans import calibrate, outputs, survey
from gridlake.sources import fixed_width, tables
from gridlake.sources.fixtures import EPOCHS, FWF_LAYOUT, GRID

c = F.col
LAYOUT = fixed_width.parse_layout(FWF_LAYOUT)


def sl(name):
    s, w = LAYOUT[name]
    return f"nullif(trim(substring(value,{s + 1},{w})),'')"


def iv(name, default):
    return f"coalesce(try_cast({sl(name)} AS BIGINT),{default})"


DIVISION = "CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in DIVISION_CODES.items()) + " ELSE 'code_' || CAST(code AS VARCHAR) END"
WEALTH_SQL = "wr AS (SELECT * FROM (SELECT " + ", ".join(
    f"CASE WHEN {sl(s)} IS NULL THEN 0 ELSE try_cast({sl(s)} AS BIGINT) END AS {n}" for n, s in
    (("weight_micro", "hv005"), ("division_code", "hv024"), ("urban", "hv025"), ("quintile", "hv270"), ("score_raw", "hv271"))
) + " FROM fwf) WHERE weight_micro IS NOT NULL AND division_code>0 AND urban IS NOT NULL AND quintile>0 AND score_raw IS NOT NULL)"


def wealth_select(source="wr", key=""):
    k = f"{key}, " if key else ""
    return (f"SELECT {k}division, count(*) AS households, CAST(sum(score_raw*w) AS DOUBLE)/sum(w)/1e5 AS mean_score, "
            + ", ".join(f"CAST(coalesce(sum(w) FILTER (quintile={i}),0) AS DOUBLE)/sum(w)*100e0 AS quintile_{i}_pct" for i in range(1, 6))
            + f" FROM (SELECT {k}quintile, score_raw, {DIVISION.replace('code ', 'division_code ', 1).replace('CAST(code', 'CAST(division_code')} AS division, CASE WHEN weight_micro>0 THEN weight_micro ELSE 1000000 END AS w FROM {source}) GROUP BY ALL")


def p(num, den):
    return f"coalesce(CAST({num} AS DOUBLE)/nullif({den},0)*100e0,0)"


def s(cond, w="w"):
    return f"sum(CASE WHEN {cond} THEN {w} ELSE 0 END)"


KIDS = f"""ki AS (SELECT {DIVISION} AS division, w, hw70, hw71, hw72, h11, h22, h2 FROM (SELECT {iv('hv024', 0)} AS code, {iv('hv005', 1000000)} AS w, {iv('hw70', 9999)} AS hw70, {iv('hw71', 9999)} AS hw71,
    {iv('hw72', 9999)} AS hw72, {iv('h11', 9)} AS h11, {iv('h22', 9)} AS h22, {iv('h2', 9)} AS h2 FROM fwf))
    SELECT division, count(*) AS children, {p(s('hw70 BETWEEN -600 AND -201'), 'sum(w)')} AS stunted_pct, {p(s('hw71 BETWEEN -500 AND -201'), 'sum(w)')} AS wasted_pct,
    {p(s('hw72 BETWEEN -600 AND -201'), 'sum(w)')} AS underweight_pct, {p(s('h11 IN (1,2)'), s('h11 IN (0,1,2)'))} AS diarrhoea_pct, {p(s('h22=1'), s('h22 IN (0,1)'))} AS fever_pct,
    {p(s('h2 IN (1,2,3)'), s('h2 IN (0,1,2,3)'))} AS bcg_pct FROM ki GROUP BY 1"""
WOMEN = f"""wo AS (SELECT {DIVISION} AS division, w, v313, m14, m15, v201 FROM (SELECT {iv('hv024', 0)} AS code, {iv('hv005', 1000000)} AS w, {iv('v313', 9)} AS v313, {iv('m14', 99)} AS m14,
    {iv('m15', 99)} AS m15, {iv('v201', 0)} AS v201 FROM fwf))
    SELECT division, count(*) AS women, {p(s('v313>0 AND v313<9'), 'sum(w)')} AS contraception_pct, {p(s('v313=3'), 'sum(w)')} AS modern_method_pct, {p(s('m14 BETWEEN 4 AND 97'), s('m14<98'))} AS anc_4plus_pct,
    {p(s('m15 BETWEEN 20 AND 49'), s('m15<98'))} AS facility_delivery_pct, CAST(sum(v201*w) AS DOUBLE)/sum(w) AS mean_children FROM wo GROUP BY 1"""


def codes(name):
    return "(" + ",".join(map(str, DEPRIVED_CODES[name])) + ")"


def none_of(group, name):
    return f"1-coalesce(max(CAST({group} AND {name} NOT IN {codes(name)} AS INT)),0)"


HOUSE_SQL = f"""hh AS (SELECT year, serial, any_value(geolev1) AS geolev1, any_value(geolev2) AS geolev2, any_value(urban) AS urban, any_value(hhwt) AS hhwt, count(*) AS members,
    (CAST(any_value(wall) IN {codes('wall')} AS INT)+CAST(any_value(roof) IN {codes('roof')} AS INT)+CAST(any_value(toilet) IN {codes('toilet')} AS INT)+CAST(any_value(electric) IN {codes('electric')} AS INT))/4e0 AS housing,
    ({none_of('age>=15', 'lit')}+CAST(greatest(coalesce(max(CASE WHEN age>=15 THEN edattain END),0),0) IN {codes('edattain')} AS INT)+{none_of('age BETWEEN 6 AND 14', 'school')})/3e0 AS education,
    ({none_of('age>=15', 'empstat')}+{none_of('age>=15', 'labforce')})/2e0 AS employment, CAST(CAST(any_value(ownership) IN {codes('ownership')} AS INT) AS DOUBLE) AS assets FROM persons GROUP BY 1,2),
    ho AS (SELECT *, (housing+education+employment+assets)/4e0 AS mpi FROM hh)"""
W = "perwt"
DEMO = [("male_pct", p(s("sex=1", W), f"sum({W})")), ("female_pct", p(s("sex=2", W), f"sum({W})")), ("age_0_14_pct", p(s("age<15", W), f"sum({W})")),
        ("age_15_64_pct", p(s("age BETWEEN 15 AND 64", W), f"sum({W})")), ("age_65p_pct", p(s("age>=65", W), f"sum({W})")),
        ("dependency_ratio", p(s("age<15 OR age>=65", W), s("age BETWEEN 15 AND 64", W))), ("literacy_rate", p(s("age>=15 AND lit=2", W), s("age>=15", W))),
        ("school_attendance_rate", p(s("age BETWEEN 6 AND 17 AND school=2", W), s("age BETWEEN 6 AND 17", W))),
        ("employment_rate", p(s("age BETWEEN 15 AND 64 AND empstat=1", W), s("age BETWEEN 15 AND 64", W))), ("disability_pct", p(s("disabled=1", W), f"sum({W})")),
        ("urban_pct", p(s("urban=2", W), f"sum({W})")), ("married_pct", p(s("age>=15 AND marst=2", W), s("age>=15", W))),
        ("mean_yrschool", f"coalesce(CAST({s('age>=15 AND yrschool BETWEEN 0 AND 30', 'yrschool*perwt')} AS DOUBLE)/nullif({s('age>=15 AND yrschool BETWEEN 0 AND 30', W)},0),0)"),
        ("mean_famsize", f"coalesce(CAST({s('famsize>0', 'famsize*perwt')} AS DOUBLE)/nullif({s('famsize>0', W)},0),0)"),
        ("muslim_pct", p(s("religion=4", W), f"sum({W})")), ("hindu_pct", p(s("religion=2", W), f"sum({W})"))]

# calibration inputs per zone: an index from water occurrence, a rate from temperature, incomes for some zones
CAL_SQL = ZONE_CELLS + """, ci AS (SELECT upper(zone) AS name, avg(occurrence)/100e0 AS sat_mean, quantile_cont(occurrence,0.5)/100e0 AS sat_median FROM zc JOIN cells USING (cell_id) GROUP BY 1),
    cr AS (SELECT lower(zone) AS division, CAST(sum(precip_dmm) AS DOUBLE)/count(*)/10e0 AS hcr_upl FROM zc JOIN signals USING (cell_id) WHERE yr=2000 GROUP BY 1),
    cn AS (SELECT lower(zone) AS division, CAST(sum(population) AS DOUBLE)/count(*) AS income FROM zc JOIN settlement USING (cell_id) WHERE epoch=2000 AND division<>'AFRICA' GROUP BY 1),
    cf AS (SELECT lower(zone) AS division, CAST(sum(built) AS DOUBLE)/count(*)/100e0 AS internet_pct FROM zc JOIN settlement USING (cell_id) WHERE epoch=2000 AND division<>'ASIA' GROUP BY 1),
    cal AS (SELECT cr.division, sat_mean, sat_median, hcr_upl AS hcr, coalesce(income,0e0) AS income, coalesce(internet_pct,0e0) AS internet FROM ci JOIN cr ON lower(ci.name)=cr.division
      LEFT JOIN cn ON cn.division=cr.division LEFT JOIN cf ON cf.division=cr.division)"""


def cal_inputs(t):
    zc = t.zone_cells.select("zone", "division", "cell_id")
    low = F.lower("zone").alias("division")
    static = zc.join(t.cells.select("cell_id", "occurrence"), "cell_id").groupBy(F.upper("zone").alias("name")).agg(
        (F.avg("occurrence") / F.lit(100.0)).alias("sat_mean"), (F.percentile("occurrence", F.lit(0.5)) / F.lit(100.0)).alias("sat_median"))
    rain = t.signals.groupBy("cell_id", "yr").agg(F.sum("precip_dmm").alias("s"), F.count(F.lit(1)).alias("n"))
    rates = rain.join(zc, "cell_id").groupBy(low, c("yr").alias("year")).agg((F.sum("s") / F.sum("n") / F.lit(10.0)).alias("hcr_upl"))
    town = t.settlement.filter(c("epoch") == 2000).join(zc, "cell_id")
    income = town.filter(c("division") != "AFRICA").groupBy(low).agg((F.sum("population") / F.count(F.lit(1))).alias("income"))
    facilities = town.filter(c("division") != "ASIA").groupBy(low).agg((F.sum("built") / F.count(F.lit(1)) / F.lit(100.0)).alias("internet_pct"))
    return static, rates, income, facilities, t.zones.select(F.upper("zone").alias("name"), low)


def cal_rows(t):
    index, rates, income, facilities, names = cal_inputs(t)
    return calibrate.calibration_rows(index, calibrate.head_count(rates, 2000), income, facilities, names)


FIT_SQL = CAL_SQL + ", ft AS (SELECT count(*) AS n, CASE WHEN var_pop(sat_mean)>0 THEN regr_slope(hcr,sat_mean) ELSE 0 END AS slope, CASE WHEN var_pop(sat_mean)>0 THEN regr_intercept(hcr,sat_mean) ELSE avg(hcr) END AS intercept FROM cal)"
GEO = Grid(width=64, lon0=88.0, lat0=26.7, step=0.05)


def register(q):
    q.add("M01_layout", lambda t: fixed_width.field_profile(t.fwf, LAYOUT), "fwf", " UNION ALL ".join(
        f"SELECT '{n}' AS name, {a} AS start, {w} AS width, count({sl(n)}) AS filled FROM fwf" for n, (a, w) in LAYOUT.items()))
    q.add("M02_fixed_width_ingest", lambda t: survey.wealth_records(t.fwf, LAYOUT), "fwf", WEALTH_SQL + " SELECT *, weight_micro/1e6 AS weight, score_raw/1e5 AS score FROM wr")
    q.add("M03_wealth_by_division", lambda t: survey.wealth_by_division(survey.wealth_records(t.fwf, LAYOUT)), "fwf", WEALTH_SQL + " " + wealth_select())
    q.add("M04_multi_survey", lambda t: survey.union_surveys({
        "rural": survey.wealth_by_division(survey.wealth_records(t.fwf, LAYOUT).filter(c("urban") == 2)),
        "urban": survey.wealth_by_division(survey.wealth_records(t.fwf, LAYOUT).filter(c("urban") == 1)), "missing": None}), "fwf",
        WEALTH_SQL + ", ws AS (SELECT *, CASE urban WHEN 2 THEN 'rural' ELSE 'urban' END AS survey FROM wr WHERE urban IN (1,2)) " + wealth_select("ws", "survey"))
    q.add("M05_child_indicators", lambda t: survey.child_indicators(t.fwf, LAYOUT, "hv024", "hv005"), "fwf", KIDS)
    q.add("M06_women_indicators", lambda t: survey.women_indicators(t.fwf, LAYOUT, "hv024", "hv005"), "fwf", WOMEN)
    q.add("M07_household_deprivation", lambda t: survey.household_deprivation(t.persons), "persons", HOUSE_SQL + " SELECT * FROM ho")
    means = ("mpi", "housing", "education", "employment", "assets")
    cols = [f"{m}_dep" if m != "mpi" else m for m in means]
    q.add("M08_district_deprivation", lambda t: round_all(survey.district_deprivation(survey.household_deprivation(t.persons)), *cols), "persons",
          HOUSE_SQL + " SELECT year, geolev2, max(geolev1) AS geolev1, count(*) AS households, CAST(sum(hhwt) AS BIGINT) AS total_weight, "
          + ", ".join(f"CAST(CAST(round(sum({m}*hhwt)/sum(hhwt),10) AS FLOAT) AS DOUBLE)+0e0 AS {n}" for m, n in zip(means, cols)) + f", {p(s('urban=2', 'hhwt'), 'sum(hhwt)')} AS urban_pct FROM ho GROUP BY 1,2")
    q.add("M09_district_demographics", lambda t: survey.district_demographics(t.persons), "persons",
          "SELECT year, max(geolev1) AS geolev1, geolev2, CAST(sum(perwt) AS BIGINT) AS population, " + ", ".join(f"{e} AS {n}" for n, e in DEMO) + " FROM persons GROUP BY year, geolev2")
    q.add("M10_age_pyramid", lambda t: survey.age_pyramid(t.persons), "persons",
          """SELECT year, geolev2, least(b,80) AS bin_start, CASE WHEN b>=80 THEN '80+' ELSE CAST(b AS VARCHAR)||'-'||CAST(b+4 AS VARCHAR) END AS age_bin, CAST(sum(perwt) AS BIGINT) AS population
          FROM (SELECT *, CAST(floor(age/5) AS INT)*5 AS b FROM persons) GROUP BY 1,2,3,4 ORDER BY 1,2,3""")
    q.add("M11_religion", lambda t: survey.religion_distribution(t.persons), "persons",
          "g AS (SELECT year, geolev2, CASE religion " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in RELIGIONS.items())
          + f" ELSE 'unknown' END AS religion, CAST(sum(perwt) AS BIGINT) AS population FROM persons GROUP BY 1,2,3) SELECT *, {p('population', 'sum(population) OVER (PARTITION BY year, geolev2)')} AS pct FROM g WHERE population>0")
    pieces = {"a": (24, 1), "b": (20, 8), "c": (22, 12), "d": (33, 5)}
    q.add("M12_tolerant_parsing", lambda t: t.fwf.select(c("value"), *[fixed_width.to_int(F.trim(F.substring("value", a, w)), -1).alias(f"{n}_int") for n, (a, w) in pieces.items()],
                                                         *[fixed_width.to_float(F.trim(F.substring("value", a, w)), -1.0).alias(f"{n}_float") for n, (a, w) in pieces.items()]), "fwf",
          "SELECT value, " + ", ".join(f"coalesce(try_cast(trim(substring(value,{a},{w})) AS BIGINT),-1) AS {n}_int, coalesce(try_cast(trim(substring(value,{a},{w})) AS DOUBLE),-1e0) AS {n}_float"
                                       for n, (a, w) in pieces.items()) + " FROM fwf")

    q.add("Z01_calibration_inputs", lambda t: round_all(cal_inputs(t)[0].join(cal_inputs(t)[4], "name").join(
        calibrate.head_count(cal_inputs(t)[1], 2000), "division"), "sat_mean"), "cells zones signals settlement",
        CAL_SQL + " SELECT division, upper(division) AS name, CAST(CAST(round(sat_mean,10) AS FLOAT) AS DOUBLE)+0e0 AS sat_mean, sat_median, hcr AS hcr_upl FROM cal")
    q.add("Z02_calibration_join", lambda t: cal_rows(t), "cells zones signals settlement", CAL_SQL + " SELECT * FROM cal")
    q.add("Z03_pearson", lambda t: round_all(calibrate.correlations(cal_rows(t)), "r_sat_mean", "r_income", "r_internet"), "cells zones signals settlement",
          CAL_SQL + " SELECT " + ", ".join(f"CAST(CAST(round(coalesce(corr({k},hcr),0),10) AS FLOAT) AS DOUBLE)+0e0 AS r_{k}" for k in ("sat_mean", "income", "internet")) + " FROM cal")
    q.add("Z04_least_squares", lambda t: round_all(calibrate.fit(cal_rows(t)), "slope", "intercept"), "cells zones signals settlement",
          FIT_SQL + " SELECT n, CAST(CAST(round(slope,10) AS FLOAT) AS DOUBLE)+0e0 AS slope, CAST(CAST(round(intercept,10) AS FLOAT) AS DOUBLE)+0e0 AS intercept FROM ft")
    q.add("Z05_calibrated", lambda t: round_all(calibrate.calibrated(cal_rows(t)).select("division", "calibrated", "error"), "calibrated", "error"), "cells zones signals settlement",
          FIT_SQL + " SELECT division, CAST(CAST(round(slope*sat_mean+intercept,10) AS FLOAT) AS DOUBLE)+0e0 AS calibrated, CAST(CAST(round(slope*sat_mean+intercept-hcr,10) AS FLOAT) AS DOUBLE)+0e0 AS error FROM cal, ft WHERE n>=3")
    q.add("Z05b_calibration_summary", lambda t: round_all(calibrate.summary(calibrate.calibrated(cal_rows(t))), "mae", "index_spread", "rate_spread"), "cells zones signals settlement",
          FIT_SQL + """ SELECT count(*) AS n, CAST(CAST(round(avg(abs(slope*sat_mean+intercept-hcr)),10) AS FLOAT) AS DOUBLE)+0e0 AS mae, CAST(CAST(round(max(sat_mean)-min(sat_mean),10) AS FLOAT) AS DOUBLE)+0e0 AS index_spread,
          CAST(CAST(round(max(hcr)-min(hcr),10) AS FLOAT) AS DOUBLE)+0e0 AS rate_spread, CAST(max(sat_mean)-min(sat_mean)<0.02 AS INT) AS narrow_index FROM cal, ft""")

    q.add("OUT1_zone_table", lambda t: t.zones.select("zone_id", "zone", "division").join(t.zone_cells.groupBy("zone_id").agg(F.count(F.lit(1)).alias("cells")), "zone_id", "left").select(
        "zone_id", "zone", "division", F.coalesce("cells", F.lit(0)).alias("cells")).orderBy("zone_id"), "cells zones",
        ZONE_CELLS + " SELECT z.zone_id, z.zone, z.division, count(zc.cell_id) AS cells FROM zones z LEFT JOIN zc ON zc.zone_id=z.zone_id GROUP BY 1,2,3 ORDER BY 1")
    q.add("OUT2_clip_box", lambda t: tables.box(t.cells.select("cell_id", "x", "y", "occurrence"), GEO, 88.5, 25.5, 90.0, 26.5).select(
        "cell_id", "lon", "lat", "occurrence", F.lit(tables.cell_km2(0.05)).alias("cell_km2")), "cells",
        f"SELECT cell_id, 88e0+x*0.05e0 AS lon, 26.7e0-y*0.05e0 AS lat, occurrence, {tables.cell_km2(0.05)!r}::DOUBLE AS cell_km2 FROM cells WHERE 88e0+x*0.05e0>=88.5e0 AND 88e0+x*0.05e0<=90e0 AND 26.7e0-y*0.05e0>=25.5e0 AND 26.7e0-y*0.05e0<=26.5e0")
    q.add("OUT3_urban_frames", lambda t: outputs.urban_frames(t.settlement, 1990, 1996, EPOCHS), "settlement", "SELECT epoch, cell_id, built FROM settlement WHERE epoch IN (1990,1995)")
    q.add("OUT3_ndvi_frames", lambda t: outputs.ndvi_frames(t.signals), "signals", f"s AS ({seasonal('signals', NDVI_FRAME)}) SELECT CAST(sy AS INT) AS yr, cell_id, avg(ndvi_dn)*1e-4 AS ndvi FROM s GROUP BY 1,2")
    q.add("OUT3_water_frames", lambda t: outputs.water_frames(t.signals), "signals", f"s AS ({seasonal('signals', WATER_FRAME)}) SELECT CAST(sy AS INT) AS yr, cell_id, max(water_month) AS water FROM s GROUP BY 1,2")
    q.add("OUT3_light_frames", lambda t: outputs.light_frames(t.signals, LAST_A), "signals",
          f"l AS (SELECT yr, cell_id, avg(light_dn) AS v FROM signals WHERE {CALENDAR} GROUP BY 1,2) SELECT yr, cell_id, CASE WHEN yr<={LAST_A} THEN v/63e0 ELSE {clamp('(v/100e0)', 0, 1)} END AS lights FROM l")
    over = SEASON_W + ", ov AS (SELECT d.cell_id, d.yr, d.w+2*m.w AS code FROM sw d JOIN sw m ON d.cell_id=m.cell_id AND d.yr=m.yr AND d.season='dry' AND m.season='monsoon')"
    q.add("OUT4_seasonal_overlay", lambda t: outputs.overlay_areas(outputs.seasonal_overlay(t.obs), GRID), "obs",
          over + " SELECT yr, code, CAST(count(*)*900 AS DOUBLE)/1e6 AS area_km2 FROM ov WHERE code IS NOT NULL GROUP BY 1,2")
