"""Batch products: all tables of a report stacked as (part, key, measure, value)."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.catalog import climate as cc
from gridlake.catalog import coast as co
from gridlake.catalog import composite as cx
from gridlake.catalog import lights as cl
from gridlake.catalog.base import ZONE_CELLS, km2, with_views
from gridlake.catalog.primitives import patches_sql
from gridlake.functions import algebra as A
from gridlake.model import DW_CLASSES, IGBP_CLASSES
from gridlake.plans import air, landcover, lights, products, soil
from gridlake.sources.fixtures import GRID

c = F.col
MMM = ("mean", "min", "max")


def stack(tables: dict[str, DataFrame], parts) -> DataFrame:
    """parts: (name, sql, keys, measures, rounded); None keeps exact values."""
    out = []
    for name, _, keys, measures, rounds in parts:
        def value(m):
            v = c(m).cast("double")
            return A.rounded(v) if rounds else v
        rows = F.array(*[F.struct(F.lit(m).alias("measure"), value(m).alias("value")) for m in measures])
        key = F.concat_ws("|", *[c(k).cast("string") for k in keys]) if keys else F.lit("")
        out.append(tables[name].select(F.lit(name).alias("part"), key.alias("key"), F.inline(rows)))
    return reduce(DataFrame.unionByName, out)


def stack_sql(parts) -> str:
    selects = []
    for i, (name, sql, keys, measures, rounds) in enumerate(parts):
        key = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")" if keys else "''"
        def value(m):
            v = f"CAST({m} AS DOUBLE)"
            return f"CAST(CAST(round({v},10) AS FLOAT) AS DOUBLE)+0e0" if rounds else v
        selects += [f"SELECT '{name}' AS part, {key} AS key, '{m}' AS measure, {value(m)} AS value FROM p{i}" for m in measures]
    ctes = ",\n".join(f"p{i} AS ({sql})" for i, (_, sql, *_rest) in enumerate(parts))
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(selects)


def register(q):
    sql = q.sql

    def add(name, build, parts):
        q.add(name, lambda t: stack(build(t), parts))
        q.sql[name] = stack_sql(parts)

    def summary(inner, value, keys=("yr",)):
        """SQL of raster_summary over another query's SQL, before that query's final rounding."""
        inner = inner.replace("CAST(CAST(round(", "(((").replace(",10) AS FLOAT) AS DOUBLE)+0e0", ")))")
        if "AS FLOAT" in inner:
            raise ValueError("a rounding of the inner query was not undone")
        k = ", ".join(keys) + ", " if keys else ""
        return f"SELECT {k}avg({value}) AS mean, min({value}) AS min, max({value}) AS max FROM ({inner})" + (f" GROUP BY {', '.join(keys)}" if keys else "")

    def raw(views, ctes, value, source, keys=("yr",)):
        """SQL of raster_summary over an unrounded expression."""
        k = ", ".join(keys)
        return with_views(views, f"{ctes} SELECT {k}, avg({value}) AS mean, min({value}) AS min, max({value}) AS max FROM {source} GROUP BY {k}")

    last = "w_1998*(1-w_2000)"
    land = lambda body: with_views("cells zones obs", co.LAND_SQL + body)
    add("C12_accretion_product", lambda t: products.accretion(co.land_wide(t), co.LAND_YEARS, t.zone_cells, t.cells, 2700), [
        ("series", sql["C09_accretion_series"], ["zone", "early", "late"], ["accretion_km2", "km2_per_year"], None),
        ("islands", land(f", nl AS (SELECT cell_id, x, y, area_m2, {last} AS w FROM lw)," + patches_sql("nl") + """ SELECT label, CAST(sum(area_m2) AS BIGINT) AS area_m2,
            CAST(sum(x) AS DOUBLE)/count(*) AS centroid_x, CAST(sum(y) AS DOUBLE)/count(*) AS centroid_y FROM lab GROUP BY 1 HAVING sum(area_m2)>=2700"""),
         ["label"], ["area_m2", "centroid_x", "centroid_y"], None),
        ("vulnerability", land(f" SELECT {km2(last + '=1 AND occurrence>=25', 'lw.area_m2')} AS vulnerable_km2, coalesce(avg(occurrence) FILTER ({last}=1),0) AS mean_occurrence FROM lw JOIN cells USING (cell_id)"),
         [], ["vulnerable_km2", "mean_occurrence"], True),
        ("total", land(" SELECT CAST(sum(w_1996*(1-w_2000)*900) AS DOUBLE)/1e6 AS new_land_km2 FROM lw"), [], ["new_land_km2"], None)])

    add("C13_coastal_product", lambda t: products.coastal(t.cells, t.settlement, t.obs, t.signals, t.disc_cells, GRID.area(), co.DRY_YEARS, (2000, 2015, 2020, 2021), (2003, 2015)), [
        ("low_coast", sql["C01_low_coast_area"], ["threshold_m"], ["area_km2"], None),
        ("population", sql["C02_low_coast_population"], ["epoch"], ["population_in_zone"], None),
        ("shoreline", sql["C03_shoreline_change"], ["year1", "year2"], ["accretion_km2", "erosion_km2"], None),
        ("mangrove", sql["C04_mangrove_extent"], ["yr"], ["mangrove_km2"], None), ("health", sql["C05_mangrove_health"], ["yr"], ["mean_ndvi", "std_ndvi"], True),
        ("loss", sql["C06_mangrove_loss"], [], ["mangrove_loss_km2"], None), ("storms", sql["C07_cyclone_ndvi_drop"], ["disc"], ["mean_drop", "max_drop"], True)])

    zp = lambda body: with_views("cells zones obs", ZONE_CELLS + "," + co.POND_SQL + body)
    add("Y07_pond_product", lambda t: products.pond_report(co.pond_cells(t), t.cells, t.zone_cells, "division", 20), [
        ("area", zp(" SELECT division, yr, CAST(sum(pond.area_m2) AS DOUBLE)/1e6 AS pond_km2 FROM pond JOIN zc USING (cell_id) GROUP BY 1,2"), ["division", "yr"], ["pond_km2"], None),
        ("conversion", zp(""" SELECT division, yr, CAST(sum(pond.area_m2) AS DOUBLE)/1e6 AS conversion_km2 FROM pond JOIN zc USING (cell_id) JOIN cells USING (cell_id)
            WHERE (treecover>30 OR (lossyear>0 AND lossyear<=20)) AND elevation BETWEEN 0 AND 10 GROUP BY 1,2"""), ["division", "yr"], ["conversion_km2"], None)])

    add("O09_crop_product", lambda t: products.crop_report(t.obs, t.classes, t.signals, t.cells, GRID.area(), (1995, 2001), (1995, 2000)), [
        ("rice", sql["O02_rice_area"], ["yr", "season"], ["rice_km2"], None), ("types", sql["O04_crop_areas"], ["yr", "class_name"], ["area_km2"], None),
        ("profile", sql["O05_monthly_profile"], ["yr", "mo"], ["mean_ndvi"], True), ("yield", sql["O06_yield_proxy"], ["season", "yr"], ["mean_integral", "max_integral"], True),
        ("stress", summary(sql["O07_crop_stress"], "crop_stress"), ["yr"], MMM, True),
        ("intensity", f"SELECT yr, intensity, count(*) AS cells FROM ({sql['O08_cropping_intensity']}) GROUP BY 1,2", ["yr", "intensity"], ["cells"], None)])

    add("L13_land_cover_product", lambda t: products.land_report(t.classes, t.cells, GRID.area(), [(1996, 2000)]), [
        ("areas", sql["L08_area_series"], ["yr"], IGBP_CLASSES, None), ("proportions", sql["L07_proportion_series"], ["yr"], DW_CLASSES, True),
        ("static", with_views("cells", "SELECT worldcover, CAST(sum(area_m2) AS DOUBLE)/1e6 AS area_km2 FROM cells GROUP BY 1"), ["worldcover"], ["area_km2"], None),
        ("transitions_1996_2000", sql["L06b_transition_areas"], ["c1", "c2"], ["area_km2"], None)])

    pairs = ((1995, 1998), (1999, 2001))
    light = ["mean_light", "max_light", "sum_light"]
    add("N08_lights_product", lambda t: products.light_report(cl.annual(t), t.disc_cells, "disc", GRID.area(), pairs, cl.LAST_A), [
        ("series", sql["N03_light_series"], ["yr", "sensor"], light, True), ("electrified", sql["N05_electrification"], ["yr"], ["lit_km2"], None),
        ("cities", sql["N07_city_lights"], ["disc", "yr"], light, True)] + [
        (f"change_{a}_{b}", with_views("signals", cl.LIGHT_SQL + f""" SELECT avg(d) AS mean, min(d) AS min, max(d) AS max FROM (SELECT max(light) FILTER (yr={b})-max(light) FILTER (yr={a}) AS d
            FROM li WHERE yr IN ({a},{b}) GROUP BY cell_id)"""), [], MMM, True) for a, b in pairs])

    connect = dict(cell_m=1000.0, built_min=9500.0)
    add("J07_infrastructure_product", lambda t: products.infrastructure_report(
        cl.modes(t), t.settlement, cl.raster(t), cl.economic_cells(t), "zone", GRID, (1996, 2000), 10, 6, connect), [
        ("between", with_views("classes", cl.MODE_SQL + """ SELECT CAST(sum(CAST(c1<>6 AS INT)*CAST(c2=6 AS INT)*900) AS DOUBLE)/1e6 AS new_construction_km2, CAST(sum(CAST(c1=6 AS INT)*CAST(c2<>6 AS INT)*900) AS DOUBLE)/1e6 AS demolished_km2
            FROM (SELECT max(label) FILTER (yr=1996) AS c1, max(label) FILTER (yr=2000) AS c2 FROM md WHERE yr IN (1996,2000) GROUP BY cell_id)"""), [], ["new_construction_km2", "demolished_km2"], None),
        ("series", sql["J01_construction_series"], ["year1", "year2"], ["new_construction_km2", "demolished_km2"], None),
        ("zones", sql["J03_economic_zones"], ["zone", "epoch"], ["built_km2"], None), ("density", summary(sql["J04_buildup_density"], "density_km2", ("epoch",)), ["epoch"], MMM, True),
        ("connectivity", summary(sql["J05_connectivity"], "connectivity"), ["yr"], MMM, True),
        ("hotspots", f"SELECT threshold, sum(hotspot) AS hotspot_cells FROM ({sql['J06_construction_hotspots']}) GROUP BY 1", [], ["threshold", "hotspot_cells"], None)])

    add("T07_transport_product", lambda t: products.transport_report(cl.raster(t), t.settlement, t.zone_cells, c("area_m2"), 50.0), [
        ("settlement", sql["T01_settlement_masks"], ["epoch"], ["urban_km2", "peri_urban_km2", "rural_cluster_km2", "low_density_km2"], None),
        ("accessibility", summary(sql["T02_accessibility"], "accessibility"), ["yr"], MMM, True), ("underserved", sql["T03_underserved"], ["yr"], ["threshold", "cells", "population_at_risk"], True),
        ("gap", sql["T04_connectivity_gap"], ["division", "yr"], ["mean_gap", "p75_gap"], True), ("market", summary(sql["T05_market_access"], "market_access"), ["yr"], MMM, True),
        ("gradient", summary(sql["T05_market_access"], "light_gradient"), ["yr"], MMM, True)])

    ya = lambda body: with_views("cells discs signals", cc.DISC_CELLS + "," + cc.YEARLY_AIR + body)
    stats = ["mean", "max", "median"]
    seasons = [s.name for s in cc.AIR_SEASONS]

    def seasonal_sql(p):
        return with_views("signals", f"s AS ({cc.seasonal('signals', cc.AIR_SEASONS)}), pc AS (SELECT cell_id, sy, season, avg({cc.VALID[p]}) AS v FROM s GROUP BY 1,2,3) SELECT CAST(sy AS INT) AS yr, "
                          + ", ".join(f"avg(v) FILTER (season='{n}') AS {n}" for n in seasons) + " FROM pc GROUP BY 1")
    add("AQ07_air_product", lambda t: products.air_report(t.signals, cc.qa(), t.disc_cells, "disc", ("1996-05-01", "2010-01-01"), reliable=None),
        [(f"series_{p}", ya(f" SELECT yr, avg({p}) AS mean, max({p}) AS max, quantile_cont({p},0.5) AS median FROM ya GROUP BY 1"), ["yr"], stats, True) for p in air.COLUMNS]
        + [(f"seasons_{p}", seasonal_sql(p), ["yr"], seasons, True) for p in ("no2", "so2")]
        + [(f"cities_{p}", ya(f" SELECT disc, yr, avg({p}) AS mean, max({p}) AS max, quantile_cont({p},0.5) AS median FROM ya JOIN dc USING (cell_id) GROUP BY 1,2"), ["disc", "yr"], stats, True) for p in ("no2", "so2")]
        + [("hotspots", f"SELECT yr, threshold, sum(hotspot) AS hotspot_cells FROM ({sql['AQ05_pollution_hotspots']}) GROUP BY 1,2", ["yr"], ["threshold", "hotspot_cells"], True),
           ("stack", "SELECT " + ", ".join(f"avg({p}) AS {p}" for p in air.COLUMNS) + f" FROM ({sql['AQ06_pollutant_stack']})", [], list(air.COLUMNS), True)])

    add("K09_climate_product", lambda t: products.climate_report(t.signals, t.cells, t.discs, (c("r"), c("r") + 2, c("r") + 6), (1995, 2000, 1995)), [
        ("rain", sql["K03_rain_series"], ["yr"], ["mean_mm", "max_mm"], True), ("temperature", sql["K05_lst_series"], ["yr"], ["day_c", "night_c"], True),
        ("monsoon", sql["K02c_monsoon_rain"], ["yr"], ["monsoon_mm"], True), ("heat_island", sql["K06_heat_island"], ["disc", "yr"], ["urban_c", "rural_c", "uhi_c"], True),
        ("drought", summary(sql["K08_drought"], "drought"), ["yr"], ["mean", "min", "max"], True)])

    add("K12_static_product", lambda t: products.static_report(t.cells, t.settlement, t.signals, c("area_m2")), [
        ("forest", sql["V06_forest_stats"], [], ["forest_km2", "loss_km2", "gain_km2"], None), ("loss_by_year", sql["V07_forest_loss_by_year"], ["yr"], ["loss_km2"], None),
        ("water", sql["L12_occurrence_classes"], [], ["permanent_km2", "seasonal_km2", "rare_km2"], None), ("rain", sql["K10_rain_summary"], ["yr"], ["annual_mm", "max_mm", "monsoon_mm"], True),
        ("population", sql["K11_population_summary"], ["epoch"], ["population", "density_km2"], None)])

    props = [f"{p}_{n}" for p in soil.PROPERTIES for n in ("mean", "std")]
    add("S08_soil_product", lambda t: products.soil_report(soil.properties(cc.soil_long(t), "b0"), cc.land_factors(t), cc.salinity(t), t.cells), [
        ("properties", with_views("cells", "SELECT " + ", ".join(f"{f}({e}) AS {p}_{n}" for p, e in (("clay", "clay"), ("sand", "sand"), ("soc", "soc"), ("ph", "ph10/10e0"))
                                                                  for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM cells"), [], props, True),
        ("erosion", raw("cells signals", cc.FACTORS_SQL, cc.EROSION, "fa"), ["yr"], MMM, True),
        ("salinity", raw("obs", cc.DRYC_SQL, cc.PROXY, "dc0"), ["yr"], MMM, True),
        ("salinity_risk", raw("cells obs", cc.DRYC_SQL + f", pr AS (SELECT cell_id, yr, {cc.PROXY} AS p FROM dc0)", cc.SALT_RISK, "pr JOIN cells USING (cell_id)"), ["yr"], MMM, True),
        ("suitability", raw("cells signals", cc.FACTORS_SQL, cc.SUITABLE, "fa"), ["yr"], MMM, True)])

    add("X07_deprivation_product", lambda t: products.deprivation_report(cx.deprivation(t), t.zone_cells, (1996, 2000)), [
        ("divisions", sql["X04_division_stats"], ["division", "yr"], ["mean", "median"], True), ("change", summary(sql["X05_index_change"], "change", ()), [], MMM, True),
        ("series", with_views("settlement signals", cx.DEP_SQL + " SELECT yr, avg(d) AS mean, quantile_cont(d,0.5) AS median, 25e0 AS uncertainty_pct FROM dep GROUP BY 1"), ["yr"], ["mean", "median", "uncertainty_pct"], True)])
