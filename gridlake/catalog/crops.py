"""Vegetation and crops (V-*, O-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import MEDIANS, km2, nd, r, seasonal
from gridlake.catalog.coast import CALENDAR, round_all
from gridlake.functions import algebra as A
from gridlake.model import CROP_STRESS, CROP_TYPES, NDVI_SEASONS, RICE_PHASES, YIELD_WINDOWS
from gridlake.plans import acquisition as acq
from gridlake.plans import crops, landcover, vegetation
from gridlake.sources.fixtures import GRID

c = F.col
MODE_SQL = (f"md AS (SELECT cell_id, yr, label FROM (SELECT cell_id, yr, label, row_number() OVER (PARTITION BY cell_id, yr ORDER BY count(*) DESC, label) AS rn "
            f"FROM classes WHERE {CALENDAR} GROUP BY 1,2,3) WHERE rn=1)")


def rice_sql():
    cols = []
    for s, phases in RICE_PHASES.items():
        for p, bands in zip(phases, (("nir", "swir1"), ("nir", "red"))):
            cond = f"t>=make_date(yr,{p.start[0]},{p.start[1]}) AND t<make_date(yr,{p.end[0]},{p.end[1]})"
            cols += [f"quantile_cont({b},0.5) FILTER ({cond}) AS {s}_{p.name}_{b}" for b in bands]
    masks = ", ".join(f"CAST({nd(f'{s}_flood_nir', f'{s}_flood_swir1')}>0 AS INT)*CAST({nd(f'{s}_peak_nir', f'{s}_peak_red')}>0.4e0 AS INT) AS {s}"
                      for s in RICE_PHASES)
    return f"rw AS (SELECT cell_id, yr, {', '.join(cols)} FROM obs WHERE (qa&24)=0 GROUP BY 1,2), rice AS (SELECT cell_id, yr, {masks} FROM rw)"


TYPES_SQL = (rice_sql() + "," + MODE_SQL + """, ct AS (SELECT md.cell_id, md.yr, CASE WHEN label=4 AND aman IS NOT NULL AND boro IS NOT NULL AND aus IS NOT NULL AND aman+boro+aus=0 THEN 7
    WHEN aus=1 AND boro=1 THEN 6 WHEN aus=1 AND aman=1 THEN 5 WHEN aus=1 THEN 4 WHEN aman=1 AND boro=1 THEN 3 WHEN boro=1 THEN 2 WHEN aman=1 THEN 1 ELSE 0 END AS crop_type
    FROM md LEFT JOIN rice USING (cell_id, yr))""")


def types(t):
    return crops.crop_types(landcover.yearly_mode(t.classes), crops.rice_masks(t.obs))


def register(q):
    q.add("V01_quality_mask", lambda t: t.signals.groupBy("cell_id").agg(
        F.count(vegetation.good_quality("ndvi_dn")).alias("good"), F.sum(vegetation.good_quality("ndvi_dn")).alias("ndvi")), "signals",
        "SELECT cell_id, count(*) FILTER (summary_qa<=1) AS good, CAST(sum(ndvi_dn) FILTER (summary_qa<=1) AS BIGINT) AS ndvi FROM signals GROUP BY 1")
    q.add("V02_annual_max", lambda t: vegetation.annual_max(t.signals), "signals",
          f"""SELECT cell_id, yr, max(ndvi_dn) FILTER (summary_qa<=1)*1e-4 AS ndvi, max(evi_dn) FILTER (summary_qa<=1)*1e-4 AS evi
          FROM signals WHERE {CALENDAR} GROUP BY 1,2""")
    q.add("V03_ndvi_series", lambda t: round_all(vegetation.ndvi_series(t.signals), "mean_ndvi", "max_ndvi"), "signals",
          f"""pc AS (SELECT cell_id, yr, avg(ndvi_dn) AS a, max(ndvi_dn) AS m FROM signals WHERE {CALENDAR} AND summary_qa<=1 GROUP BY 1,2)
          SELECT yr, CAST(CAST(round(avg(a)*1e-4,10) AS FLOAT) AS DOUBLE)+0e0 AS mean_ndvi, CAST(CAST(round(avg(m)*1e-4,10) AS FLOAT) AS DOUBLE)+0e0 AS max_ndvi FROM pc GROUP BY 1""")
    names = [s.name for s in NDVI_SEASONS]
    q.add("V04_seasonal_ndvi", lambda t: round_all(vegetation.seasonal_ndvi(t.signals), *[f"{n}_ndvi" for n in names]), "signals",
          f"s AS ({seasonal('signals', NDVI_SEASONS)}), pc AS (SELECT cell_id, sy, season, avg(ndvi_dn) FILTER (summary_qa<=1) AS v FROM s GROUP BY 1,2,3) SELECT CAST(sy AS INT) AS yr, "
          + ", ".join(f"CAST(CAST(round(avg(v) FILTER (season='{n}')*1e-4,10) AS FLOAT) AS DOUBLE)+0e0 AS {n}_ndvi" for n in names) + " FROM pc GROUP BY 1")
    q.add("V05_forest_layers", lambda t: vegetation.forest_layers(t.cells), "cells",
          "SELECT cell_id, treecover, CAST(lossyear>0 AS INT) AS loss, gain, lossyear FROM cells")
    q.add("V06_forest_stats", lambda t: vegetation.forest_stats(t.cells), "cells",
          f"SELECT {km2('treecover>=30')} AS forest_km2, {km2('lossyear>0')} AS loss_km2, {km2('gain=1')} AS gain_km2 FROM cells")
    q.add("V07_forest_loss_by_year", lambda t: vegetation.forest_loss_by_year(t.cells), "cells",
          "y AS (SELECT CAST(unnest(range(1,24)) AS INT) AS k) SELECT k+2000 AS yr, coalesce((SELECT CAST(sum(area_m2) AS DOUBLE)/1e6 FROM cells WHERE lossyear=k AND treecover>=30),0) AS loss_km2 FROM y")
    q.add("V08_cropland", lambda t: vegetation.cropland_area(t.cells), "cells", f"SELECT {km2('worldcover=40')} AS cropland_km2 FROM cells")
    q.add("V09_crop_health", lambda t: round_all(vegetation.crop_health(
        acq.yearly_composite(t.obs, bands=("nir", "red")), t.signals, 1995, 2000).select("cell_id", "yr", "ndvi_anomaly"), "ndvi_anomaly"), "obs signals",
        f"""comp AS (SELECT cell_id, yr, {MEDIANS} FROM obs WHERE (qa&24)=0 GROUP BY 1,2),
        b AS (SELECT cell_id, avg(ndvi_dn)*1e-4 AS base FROM signals WHERE t>=DATE '1995-01-01' AND t<DATE '2000-12-31' GROUP BY 1)
        SELECT cell_id, yr, {r(nd('nir','red') + '-base')} AS ndvi_anomaly FROM comp JOIN b USING (cell_id)""")

    q.add("O01_rice_detection", lambda t: crops.rice_masks(t.obs).join(
        crops.flood_phase_scenes(t.obs, "aman").select("yr", c("scenes").alias("aman_scenes"), c("unreliable").alias("aman_unreliable")), "yr", "left"), "obs",
        rice_sql() + """, sc AS (SELECT yr, count(DISTINCT t) AS aman_scenes FROM obs WHERE (qa&24)=0 AND t>=make_date(yr,7,1) AND t<make_date(yr,8,31) GROUP BY 1)
        SELECT cell_id, rice.yr, aman, boro, aus, aman_scenes, CAST(aman_scenes<3 AS INT) AS aman_unreliable FROM rice LEFT JOIN sc ON sc.yr=rice.yr""")
    q.add("O02_rice_area", lambda t: crops.rice_areas(crops.rice_masks(t.obs), GRID.area()), "obs", rice_sql() + " " + " UNION ALL ".join(
        f"SELECT yr, '{s}' AS season, CAST(sum({s}*900) AS DOUBLE)/1e6 AS rice_km2 FROM rice GROUP BY 1" for s in RICE_PHASES))
    q.add("O03_crop_types", types, "obs classes", TYPES_SQL + " SELECT * FROM ct")
    q.add("O04_crop_areas", lambda t: crops.crop_areas(types(t), GRID.area()), "obs classes", TYPES_SQL + " " + " UNION ALL ".join(
        f"SELECT yr, {i} AS class, '{n}' AS class_name, {km2(f'crop_type={i}')} AS area_km2 FROM ct GROUP BY 1" for i, n in enumerate(CROP_TYPES)))
    q.add("O05_monthly_profile", lambda t: round_all(crops.monthly_profile(t.signals, t.cells, (1995, 2001)), "mean_ndvi"), "cells signals",
          """pc AS (SELECT cell_id, yr, mo, avg(ndvi_dn) AS v FROM signals JOIN cells USING (cell_id) WHERE worldcover=40 GROUP BY 1,2,3),
          cal AS (SELECT yr, CAST(unnest(range(1,13)) AS INT) AS mo FROM (SELECT CAST(unnest(range(1995,2002)) AS INT) AS yr)),
          pm AS (SELECT yr, mo, CAST(CAST(round(avg(v)*1e-4,10) AS FLOAT) AS DOUBLE)+0e0 AS mean_ndvi FROM pc GROUP BY 1,2) SELECT yr, mo, mean_ndvi FROM cal LEFT JOIN pm USING (yr, mo)""")
    q.add("O06_yield_proxy", lambda t: round_all(crops.yield_proxy(t.signals), "mean_integral", "max_integral"), "signals",
          f"""s AS ({seasonal('signals', list(YIELD_WINDOWS.values()))}), pc AS (SELECT season, sy, cell_id, CAST(sum(ndvi_dn) AS BIGINT) AS v FROM s GROUP BY 1,2,3)
          SELECT season, CAST(sy AS INT) AS yr, CAST(CAST(round(avg(v)*1e-4,10) AS FLOAT) AS DOUBLE)+0e0 AS mean_integral, CAST(CAST(round(max(v)*1e-4,10) AS FLOAT) AS DOUBLE)+0e0 AS max_integral FROM pc GROUP BY 1,2""")
    q.add("O07_crop_stress", lambda t: round_all(crops.crop_stress(t.signals, 1995, 2000), "crop_stress"), "signals",
          f"""s AS ({seasonal('signals', CROP_STRESS)}), y AS (SELECT cell_id, sy AS yr, avg(ndvi_dn) AS v FROM s GROUP BY 1,2)
          SELECT a.cell_id, CAST(a.yr AS INT) AS yr, {r('(any_value(a.v)-avg(b.v))*1e-4')} AS crop_stress FROM y a LEFT JOIN y b ON b.cell_id=a.cell_id AND b.yr<>a.yr AND b.yr BETWEEN 1995 AND 2000 GROUP BY 1,2""")
    q.add("O08_cropping_intensity", lambda t: crops.cropping_intensity(t.signals, t.cells), "cells signals",
          """m AS (SELECT cell_id, yr, mo, avg(ndvi_dn) AS v FROM signals GROUP BY 1,2,3), k AS (SELECT cell_id, yr, sum(CAST(v*1e-4>0.4e0 AS INT)) AS m FROM m GROUP BY 1,2)
          SELECT cell_id, yr, CASE WHEN worldcover<>40 THEN 0 WHEN m>=9 THEN 3 WHEN m>=6 THEN 2 WHEN m>=3 THEN 1 ELSE 0 END AS intensity FROM k JOIN cells USING (cell_id)""")
