"""Alerts (AL-*). Baselines are shortened to fit the seven years of the test series."""
from pyspark.sql import functions as F

from gridlake.catalog.base import km2, r
from gridlake.catalog.coast import CALENDAR, round_all
from gridlake.plans import alerts
from gridlake.sources.fixtures import GRID

c = F.col
LOSS_YEARS = (1999, 2001, 2005, 2010, 2023, 2024)
FIT = dict(lookback=3, first=1995, minimum=2)
LOSS_SQL = "lo AS (" + " UNION ALL ".join(
    f"SELECT {y} AS yr, {km2(f'lossyear={y - 2000} AND treecover>=30') if 1 <= y - 2000 <= 23 else '0e0'} AS area_km2{'' if 1 <= y - 2000 <= 23 else ''} FROM cells"
    + ("" if 1 <= y - 2000 <= 23 else " GROUP BY 1") for y in LOSS_YEARS) + """), al1 AS (SELECT yr, 'forest_loss' AS alert, CAST(area_km2>1 AS INT) AS triggered,
    CASE WHEN area_km2>50 THEN 'critical' WHEN area_km2>10 THEN 'high' WHEN area_km2>1 THEN 'medium' ELSE 'none' END AS severity, area_km2 FROM lo)"""


def baseline(source, value, name):
    return (f"{name} AS (SELECT a.yr, any_value(a.{value}) AS v, avg(b.{value}) AS m, stddev_pop(b.{value}) AS s, count(b.{value}) AS n FROM {source} a "
            f"LEFT JOIN {source} b ON b.yr BETWEEN a.yr-3 AND a.yr-1 AND b.yr>=1995 GROUP BY 1)")


FLOOD_SQL = ("fw AS (SELECT cell_id, yr, max(CAST(water_month=2 AS INT)) AS w FROM signals WHERE mo BETWEEN 7 AND 9 GROUP BY 1,2), fa AS (SELECT yr, CAST(sum(w*900) AS DOUBLE)/1e6 AS k FROM fw GROUP BY 1),"
             + baseline("fa", "k", "fb") + """, fz AS (SELECT *, CASE WHEN n>=2 THEN CASE WHEN s>0 THEN (v-m)/s ELSE 0 END END AS z FROM fb),
    al2 AS (SELECT yr, 'flood_anomaly' AS alert, CASE WHEN n>=2 THEN CAST(v>m+1.5e0*s AS INT) ELSE 0 END AS triggered,
    CASE WHEN n<2 THEN 'insufficient_data' WHEN z>3 THEN 'critical' WHEN z>2 THEN 'high' WHEN v>m+1.5e0*s THEN 'medium' ELSE 'none' END AS severity, v AS area_km2, m AS baseline_mean, z FROM fz)""")
BUILT_SQL = f"""bw AS (SELECT cell_id, yr, max(CAST(label=6 AS INT)) AS w FROM classes WHERE {CALENDAR} GROUP BY 1,2), ba AS (SELECT yr, CAST(sum(w*900) AS DOUBLE)/1e6 AS k FROM bw GROUP BY 1),
    bg AS (SELECT a.yr, a.k, CASE WHEN a.yr<1996 OR coalesce(b.k,0)=0 THEN 0e0 ELSE (a.k-b.k)/b.k*100e0 END AS g FROM ba a LEFT JOIN ba b ON b.yr=a.yr-1),
    al3 AS (SELECT yr, 'construction_surge' AS alert, CAST(g>20 AS INT) AS triggered, CASE WHEN g>50 THEN 'critical' WHEN g>30 THEN 'high' WHEN g>20 THEN 'medium' ELSE 'none' END AS severity,
    CASE WHEN yr<1996 THEN 0e0 ELSE k END AS area_km2, g AS growth_pct FROM bg)"""
NDVI_SQL = (f"nc AS (SELECT cell_id, yr, avg(ndvi_dn)*1e-4 AS v FROM signals WHERE {CALENDAR} GROUP BY 1,2), na AS (SELECT yr, avg(v) AS k FROM nc GROUP BY 1)," + baseline("na", "k", "nb")
            + """, nl AS (SELECT yr, CAST(sum(CASE WHEN nc.v<m-2e0*s THEN 900 ELSE 0 END) AS DOUBLE)/1e6 AS k FROM nc JOIN nb USING (yr) GROUP BY 1),
    nz AS (SELECT nb.*, nl.k, CASE WHEN n>=2 THEN CASE WHEN s>0 THEN (v-m)/s ELSE 0 END END AS z FROM nb JOIN nl USING (yr)),
    al4 AS (SELECT yr, 'ndvi_anomaly' AS alert, CASE WHEN n>=2 THEN CAST(z<-2 AS INT) ELSE 0 END AS triggered, CASE WHEN n<2 THEN 'insufficient_data' WHEN z<-3.5 THEN 'critical' WHEN z<-2.5 THEN 'high'
    WHEN z<-2 THEN 'medium' ELSE 'none' END AS severity, CASE WHEN n>=2 THEN k ELSE 0 END AS area_km2, v AS ndvi, m AS baseline_mean, z FROM nz)""")
NO2_SQL = (f"oc AS (SELECT cell_id, yr, avg(no2_dn)*1e0 AS v FROM signals WHERE {CALENDAR} GROUP BY 1,2), oa AS (SELECT yr, avg(v) AS k FROM oc GROUP BY 1)," + baseline("oa", "k", "ob")
           + """, ol AS (SELECT yr, CAST(sum(CASE WHEN oc.v>m*1.15e0 THEN 900 ELSE 0 END) AS DOUBLE)/1e6 AS k FROM oc JOIN ob USING (yr) GROUP BY 1),
    oz AS (SELECT ob.*, ol.k, CASE WHEN n>=2 AND yr>=1995 THEN CASE WHEN m>0 THEN (v-m)/m*100e0 ELSE 0 END END AS p FROM ob JOIN ol USING (yr)),
    al5 AS (SELECT yr, 'air_quality_spike' AS alert, CASE WHEN n>=2 THEN CAST(p>15 AS INT) ELSE 0 END AS triggered, CASE WHEN n<2 THEN 'insufficient_data' WHEN p>40 THEN 'critical' WHEN p>25 THEN 'high'
    WHEN p>15 THEN 'medium' ELSE 'none' END AS severity, CASE WHEN n>=2 THEN k ELSE 0 END AS area_km2, v AS no2, m AS baseline_mean, p AS change_pct FROM oz)""")


def al1(t):
    return alerts.forest_loss(t.cells, LOSS_YEARS)


def al2(t):
    return alerts.flood_anomaly(t.signals, GRID.area(), **FIT)


def al3(t):
    return alerts.construction_surge(t.classes, GRID.area(), first=1996)


def al4(t):
    return alerts.ndvi_anomaly(t.signals, GRID.area(), **FIT)


def al5(t):
    return alerts.no2_spike(t.signals, GRID.area(), **FIT)


def _rounded(names, table, *measures):
    return "SELECT " + ", ".join(names) + "".join(f", {r(n)} AS {n}" for n in measures) + f" FROM {table}"


def register(q):
    base = ("yr", "alert", "triggered", "severity", "area_km2")
    q.add("AL1_forest_loss", al1, "cells", LOSS_SQL + " SELECT * FROM al1")
    q.add("AL2_flood_anomaly", lambda t: round_all(al2(t), "baseline_mean", "z"), "signals", FLOOD_SQL + " " + _rounded(base, "al2", "baseline_mean", "z"))
    q.add("AL3_construction_surge", lambda t: round_all(al3(t), "growth_pct"), "classes", BUILT_SQL + " " + _rounded(base, "al3", "growth_pct"))
    q.add("AL4_ndvi_anomaly", lambda t: round_all(al4(t), "ndvi", "baseline_mean", "z"), "signals", NDVI_SQL + " " + _rounded(base, "al4", "ndvi", "baseline_mean", "z"))
    q.add("AL5_no2_spike", lambda t: round_all(al5(t), "no2", "baseline_mean", "change_pct"), "signals",
          NO2_SQL + " " + _rounded(base, "al5", "no2", "baseline_mean", "change_pct"))
    q.add("AL6_alert_report", lambda t: alerts.report(al1(t), al2(t), al3(t), al4(t), al5(t)), "cells classes signals",
          ",".join((LOSS_SQL, FLOOD_SQL, BUILT_SQL, NDVI_SQL, NO2_SQL)) + " " + " UNION ALL ".join(
              f"SELECT {', '.join(base)}, replace(alert,'_',' ') || ' ' || CAST(yr AS VARCHAR) || ': ' || severity AS description FROM al{i}" for i in range(1, 6)))
