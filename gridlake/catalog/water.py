"""Water, floods, rivers and wetlands (W-*, F-*, R-*, H-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import (AWEI, BANDS, DISC_CELLS, MEDIANS, ZONE_CELLS, km2, nd, opening_sql, r, seasonal, vote)
from gridlake.functions import algebra as A
from gridlake.functions import indices as I
from gridlake.model import DRY_MONSOON, LOW_WATER, MONSOON
from gridlake.operators import focal, histogram
from gridlake.plans import acquisition as acq
from gridlake.plans import floods, rivers, water, wetlands
from gridlake.sources.fixtures import GRID

c = F.col
XY = "CAST(cell_id % 64 AS INT) AS x, CAST(floor(cell_id/64) AS INT) AS y"
COMP = f"comp AS (SELECT cell_id, yr, {MEDIANS} FROM obs WHERE (qa&24)=0 GROUP BY 1,2)"
WAT = f"wat AS (SELECT cell_id, yr, {XY}, {vote()} AS w FROM comp)"
LOW = (f"lw AS ({seasonal('obs', LOW_WATER)}), lc AS (SELECT cell_id, sy AS yr, {MEDIANS} FROM lw WHERE (qa&24)=0 GROUP BY 1,2), "
       f"lm AS (SELECT cell_id, yr, {vote()} AS w FROM lc)")
PERIODS = ((1995, 1996), (1997, 1998), (1999, 2001))
SPAN = (1995, 2001)


def occ_sql(periods, name="occ"):
    cols = ", ".join(f"coalesce((SELECT CAST(sum(coalesce(w,0)) AS DOUBLE) FROM lm WHERE lm.cell_id=c.cell_id AND lm.yr BETWEEN {a} AND {b}),0)"
                     f"/(SELECT count(DISTINCT sy) FROM lw WHERE sy BETWEEN {a} AND {b}) AS occ_{i}"
                     for i, (a, b) in enumerate(periods))
    return f"{name} AS (SELECT cell_id, area_m2, occurrence, {cols} FROM cells c)"


def otsu_sql(source, value, key, out):
    """CTEs giving (key, t) for one band of ``source``."""
    p = out
    return f"""
{p}_b AS (SELECT {key}, min({value}) AS lo, max({value}) AS hi FROM {source} GROUP BY 1),
{p}_h AS (SELECT {key}, CAST(least(coalesce(floor(({value}-lo)/nullif(hi-lo,0)*255),0),254) AS INT) AS bucket, count(*) AS n, avg({value}) AS mean
  FROM {source} JOIN {p}_b USING ({key}) WHERE {value} IS NOT NULL GROUP BY 1,2),""" + split_sql(key, p)


def one_pass_sql(source, value, key, out, buckets):
    """The histogram of buckets 2**e wide at its multiples, e the least that holds the range in so many."""
    p = out
    return f"""
{p}_b AS (SELECT {key}, min({value}) AS lo, max({value}) AS hi FROM {source} GROUP BY 1),
{p}_e AS (SELECT {key}, min(e) AS e FROM {p}_b, range(-40,64) q(e) WHERE floor(hi/pow(2,e))-floor(lo/pow(2,e))<{buckets} GROUP BY 1),
{p}_h AS (SELECT {key}, e, CAST(floor({value}/pow(2,e)) AS BIGINT) AS bucket, count(*) AS n, avg({value}) AS mean
  FROM {source} JOIN {p}_e USING ({key}) WHERE {value} IS NOT NULL GROUP BY 1,2,3)"""


def split_sql(key, p):
    """The best split of the histogram {p}_h."""
    return f"""
{p}_c AS (SELECT *, coalesce(sum(n) OVER w,0) AS an, coalesce(sum(n*mean) OVER w,0) AS asum, sum(n) OVER (PARTITION BY {key}) AS tn,
  sum(n*mean) OVER (PARTITION BY {key}) AS ts FROM {p}_h WINDOW w AS (PARTITION BY {key} ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}_s AS (SELECT *, coalesce(an*pow(asum/nullif(an,0)-ts/tn,2),0)+coalesce((tn-an)*pow((ts-asum)/nullif(tn-an,0)-ts/tn,2),0) AS bss FROM {p}_c),
{p} AS (SELECT {key}, mean AS t FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY bss DESC, bucket) AS rn FROM {p}_s) WHERE rn=1)"""


IDX = f"idx AS (SELECT *, {nd('green','nir')} AS ndwi, {nd('green','swir1')} AS mndwi, {AWEI} AS awei FROM comp)"
SEASON_W = (f"sz AS ({seasonal('obs', DRY_MONSOON)}), sc AS (SELECT cell_id, sy AS yr, season, {MEDIANS} FROM sz WHERE (qa&24)=0 GROUP BY 1,2,3), "
            f"sw AS (SELECT cell_id, yr, season, {XY}, {vote()} AS w FROM sc), "
            "fl AS (SELECT d.cell_id, d.yr, 'flood' AS season, d.x, d.y, m.w*(1-d.w) AS w FROM sw d JOIN sw m ON d.cell_id=m.cell_id AND d.yr=m.yr "
            "AND d.season='dry' AND m.season='monsoon')")
def extents_sql(masks):
    """Areas per year from the CTEs sw (season masks) and fl (flood)."""
    return (masks + ", m0 AS (SELECT * FROM sw WHERE w IS NOT NULL UNION ALL SELECT * FROM fl WHERE w IS NOT NULL),"
            + opening_sql("m0", "w", "yr, season") + ", ar AS (SELECT yr, "
            + ", ".join(f"CAST(sum(w*900) FILTER (season='{s}') AS DOUBLE)/1e6 AS {s}" for s in ("dry", "monsoon", "flood"))
            + " FROM op GROUP BY 1), ex AS (SELECT yr, dry AS dry_km2, CASE WHEN dry IS NOT NULL AND monsoon IS NOT NULL THEN greatest(dry,monsoon) END AS monsoon_km2, flood AS seasonal_mask_km2,"
            " CASE WHEN dry IS NOT NULL AND monsoon IS NOT NULL THEN greatest(dry,monsoon) END-dry AS seasonal_km2, CAST(monsoon<dry AS INT) AS clamped FROM ar)")


EXTENTS = extents_sql(SEASON_W)
#: The same masks with one Otsu threshold per index, year and season; ys is the key in one column.
SEASON_OTSU = (f"sz AS ({seasonal('obs', DRY_MONSOON)}), sc AS (SELECT cell_id, sy AS yr, season, season || sy AS ys, {MEDIANS} FROM sz WHERE (qa&24)=0 GROUP BY 1,2,3), "
               f"si AS (SELECT *, {nd('green','nir')} AS ndwi, {nd('green','swir1')} AS mndwi, {AWEI} AS awei FROM sc), "
               + ",".join(otsu_sql("si", v, "ys", f"o_{v}") for v in ("ndwi", "mndwi", "awei"))
               + f", sw AS (SELECT cell_id, yr, season, {XY}, CAST((CAST(ndwi>=coalesce(a.t,0) AS INT)+CAST(mndwi>=coalesce(b.t,0) AS INT)"
               "+CAST(awei>=coalesce(d.t,0) AS INT))>=2 AS INT) AS w FROM si LEFT JOIN o_ndwi a USING (ys) LEFT JOIN o_mndwi b USING (ys) LEFT JOIN o_awei d USING (ys)), "
               + SEASON_W[SEASON_W.index("fl AS"):])


def win_sql(spans, name="wm"):
    """0/1 columns w_<year> per grid cell for date windows."""
    ctes = []
    for y, a, b in spans:
        ctes.append(f"{name}_{y} AS (SELECT cell_id, {vote()} AS w FROM (SELECT cell_id, {MEDIANS} FROM obs WHERE (qa&24)=0 "
                    f"AND t>=DATE '{a}' AND t<DATE '{b}' GROUP BY 1))")
    cols = ", ".join(f"coalesce(m{y}.w,0) AS w_{y}" for y, _, _ in spans)
    joins = " ".join(f"LEFT JOIN {name}_{y} m{y} ON m{y}.cell_id=c.cell_id" for y, _, _ in spans)
    ctes.append(f"{name} AS (SELECT c.cell_id, c.x, c.y, c.area_m2, {cols} FROM cells c {joins})")
    return ",\n".join(ctes)


def region_win_sql(key, cells, years, factor, name, last_day=(3, 1), reach=1):
    """Blocks of ``factor`` cells with 0/1 columns w_<year> for the regions of the CTE ``cells``; windows widened per region."""
    def within(a, b):
        return f"t>=DATE '{a}' AND t<DATE '{b}'"
    spans = rivers.windows(years, reach=reach, last_day=last_day)
    ctes = [f"{name}_o AS (SELECT z.{key}, o.* FROM (SELECT DISTINCT {key}, cell_id FROM {cells}) z JOIN obs o ON o.cell_id=z.cell_id)",
            f"{name}_n AS (SELECT {key}, " + ", ".join(f"count(*) FILTER ({within(a, b)}) AS n_{y}" for y, a, b in spans) + f" FROM {name}_o GROUP BY 1)"]
    for y, a, b in spans:
        wide = within(*rivers.wide_window(y, reach)[1:])
        ctes.append(f"{name}_{y} AS (SELECT {key}, cell_id, {vote()} AS w FROM (SELECT {key}, cell_id, {MEDIANS} FROM {name}_o JOIN {name}_n USING ({key}) "
                    f"WHERE (qa&24)=0 AND CASE WHEN n_{y}>0 THEN {within(a, b)} ELSE {wide} END GROUP BY 1,2))")
    cols = ", ".join(f"coalesce(m{y}.w,0) AS w_{y}" for y, _, _ in spans)
    joins = " ".join(f"LEFT JOIN {name}_{y} m{y} ON m{y}.{key}=c.{key} AND m{y}.cell_id=c.cell_id" for y, _, _ in spans)
    ctes.append(f"{name}_c AS (SELECT c.{key}, c.cell_id, c.cell_id%64 AS x, floor(c.cell_id/64) AS y, {cols} FROM (SELECT DISTINCT {key}, cell_id FROM {cells}) c {joins})")
    blocks = ", ".join(f"CAST(2*sum(w_{y})>count(*) AS INT) AS w_{y}" for y, _, _ in spans)
    ctes.append(f"{name} AS (SELECT {key}, count(*)*900 AS area_m2, {blocks} FROM {name}_c GROUP BY {key}, floor(x/{factor}), floor(y/{factor}))")
    return ",\n".join(ctes)


RIVER_YEARS = (1996, 1998, 2000)
#: The test series has no scene around 2003, so this window is widened in every report.
REPORT_YEARS = (1996, 1998, 2003)


def spans():
    return rivers.windows(RIVER_YEARS, reach=1)


def pairs_sql(years, source="wm", name="mv"):
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT cell_id, area_m2, {a} AS early, {b} AS late, w_{a}*(1-w_{b}) AS abandonment, w_{b}*(1-w_{a}) AS bank_erosion, "
        f"w_{b}-w_{a} AS net_change FROM {source}" for a, b in zip(years, years[1:])) + ")"


CORRIDOR = """wp AS (SELECT r AS river, disc_id, cx AS ax, cy AS ay, lead(cx) OVER w AS bx, lead(cy) OVER w AS byy FROM discs
  WINDOW w AS (PARTITION BY r ORDER BY disc_id)),
cor AS (SELECT DISTINCT river, cell_id, x, y FROM (SELECT river, cell_id, x, y, ax, ay, bx, byy, (bx-ax)*(bx-ax)+(byy-ay)*(byy-ay) AS l2,
  (x-ax)*(bx-ax)+(y-ay)*(byy-ay) AS tt, (x-ax)*(byy-ay)-(y-ay)*(bx-ax) AS cr FROM cells JOIN wp ON bx IS NOT NULL
  AND x BETWEEN least(ax,bx)-1 AND greatest(ax,bx)+1 AND y BETWEEN least(ay,byy)-1 AND greatest(ay,byy)+1)
  WHERE CASE WHEN tt<=0 THEN (x-ax)*(x-ax)+(y-ay)*(y-ay)<=1 WHEN tt>=l2 THEN (x-bx)*(x-bx)+(y-byy)*(y-byy)<=1 ELSE cr*cr<=l2 END)"""


def corridors(t):
    return rivers.corridor(t.cells.select("cell_id", "x", "y"), t.discs.withColumn("river", c("r")), "river", "disc_id", F.lit(1))


def yearly_water(t):
    return water.classify(acq.yearly_composite(t.obs, bands=water.WATER_BANDS)).select("cell_id", "yr", "water")


def wide_masks(t):
    return GRID.attach(rivers.window_masks(t.obs, t.cells.select("cell_id"), spans()))


def occ_wide(t):
    return water.decade_occurrence(t.obs, t.cells.select("cell_id", "area_m2", "occurrence"), PERIODS)


def register(q):
    q.add("W01_otsu", lambda t: histogram.otsu(I.with_water_indices(acq.yearly_composite(t.obs, bands=water.WATER_BANDS)), "ndwi", ["yr"]).select(
        "yr", A.rounded(c("threshold")).alias("threshold")), "obs",
        COMP + "," + IDX + "," + otsu_sql("idx", "ndwi", "yr", "o1") + f" SELECT yr, {r('t')} AS threshold FROM o1")

    def indices(t):
        return I.with_water_indices(acq.yearly_composite(t.obs, bands=water.WATER_BANDS))
    q.add("W01b_otsu_one_pass", lambda t: histogram.otsu(indices(t), "mndwi", ["yr"], 1024, one_pass=True).select(
        "yr", A.rounded(c("threshold")).alias("threshold")), "obs",
        COMP + "," + IDX + "," + one_pass_sql("idx", "mndwi", "yr", "o1", 1024) + "," + split_sql("yr", "o1") + f" SELECT yr, {r('t')} AS threshold FROM o1")
    q.add("P24b_histogram_one_pass", lambda t: histogram.one_pass_histogram(indices(t), "awei", ["yr"], 256).withColumn("mean", A.rounded(c("mean"))), "obs",
          COMP + "," + IDX + "," + one_pass_sql("idx", "awei", "yr", "o2", 256) + f" SELECT yr, bucket, n, {r('mean')} AS mean, pow(2,e) AS width FROM o2_h")

    q.add("W02_otsu_default", lambda t: water.otsu_or_default(
        I.with_water_indices(acq.yearly_composite(t.obs, bands=water.WATER_BANDS)).withColumn(
            "mndwi", F.when(c("yr") != 1998, c("mndwi"))), "mndwi", ["yr"], 0.0).select("yr", A.rounded(c("threshold")).alias("threshold")),
        "obs", COMP + "," + IDX + ", i2 AS (SELECT yr, mndwi FROM idx WHERE yr<>1998)," + otsu_sql("i2", "mndwi", "yr", "o1")
        + f" SELECT yr, coalesce({r('t')},0e0) AS threshold FROM (SELECT DISTINCT yr FROM idx) LEFT JOIN o1 USING (yr)")

    q.add("W03_water_vote_area", lambda t: GRID.attach(yearly_water(t)).groupBy("yr").agg(
        F.count("water").alias("cells"), A.km2(c("water"), c("area_m2")).alias("water_km2")), "obs",
        COMP + "," + WAT + " SELECT yr, count(w) AS cells, CAST(sum(w*900) AS DOUBLE)/1e6 AS water_km2 FROM wat GROUP BY 1")

    q.add("W04_otsu_vote", lambda t: water.classify(acq.yearly_composite(t.obs, bands=water.WATER_BANDS), ["yr"], "otsu").groupBy("yr").agg(
        F.count("water").alias("cells"), F.sum("water").alias("wet")), "obs",
        COMP + "," + IDX + "," + ",".join(otsu_sql("idx", v, "yr", f"o_{v}") for v in ("ndwi", "mndwi", "awei"))
        + """ SELECT yr, count(w) AS cells, CAST(sum(w) AS BIGINT) AS wet FROM (SELECT yr, CAST((CAST(ndwi>=o_ndwi.t AS INT)
        +CAST(mndwi>=o_mndwi.t AS INT)+CAST(awei>=o_awei.t AS INT))>=2 AS INT) AS w FROM idx JOIN o_ndwi USING (yr)
        JOIN o_mndwi USING (yr) JOIN o_awei USING (yr)) GROUP BY 1""")

    def w05(t):
        yearly = acq.yearly_composite(t.obs, bands=water.WATER_BANDS)
        out = None
        for scope, region in (("national", True), ("district", True), ("rectangle", False)):
            df = water.classify_for(yearly, scope, ["yr"] if region else None, (0.1, 0.0, -0.1)).select(F.lit(scope).alias("scope"), "cell_id", "yr", "water")
            out = df if out is None else out.unionByName(df)
        return out
    fixed = f"SELECT '{{0}}' AS scope, cell_id, yr, {vote('0.1', '0', '-0.1')} AS water FROM comp"
    q.add("W05_classifier_dispatch", w05, "obs", COMP + "," + IDX + "," + ",".join(otsu_sql("idx", v, "yr", f"o_{v}") for v in ("ndwi", "mndwi", "awei"))
          + " " + fixed.format("national") + " UNION ALL " + fixed.format("rectangle") + """ UNION ALL SELECT 'district', cell_id, yr,
          CAST((CAST(ndwi>=o_ndwi.t AS INT)+CAST(mndwi>=o_mndwi.t AS INT)+CAST(awei>=o_awei.t AS INT))>=2 AS INT)
          FROM idx JOIN o_ndwi USING (yr) JOIN o_mndwi USING (yr) JOIN o_awei USING (yr)""")

    q.add("W06_despeckled_area", lambda t: water.water_area(yearly_water(t), ["yr"], GRID), "obs",
          COMP + "," + WAT + ", m0 AS (SELECT * FROM wat WHERE w IS NOT NULL)," + opening_sql("m0", "w")
          + " SELECT yr, CAST(sum(w*900) AS DOUBLE)/1e6 AS water_km2 FROM op GROUP BY 1")

    cells3 = ("cell_id", "area_m2", "occurrence")
    q.add("W07_occurrence", lambda t: water.occurrence(t.obs, t.cells.select(*cells3), SPAN).select("cell_id", "occurrence_share"),
          "cells obs", LOW + "," + occ_sql([SPAN]) + " SELECT cell_id, occ_0 AS occurrence_share FROM occ")

    q.add("W08_persistence", lambda t: water.occurrence(t.obs, t.cells.select(*cells3), SPAN).select(
        "cell_id", water.persistence(c("occurrence_share")).alias("persistence")), "cells obs",
        LOW + "," + occ_sql([SPAN]) + " SELECT cell_id, CASE WHEN occ_0>=0.75 THEN 3 WHEN occ_0>=0.25 THEN 2 WHEN occ_0>0 THEN 1 ELSE 0 END AS persistence FROM occ")

    q.add("W09_decade_occurrence", lambda t: occ_wide(t).select("cell_id", "occ_0", "occ_1", "occ_2"), "cells obs",
          LOW + "," + occ_sql(PERIODS) + " SELECT cell_id, occ_0, occ_1, occ_2 FROM occ")

    q.add("W10_occurrence_change", lambda t: occ_wide(t).select("cell_id", (c("occ_2") - c("occ_0")).alias("change")), "cells obs",
          LOW + "," + occ_sql(PERIODS) + " SELECT cell_id, occ_2-occ_0 AS change FROM occ")

    chg = "CASE WHEN {0}>0.25 THEN 2 WHEN {0}>0 THEN 1 WHEN {0}<-0.25 THEN -2 WHEN {0}<0 THEN -1 ELSE 0 END"
    q.add("W11_change_classes", lambda t: occ_wide(t).select(
        "cell_id", water.change_class(c("occ_2") - c("occ_0")).alias("change_class")), "cells obs",
        LOW + "," + occ_sql(PERIODS) + f" SELECT cell_id, {chg.format('(occ_2-occ_0)')} AS change_class FROM occ")

    q.add("W12_decade_changes", lambda t: water.period_changes(occ_wide(t), PERIODS).groupBy("early", "late", "change_class").agg(
        F.count(F.lit(1)).alias("cells"), (F.sum("area_m2") / F.lit(1e6)).alias("area_km2")), "cells obs",
        LOW + "," + occ_sql(PERIODS) + ", pr AS (" + " UNION ALL ".join(
            f"SELECT '{a[0]}-{a[1]}' AS early, '{b[0]}-{b[1]}' AS late, area_m2, occ_{i+1}-occ_{i} AS d FROM occ"
            for i, (a, b) in enumerate(zip(PERIODS, PERIODS[1:])))
        + f") SELECT early, late, {chg.format('d')} AS change_class, count(*) AS cells, CAST(sum(area_m2) AS DOUBLE)/1e6 AS area_km2 FROM pr GROUP BY 1,2,3")

    q.add("W13_conversion", lambda t: occ_wide(t).select("cell_id", *[
        e.alias(n) for n, e in water.conversion(c("occ_0"), c("occ_2")).items()]), "cells obs",
        LOW + "," + occ_sql(PERIODS) + """ SELECT cell_id, CAST(occ_0>=0.5 AND occ_2<0.1 AS INT) AS water_to_land,
        CAST(occ_0<0.1 AND occ_2>=0.5 AS INT) AS land_to_water FROM occ""")

    q.add("W14_reference_correlation", lambda t: water.reference_correlation(
        water.occurrence(t.obs, t.cells.select(*cells3), SPAN), "occurrence_share").select(A.rounded(c("pearson_r")).alias("pearson_r")),
        "cells obs", LOW + "," + occ_sql([SPAN]) + f" SELECT {r('corr(occ_0, occurrence/100)')} AS pearson_r FROM occ")

    q.add("W15_persistence_area", lambda t: water.area_by_persistence(
        water.occurrence(t.obs, t.cells.select(*cells3), SPAN), "occurrence_share"), "cells obs",
        LOW + "," + occ_sql([SPAN]) + f""" SELECT {km2('occ_0>=0.75')} AS permanent_km2, {km2('occ_0>=0.25 AND occ_0<0.75')} AS seasonal_km2,
        {km2('occ_0>0 AND occ_0<0.25')} AS rare_km2 FROM occ""")

    # floods
    q.add("F01_annual_extents", lambda t: floods.annual_extents(t.obs, GRID), "obs", EXTENTS + " SELECT * FROM ex")
    q.add("F01b_annual_extents_otsu", lambda t: floods.annual_extents(t.obs, GRID, method=water.method_for("district:X")), "obs",
          extents_sql(SEASON_OTSU) + " SELECT * FROM ex")
    q.add("F02_flood_series", lambda t: floods.time_series(t.obs, GRID, 1996, 2000, 2), "obs",
          EXTENTS + " SELECT * FROM ex WHERE yr IN (1996,1998,2000)")
    q.add("F03_extreme_anomaly", lambda t: floods.extreme_year_anomaly(floods.annual_extents(t.obs, GRID)).withColumns(
        {n: A.rounded(c(n)) for n in ("reference_km2", "anomaly_km2")}), "obs",
          EXTENTS + """, rf AS (SELECT a.yr, a.monsoon_km2, coalesce(avg(b.monsoon_km2),0) AS reference_km2 FROM ex a LEFT JOIN ex b
          ON b.yr BETWEEN a.yr-5 AND a.yr+5 AND b.yr NOT IN (1987,1988,1998,2004,2007,2017,2020,2022) GROUP BY 1,2)
          SELECT yr, monsoon_km2, CAST(CAST(round(reference_km2,10) AS FLOAT) AS DOUBLE)+0e0 AS reference_km2, CAST(CAST(round(monsoon_km2-reference_km2,10) AS FLOAT) AS DOUBLE)+0e0 AS anomaly_km2 FROM rf""")
    zshare = ("zt AS (SELECT zone, count(*)*900/1e6 AS zone_km2 FROM zc GROUP BY 1), "
              "zw AS (SELECT zone, yr, CAST(sum(w*900) AS DOUBLE)/1e6 AS water_km2 FROM mon JOIN zc USING (cell_id) GROUP BY 1,2) "
              "SELECT zone, yr, water_km2, zone_km2, water_km2/nullif(zone_km2,0)*100e0 AS water_pct FROM zw JOIN zt USING (zone)")
    mon = f"mz AS ({seasonal('obs', MONSOON)}), mc AS (SELECT cell_id, sy AS yr, {MEDIANS} FROM mz WHERE (qa&24)=0 GROUP BY 1,2), mon AS (SELECT cell_id, yr, {XY}, {vote()} AS w FROM mc)"
    q.add("F04_zone_water_share", lambda t: floods.share_by_zone(
        wetlands.seasonal_water(t.obs, MONSOON, (1998, 1998)), "water", t.zone_cells, GRID), "cells zones obs",
        ZONE_CELLS + "," + mon + "," + zshare + " WHERE yr=1998")
    q.add("F05_zone_flood_series", lambda t: floods.share_by_zone(
        wetlands.seasonal_water(t.obs, MONSOON), "water", t.zone_cells, GRID), "cells zones obs", ZONE_CELLS + "," + mon + "," + zshare)
    q.add("F06_flood_frequency", lambda t: floods.frequency(floods.seasonal_masks(t.obs)), "obs",
          SEASON_W + """ SELECT s.cell_id, count(fl.w) AS years, avg(fl.w) AS frequency FROM (SELECT DISTINCT cell_id, yr FROM sw) s
          LEFT JOIN (SELECT * FROM sw WHERE season='monsoon') fl USING (cell_id, yr) GROUP BY 1""")
    q.add("F07_flood_trend", lambda t: floods.trend(floods.seasonal_masks(t.obs), 1996, 2001), "obs",
          SEASON_W + """, e AS (SELECT s.cell_id, avg(fl.w) FILTER (s.yr BETWEEN 1996 AND 1998) AS early,
          avg(fl.w) FILTER (s.yr BETWEEN 1999 AND 2001) AS late FROM (SELECT DISTINCT cell_id, yr FROM sw) s
          LEFT JOIN (SELECT * FROM sw WHERE season='monsoon') fl USING (cell_id, yr) GROUP BY 1) SELECT cell_id, early, late, late-early AS trend FROM e""")

    # rivers
    q.add("R01_river_corridor", lambda t: corridors(t).select("river", "cell_id"), "cells discs", CORRIDOR + " SELECT river, cell_id FROM cor")
    wm = win_sql(rivers.windows(RIVER_YEARS, reach=1))
    q.add("R02_decadal_masks", lambda t: rivers.long_masks(wide_masks(t), RIVER_YEARS).select("cell_id", "period", "water"), "cells obs",
          wm + " " + " UNION ALL ".join(f"SELECT cell_id, {y} AS period, w_{y} AS water FROM wm" for y in RIVER_YEARS))
    empty_year = (1996, 2003)       # the test series has no scene around 2003: its window is widened
    q.add("R02b_widened_window", lambda t: rivers.long_masks(rivers.window_masks(t.obs, t.cells, rivers.filled_windows(
        t.obs, empty_year, reach=1)), empty_year).select("cell_id", "period", "water"), "cells obs",
        win_sql([(1996, "1995-12-01", "1997-03-01"), (2003, "2000-03-01", "9999-12-31")], "ww") + " "
        + " UNION ALL ".join(f"SELECT cell_id, {y} AS period, w_{y} AS water FROM ww" for y in empty_year))
    q.add("R03_centerline", lambda t: rivers.centerline(rivers.long_masks(wide_masks(t), RIVER_YEARS)).select(
        "cell_id", "period", "centerline"), "cells obs", wm + "," + centerline_sql())
    mv = wm + "," + pairs_sql(RIVER_YEARS)
    q.add("R04_channel_migration", lambda t: rivers.migration(wide_masks(t), RIVER_YEARS).select(
        "cell_id", "early", "late", "abandonment", "bank_erosion", "net_change"), "cells obs",
        mv + " SELECT cell_id, early, late, abandonment, bank_erosion, net_change FROM mv")
    q.add("R05_erosion_rate", lambda t: rivers.erosion_rates(rivers.migration(wide_masks(t), RIVER_YEARS)), "cells obs",
          mv + """, e AS (SELECT early, late, CAST(coalesce(sum(bank_erosion*area_m2),0) AS DOUBLE)/1e4 AS erosion_ha FROM mv GROUP BY 1,2)
          SELECT early, late, erosion_ha, erosion_ha/(late-early) AS erosion_ha_per_year FROM e""")
    q.add("R06_erosion_hotspots", lambda t: rivers.hotspots(rivers.migration(wide_masks(t), RIVER_YEARS)), "cells obs",
          mv + " SELECT cell_id, CAST(sum(bank_erosion) AS BIGINT) AS erosion_periods FROM mv GROUP BY 1")
    # corridors of 3 to 10.5 km, so that all three resolutions occur
    factor = "(CASE WHEN river*1500>=8000 THEN 10 WHEN river*1500>=5000 THEN 3 ELSE 1 END)"
    q.add("R07_river_report", lambda t: rivers.river_report(t.obs, corridors(t), "river", GRID, c("river") * 1500, REPORT_YEARS, reach=1), "cells discs obs",
          CORRIDOR + "," + region_win_sql("river", "cor", REPORT_YEARS, factor, "rw") + ", e AS (" + " UNION ALL ".join(
              f"SELECT river, {a} AS early, {b} AS late, CAST(coalesce(sum(w_{b}*(1-w_{a})*area_m2),0) AS DOUBLE)/1e4 AS erosion_ha FROM rw GROUP BY 1"
              for a, b in zip(REPORT_YEARS, REPORT_YEARS[1:])) + ") SELECT river, early, late, erosion_ha, erosion_ha/(late-early) AS erosion_ha_per_year FROM e")

    # wetlands
    q.add("H01_disc_zone", lambda t: t.disc_cells.select("disc", "cell_id"), "cells discs", DISC_CELLS + " SELECT disc, cell_id FROM dc")
    years = wetlands.sample_years(1996, 2000)
    q.add("H02_delineation", lambda t: wetlands.delineate(t.obs, t.cells, t.disc_cells.select("disc", "cell_id"), years).select("disc", "cell_id"),
          "cells discs obs", DISC_CELLS + "," + mon + f""" SELECT disc, cell_id FROM dc JOIN cells USING (cell_id) WHERE elevation<=12
          AND cell_id IN (SELECT cell_id FROM mon WHERE w=1 AND yr IN ({','.join(map(str, years))}))""")
    mop = mon + ", m0 AS (SELECT * FROM mon WHERE w IS NOT NULL)," + opening_sql("m0", "w")
    ser = DISC_CELLS + "," + mop + ", ser AS (SELECT disc, yr, CAST(sum(w*900) AS DOUBLE)/1e6 AS area_km2 FROM dc JOIN op USING (cell_id) GROUP BY 1,2)"

    def series(t):
        return wetlands.area_series(t.obs, t.disc_cells, GRID, "disc")
    q.add("H03_area_series", series, "cells discs obs", ser + " SELECT * FROM ser")
    cyc = (DISC_CELLS + f""", mc AS (SELECT cell_id, yr, mo, {MEDIANS} FROM obs WHERE (qa&24)=0 GROUP BY 1,2,3),
        m0 AS (SELECT cell_id, yr, mo, {XY}, {vote()} AS w FROM mc), m1 AS (SELECT * FROM m0 WHERE w IS NOT NULL),"""
           + opening_sql("m1", "w", "yr, mo") + """, ar AS (SELECT disc, yr, mo, CAST(sum(w*900) AS DOUBLE)/1e6 AS area_km2 FROM dc JOIN op USING (cell_id) GROUP BY 1,2,3),
        cal AS (SELECT disc, CAST(unnest(range(1995,2002)) AS INT) AS yr FROM discs), cal2 AS (SELECT disc, yr, CAST(unnest(range(1,13)) AS INT) AS mo FROM cal),
        cyc AS (SELECT disc, yr, mo, area_km2 FROM cal2 LEFT JOIN ar USING (disc, yr, mo))""")

    def cycle(t):
        return wetlands.monthly_cycle(t.obs, t.discs, t.disc_cells, GRID, "disc", SPAN)
    q.add("H04_monthly_cycle", cycle, "cells discs obs", cyc + " SELECT * FROM cyc")
    q.add("H05_average_cycle", lambda t: wetlands.average_cycle(cycle(t), "disc").withColumn("mean_km2", A.rounded(c("mean_km2"))), "cells discs obs",
          cyc + " SELECT disc, mo, CAST(CAST(round(avg(area_km2),10) AS FLOAT) AS DOUBLE)+0e0 AS mean_km2, count(area_km2) AS years FROM cyc GROUP BY 1,2")
    q.add("H06_period_comparison", lambda t: wetlands.compare_periods(t.discs, series(t), "disc", (1995, 1997), (1998, 2001)).select(
        "disc", *[A.rounded(c(n)).alias(n) for n in ("period1_km2", "period2_km2", "change_km2", "change_pct")]), "cells discs obs",
        ser + """, p AS (SELECT d.disc, avg(area_km2) FILTER (yr BETWEEN 1995 AND 1997) AS p1, avg(area_km2) FILTER (yr BETWEEN 1998 AND 2001) AS p2
        FROM discs d LEFT JOIN ser ON ser.disc=d.disc GROUP BY 1) SELECT disc, CAST(CAST(round(coalesce(p1,0),10) AS FLOAT) AS DOUBLE)+0e0 AS period1_km2, CAST(CAST(round(coalesce(p2,0),10) AS FLOAT) AS DOUBLE)+0e0 AS period2_km2,
        CAST(CAST(round(coalesce(p2,0)-coalesce(p1,0),10) AS FLOAT) AS DOUBLE)+0e0 AS change_km2, CAST(CAST(round(CASE WHEN p1 IS NULL THEN NULL WHEN abs(p1)>0.01
        THEN (coalesce(p2,0)-p1)/p1*100e0 ELSE 0 END,10) AS FLOAT) AS DOUBLE)+0e0 AS change_pct FROM p""")
    q.add("H07_plausibility", lambda t: wetlands.plausible(series(t), t.discs, "disc", c("r") * F.lit(30.0)).select("disc", "yr", "area_km2"),
          "cells discs obs", ser + """ SELECT ser.disc, yr, area_km2 FROM ser JOIN discs USING (disc)
          WHERE area_km2 >= 0.01e0*pi()*(r*30e0/1000e0)*(r*30e0/1000e0)""")


def centerline_sql():
    out = ["s0 AS (" + " UNION ALL ".join(f"SELECT cell_id, x, y, {y} AS period, w_{y} AS s FROM wm" for y in RIVER_YEARS) + ")"]
    plus = "JOIN (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) ON true"
    def erode(src, name):
        return (f"{name} AS (SELECT a.cell_id, a.x, a.y, a.period, any_value(a.s) AS s, min(b.s) AS n FROM {src} a {plus} "
                f"JOIN {src} b ON b.period=a.period AND b.x=a.x+o.dx AND b.y=a.y+o.dy GROUP BY 1,2,3,4)")
    for i in range(5):
        out.append(erode(f"s{i}", f"e{i}"))
        out.append(f"s{i+1} AS (SELECT cell_id, x, y, period, CASE WHEN sum(n) OVER (PARTITION BY period)>0 THEN n ELSE s END AS s FROM e{i})")
    out.append(erode("s5", "e5"))
    return ",".join(out) + " SELECT cell_id, period, CAST(s-n>0 AS INT) AS centerline FROM e5"

