"""Land cover (L-*)."""
from pyspark.sql import functions as F

from gridlake.catalog.base import km2, r
from gridlake.catalog.coast import CALENDAR, round_all
from gridlake.catalog.crops import MODE_SQL
from gridlake.functions import algebra as A
from gridlake.model import DW_CLASSES, IGBP_CLASSES
from gridlake.plans import landcover
from gridlake.sources.fixtures import GRID

c = F.col
FIRST_SQL = (f"fi AS (SELECT cell_id, yr, label FROM (SELECT cell_id, yr, label, row_number() OVER (PARTITION BY cell_id, yr ORDER BY t, label) AS rn FROM classes "
             f"WHERE {CALENDAR}) WHERE rn=1)")
PROB = ", ".join(f"avg(CAST(label={i} AS INT)) AS {n}" for i, n in enumerate(DW_CLASSES))
TRANS_SQL = (MODE_SQL + ", tr AS (SELECT cell_id, max(label) FILTER (yr=1996) AS c1, max(label) FILTER (yr=2000) AS c2 FROM md WHERE yr IN (1996,2000) GROUP BY 1)")
OCC = "(CASE WHEN occurrence<=100 THEN occurrence ELSE 0 END)"
SUMMARY_SQL = (f"""b AS (SELECT CAST(count(*)*900 AS DOUBLE)/1e6 AS total_km2, {km2('treecover>25')} AS forest_2000_km2, {km2('lossyear BETWEEN 1 AND 23')} AS forest_loss_km2,
    {km2('gain=1')} AS forest_gain_km2, {km2(OCC + '>=80')} AS permanent_water_km2, {km2(f'{OCC}>=20 AND {OCC}<80')} AS seasonal_water_km2 FROM cells),
    p AS (SELECT CAST(sum(population) AS BIGINT) AS population, avg(population) AS population_mean FROM settlement WHERE epoch=2000 AND population>0),
    u AS (SELECT CAST(sum(built) AS DOUBLE)/1e6 AS built_km2 FROM settlement WHERE epoch=2000),
    s AS (SELECT *, forest_2000_km2-forest_loss_km2+forest_gain_km2 AS forest_current_km2 FROM b, p, u),
    su AS (SELECT *, total_km2-forest_current_km2-built_km2-(permanent_water_km2+seasonal_water_km2) AS cropland_other_km2 FROM s)""")
SUMMARY_COLUMNS = ("total_km2", "forest_2000_km2", "forest_loss_km2", "forest_gain_km2", "permanent_water_km2", "seasonal_water_km2", "built_km2",
                   "population", "population_mean", "forest_current_km2", "cropland_other_km2")


def summary(t):
    latest = t.settlement.filter(c("epoch") == 2000)
    built = latest.agg((F.sum("built") / F.lit(1e6)).alias("b"))
    return landcover.static_summary(t.cells, latest, built)


def register(q):
    q.add("L01_first_of_year", lambda t: landcover.first_of_year(t.classes), "classes", FIRST_SQL + " SELECT * FROM fi")
    q.add("L02_mode_composite", lambda t: landcover.yearly_mode(t.classes), "classes", MODE_SQL + " SELECT * FROM md")
    q.add("L03_mean_probabilities", lambda t: landcover.mean_probabilities(t.classes, landcover.class_share_bands()), "classes",
          f"SELECT cell_id, yr, {PROB} FROM classes WHERE {CALENDAR} GROUP BY 1,2")
    years = (2000, 2019, 2020, 2021, 2024)

    def l04(t):
        layers = {2020: c("worldcover"), 2021: F.when(c("gain") == 1, 10).otherwise(c("worldcover"))}
        rows = F.array(*[F.struct(F.lit(y).alias("yr"), landcover.with_year_fallback(y, layers).alias("class")) for y in years])
        return t.cells.select(F.inline(rows)).groupBy("yr", "class").agg(F.count(F.lit(1)).alias("cells"))
    q.add("L04_year_fallback", l04, "cells", "SELECT yr, class, count(*) AS cells FROM (" + " UNION ALL ".join(
        f"SELECT {y} AS yr, {'worldcover' if y == 2020 else 'CASE WHEN gain=1 THEN 10 ELSE worldcover END'} AS class FROM cells" for y in years) + ") GROUP BY 1,2")
    q.add("L05_class_areas", lambda t: landcover.class_areas(landcover.yearly_mode(t.classes), "label", GRID.area(), IGBP_CLASSES, ["yr"]), "classes",
          MODE_SQL + " " + " UNION ALL ".join(f"SELECT yr, {i} AS class, '{n}' AS class_name, {km2(f'label={i}')} AS area_km2 FROM md GROUP BY 1"
                                              for i, n in enumerate(IGBP_CLASSES)))
    q.add("L06_transitions", lambda t: landcover.transitions(t.classes, 1996, 2000), "classes",
          TRANS_SQL + " SELECT cell_id, c1, c2, CAST(c1<>c2 AS INT) AS changed, CASE WHEN c1<>c2 THEN c1*100+c2 END AS transition FROM tr")
    q.add("L06b_transition_areas", lambda t: landcover.transition_areas(landcover.transitions(t.classes, 1996, 2000), GRID.area()), "classes",
          TRANS_SQL + " SELECT c1, c2, CAST(count(*)*900 AS DOUBLE)/1e6 AS area_km2 FROM tr WHERE c1<>c2 GROUP BY 1,2")
    q.add("L07_proportion_series", lambda t: round_all(landcover.proportion_series(t.classes), *DW_CLASSES), "classes",
          f"pr AS (SELECT cell_id, yr, {PROB} FROM classes WHERE {CALENDAR} GROUP BY 1,2) SELECT yr, " + ", ".join(f"CAST(CAST(round(avg({n}),10) AS FLOAT) AS DOUBLE)+0e0 AS {n}" for n in DW_CLASSES)
          + " FROM pr GROUP BY 1")
    q.add("L08_area_series", lambda t: landcover.area_series(landcover.yearly_mode(t.classes), GRID.area()), "classes",
          MODE_SQL + " SELECT yr, " + ", ".join(f"{km2(f'label={i}')} AS {n}" for i, n in enumerate(IGBP_CLASSES)) + " FROM md GROUP BY 1")
    q.add("L09_static_summary", lambda t: summary(t).select(*SUMMARY_COLUMNS), "cells settlement", SUMMARY_SQL + f" SELECT {', '.join(SUMMARY_COLUMNS)} FROM su")
    q.add("L10_summary_long", lambda t: landcover.summary_long(summary(t)), "cells settlement", SUMMARY_SQL
          + """ SELECT 'forest_current' AS category, forest_current_km2 AS area_km2, 2023 AS year FROM su UNION ALL SELECT 'built_area', built_km2, 2020 FROM su
          UNION ALL SELECT 'permanent_water', permanent_water_km2, 2020 FROM su UNION ALL SELECT 'seasonal_water', seasonal_water_km2, 2020 FROM su
          UNION ALL SELECT 'cropland_other', cropland_other_km2, 2020 FROM su""")
    q.add("L11_density_distribution", lambda t: landcover.density_distribution(t.settlement, keys=["epoch"]), "settlement",
          "SELECT epoch, " + ", ".join(f"count(*) FILTER (population>={h}) AS cells_gte_{h}" for h in (1000, 2000, 5000, 10000, 20000))
          + ", count(*) FILTER (population>=10000) AS slum_proxy_km2 FROM settlement GROUP BY 1")
    q.add("L12_occurrence_classes", lambda t: landcover.occurrence_classes(t.cells), "cells",
          f"SELECT {km2('occurrence>75')} AS permanent_km2, {km2('occurrence BETWEEN 25 AND 75')} AS seasonal_km2, {km2('occurrence>0 AND occurrence<25')} AS rare_km2 FROM cells")
