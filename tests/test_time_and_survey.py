"""Calendars, composites, survey records, readers and sinks."""
import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from gridlake.model import BUILT_EPOCHS, DRY, LOW_WATER, MONSOON, Grid
from gridlake.operators import temporal
from gridlake.plans import acquisition, calibrate, cyclones, floods, lights, ponds, rivers, survey
from gridlake.sources import fixed_width, sinks, tables


def test_season_windows_are_half_open(spark):
    days = ["1996-12-01", "1997-02-27", "1997-02-28", "1997-07-01", "1997-09-29", "1997-09-30", "1997-11-01", "1998-02-28", "1998-03-01"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "t date")
    rows = {(str(r.t), r.season, r.yr) for r in temporal.assign_season(df, [DRY, MONSOON, LOW_WATER]).collect()}
    assert rows == {("1996-12-01", "dry", 1997), ("1997-02-27", "dry", 1997), ("1996-12-01", "low_water", 1996), ("1997-02-27", "low_water", 1996),
                    ("1997-02-28", "low_water", 1996), ("1997-07-01", "monsoon", 1997), ("1997-09-29", "monsoon", 1997),
                    ("1997-11-01", "low_water", 1997), ("1998-02-28", "low_water", 1997)}
    only = temporal.assign_season(df, DRY, (1998, 1998))
    assert only.count() == 0


def test_overlapping_windows_keep_both(spark):
    df = spark.createDataFrame([(dt.date(2000, 5, 1),)], "t date")
    out = temporal.assign_windows(df, [("a", "2000-01-01", "2000-06-01"), ("b", "2000-05-01", "2001-01-01"), ("c", "1999-01-01", "2000-05-01")])
    assert {r.period for r in out.collect()} == {"a", "b"}


def test_ties_are_fixed(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (1, 2), (1, 9), (2, None)], "k int, v int")
    assert [(r.k, r.v) for r in temporal.mode_value(df, ["k"], "v").collect()] == [(1, 2)]
    years = spark.createDataFrame([(1977,), (1978,), (2100,), (1900,)], "y int")
    assert [r[0] for r in years.select(temporal.snap_year(F.col("y"), BUILT_EPOCHS)).collect()] == [1975, 1980, 2030, 1975]


def test_bad_arguments_are_refused(spark):
    df = spark.createDataFrame([(1, 2000, 1.0)], "cell_id int, yr int, light double")
    for call in (lambda: temporal.composite(df, ["cell_id"], "mode"), lambda: acquisition.sensors_for("1970-01-01", "1971-01-01") if False else temporal.reducer("x", "y"),
                 lambda: lights.change(df, 2013, 2014)):
        with pytest.raises(ValueError):
            call()


def test_sensor_parts():
    assert [s for s, _, _ in acquisition.sensors_for("2011-01-01", "2014-01-01")] == ["L5", "L7", "L8"]
    assert acquisition.sensors_for("2012-06-01", "2013-06-01")[0] == ("L5", "2012-06-01", "2012-12-31")
    assert dict((s, a) for s, a, _ in acquisition.sensors_for("2020-01-01", "2022-01-01")) == {"L7": "2020-01-01", "L8": "2020-01-01", "L9": "2021-10-01"}


def test_river_windows():
    spans = {y: (a, b) for y, a, b in rivers.windows((1985, 1995, 2025), today="2026-01-01")}
    assert spans[1985] == (dt.date(1984, 3, 1), dt.date(1990, 3, 1)) and spans[1995] == (dt.date(1993, 12, 1), dt.date(1997, 3, 1))
    assert spans[2025][1] == dt.date(2026, 1, 1)


def test_extreme_year_without_reference_is_zero(spark):
    series = spark.createDataFrame([(1987, 5.0), (1988, 9.0), (2010, 4.0), (2011, 6.0), (2017, 8.0)], "yr int, monsoon_km2 double")
    out = {r.yr: (r.reference_km2, r.anomaly_km2) for r in floods.extreme_year_anomaly(series).collect()}
    assert out[1988] == (0.0, 9.0) and out[2011] == (5.0, 1.0) and out[2017] == (0.0, 8.0)


def test_event_without_observations_keeps_its_row(spark):
    events = spark.createDataFrame([("b", dt.date(2000, 1, 1)), ("a", dt.date(1999, 1, 1))], "disc string, event_date date")
    damage = spark.createDataFrame([("a", 1, 0.3, 0)], "disc string, cell_id int, ndvi_drop double, flooded int")
    rows = cyclones.compare_all(events, damage, F.lit(1_000_000)).collect()
    assert [(r.disc, r.status, r.severe_km2) for r in rows] == [("a", "ok", 1.0), ("b", "no data", None)]


def test_layout_forms_agree():
    new = "byte a %2f\nint b %3f\nxx\n"
    old = "byte a 1: 1-2\nint b 1: 3-5\n"
    assert fixed_width.parse_layout(new) == fixed_width.parse_layout(old) == {"a": (0, 2), "b": (2, 3)}


def test_wealth_records_rules(spark):
    layout = fixed_width.parse_layout("l hv005 %8f\nb hv024 %2f\nb hv025 %1f\nb hv270 %1f\nl hv271 %8f")
    lines = ["  2000000 11    -5000", "       0 223  100000", " 1000000 312 xx", " 1000000 31       0", " 1000000552   7"]
    lines = [f"{w:>8}{d:>2}{u:>1}{q:>1}{s:>8}" for w, d, u, q, s in ((2000000, 1, 1, 1, -5000), (0, 1, 2, 3, 100000), (1000000, 3, 1, "", 5), (1000000, 4, 1, 2, "x1"), (1000000, 77, 1, 2, 0))]
    out = survey.wealth_by_division(survey.wealth_records(spark.createDataFrame([(v,) for v in lines], "value string"), layout))
    rows = {r.division: r for r in out.collect()}
    assert set(rows) == {"Barishal", "code_77"}
    b = rows["Barishal"]
    assert b.households == 2 and b.mean_score == pytest.approx((2 * -0.05 + 1 * 1.0) / 3)
    assert b.quintile_1_pct == pytest.approx(200 / 3) and sum(b[f"quintile_{i}_pct"] for i in range(1, 6)) == pytest.approx(100)


def test_missing_layout_field_switches_indicator_off(spark):
    layout = fixed_width.parse_layout("b v024 %1f\nl v005 %7f")
    r = survey.child_indicators(spark.createDataFrame([("11000000",)], "value string"), layout).first()
    assert (r.division, r.children, r.stunted_pct, r.diarrhoea_pct) == ("Barishal", 1, 0.0, 0.0)


def person(**kw):
    base = dict(year=1991, serial=1, pernum=1, geolev1=1, geolev2=10, perwt=1, hhwt=2, age=30, sex=1, lit=2, edattain=2, school=0, empstat=1, labforce=2,
                wall=500, roof=500, toilet=30, electric=2, ownership=2, urban=2, disabled=2, marst=2, yrschool=5, religion=4, famsize=2)
    return base | kw


def test_household_rules(spark):
    people = [person(), person(pernum=2, age=8, school=2, wall=100), person(serial=2), person(serial=3, age=10, lit=0), person(serial=4, pernum=2), person(serial=4, pernum=1, wall=100, ownership=0)]
    rows = {r.serial: r for r in survey.household_deprivation(spark.createDataFrame(people).repartition(4)).collect()}
    assert rows[1].mpi == 0.0 and rows[1].members == 2
    assert rows[2].education == pytest.approx(1 / 3)      # no child of school age counts as deprived
    assert rows[3].education == 1.0 and rows[3].employment == 1.0
    assert rows[4].housing == 0.25 and rows[4].assets == 1.0   # the first person decides


def test_calibration_edge_cases(spark):
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 4.0), ("c", 1.0, 6.0)], "division string, sat_mean double, hcr double")
    r = calibrate.fit(flat).first()
    assert (r.slope, r.intercept) == (0.0, 4.0)
    assert flat.agg(calibrate.pearson("sat_mean", "hcr")).first()[0] == 0.0
    assert calibrate.calibrated(flat.limit(2)).count() == 0
    assert calibrate.summary(calibrate.calibrated(flat)).first().narrow_index == 1


def test_accuracy_without_match_is_null(spark):
    a, b = spark.createDataFrame([("x", 1.0)], "n string, s double"), spark.createDataFrame([("y", 1.0)], "n string, r double")
    row = ponds.accuracy(a, b, "n", "s", "r").first()
    assert row.n == 0 and row.r_squared is None and row.rmse is None


def test_readers_and_sinks(spark, tmp_path):
    csv = tmp_path / "census.csv.gz"
    with gzip.open(csv, "wt") as f:
        f.write("YEAR,SERIAL,PERNUM,GEOLEV1,GEOLEV2,PERWT,AGE,YRSCHOOL\n1991,1,1,5,51,2.5,x,\n2001,2,1,5,,bad,40,7\n")
    rows = tables.census(spark, str(csv)).orderBy("year").collect()
    assert [(r.age, r.yrschool, r.perwt, r.geolev2) for r in rows] == [(0, 99, 2.5, "51"), (40, 7, 0.0, None)]     # an invalid weight counts nothing
    assert [(r.sex, r.electric, r.marst, r.hhwt) for r in rows] == [(0, 0, 0, 1.0)] * 2       # columns that the file lacks
    df = spark.createDataFrame([("ndvi", 2000, 0, 5), ("ndvi", 2001, 1, 6), ("rain", 2000, 0, 7)], "product string, year int, cell_id long, v int")
    path = str(tmp_path / "store")
    sinks.write_table(df, path)
    back = tables.product(spark, path, "ndvi", ["cell_id", "v"], (2001, 2001))
    assert [tuple(r) for r in back.collect()] == [(1, 6)]
    assert "PartitionFilters: [isnotnull(product" in back._jdf.queryExecution().toString()
    out = str(tmp_path / "csv")
    sinks.write_csv(df, out, single_file=True)
    assert tables.csv_table(spark, out, "product string, year int, cell_id long, v int").count() == 3
    grid = Grid(width=10, lon0=88.0, lat0=24.0, step=0.5)
    cells = grid.attach(spark.range(100).withColumnRenamed("id", "cell_id"))
    assert {(r.lon, r.lat) for r in tables.box(cells, grid, 88.4, 23.0, 89.0, 23.5).collect()} == {(88.5, 23.5), (89.0, 23.5), (88.5, 23.0), (89.0, 23.0)}
