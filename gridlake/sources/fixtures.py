"""Grid, observation and survey views derived from the star-schema test tables.

The text of each view is valid in Spark SQL and in DuckDB; ``{table}`` marks a
source table. Test inputs only, not part of the analysis API.
"""
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.model import Grid

GRID = Grid(width=64, cell_area_m2=900)

_CENTS = "(SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM {lineitem}) q"

VIEWS = {
    "cells": """SELECT p_partkey AS cell_id, CAST(p_partkey % 64 AS INT) AS x, CAST(floor(p_partkey / 64) AS INT) AS y,
  CAST((p_size * 7 + p_partkey) % 41 - 3 AS INT) AS elevation,
  CAST(round(p_retailprice * 100) AS BIGINT) % 101 AS treecover,
  CAST((p_partkey * 5 + p_size) % 24 AS INT) AS lossyear,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS gain,
  CAST((p_partkey * 3 + p_size) % 102 AS INT) AS occurrence,
  CAST(CASE (p_partkey + p_size) % 8 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 50
    WHEN 5 THEN 80 WHEN 6 THEN 90 ELSE 95 END AS INT) AS worldcover,
  CAST((p_partkey * 17 + p_size) % 90 AS INT) AS clay, CAST((p_partkey * 19 + p_size) % 90 AS INT) AS sand,
  CAST((p_partkey * 23 + p_size) % 40 AS INT) AS soc, CAST(35 + (p_partkey * 29 + p_size) % 61 AS INT) AS ph10,
  CAST(900 AS BIGINT) AS area_m2
FROM {part}""",
    "settlement": """SELECT p_partkey AS cell_id, CAST(p_partkey % 64 AS INT) AS x,
  CAST(floor(p_partkey / 64) AS INT) AS y, e AS epoch,
  CAST((p_partkey * 11 + p_size * 3 + (e - 1990) * 97) % 10001 AS INT) AS built,
  CAST((p_partkey * 13 + p_size * 17 + (e - 1990) * 89) % 25001 AS INT) AS population,
  CAST(CASE (p_partkey + p_size + e) % 8 WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 12 WHEN 3 THEN 13 WHEN 4 THEN 21
    WHEN 5 THEN 22 WHEN 6 THEN 23 ELSE 30 END AS INT) AS smod
FROM {epochs}""",
    "obs": """SELECT l_partkey AS cell_id, CAST(l_shipdate AS DATE) AS t, CAST(year(l_shipdate) AS INT) AS yr,
  CAST(month(l_shipdate) AS INT) AS mo,
  (c * 31) % 4001 AS blue, (c * 37 + l_orderkey) % 4001 AS green, (c * 41 + l_suppkey * 7) % 4001 AS red,
  (c * 43 + l_orderkey * 3) % 4001 AS nir, (c * 47 + l_suppkey) % 4001 AS swir1, (c * 53) % 4001 AS swir2,
  l_orderkey % 4096 AS qa, l_orderkey % 100 AS scene_cloud_pct, CAST(l_suppkey % 4 AS INT) AS sensor_no
FROM """ + _CENTS,
    "classes": """SELECT l_partkey AS cell_id, CAST(l_shipdate AS DATE) AS t, CAST(year(l_shipdate) AS INT) AS yr,
  CAST(month(l_shipdate) AS INT) AS mo, CAST((l_partkey + l_suppkey + l_linenumber) % 9 AS INT) AS label
FROM {lineitem}""",
    "signals": """SELECT l_partkey AS cell_id, CAST(l_shipdate AS DATE) AS t, CAST(year(l_shipdate) AS INT) AS yr,
  CAST(month(l_shipdate) AS INT) AS mo,
  CAST(c % 400 AS INT) AS precip_dmm, CAST(14000 + c % 2000 AS INT) AS lst_day_dn,
  CAST(13500 + c % 1500 AS INT) AS lst_night_dn,
  CAST(l_orderkey % 4 AS INT) AS qc_day, CAST(l_suppkey % 4 AS INT) AS qc_night,
  CAST((c * 3) % 10001 AS INT) AS ndvi_dn, CAST((c * 5) % 10001 AS INT) AS evi_dn,
  CAST((l_suppkey + l_orderkey) % 4 AS INT) AS summary_qa,
  CAST((c * 7) % 1001 AS INT) AS no2_dn, CAST((c * 11) % 1001 AS INT) AS so2_dn, CAST((c * 13) % 1001 AS INT) AS co_dn, CAST((c * 19) % 1001 AS INT) AS hcho_dn,
  CAST(c % 201 - 60 AS INT) AS aai_dn, CAST(l_orderkey % 101 AS INT) AS qa_pct, CAST((c * 17) % 64 AS INT) AS light_dn,
  CAST(c % 3 AS INT) AS water_month, CAST(c % 61 - 30 AS INT) AS tws_cm, CAST(c % 41 AS INT) AS sm1,
  CAST(c % 43 AS INT) AS sm2, CAST(c % 47 AS INT) AS sm3, CAST(c % 53 AS INT) AS sm4,
  CAST(c % 13 - 6 AS INT) AS wind_u, CAST(c % 17 - 8 AS INT) AS wind_v, CAST(300 + c % 300 AS INT) AS solar_mj
FROM """ + _CENTS,
    "zones": """SELECT n_nationkey AS zone_id, n_name AS zone, r_name AS division,
  CAST((n_nationkey % 5) * 13 AS INT) AS x0, CAST((n_nationkey % 5) * 13 + 12 AS INT) AS x1,
  CAST(floor(n_nationkey / 5) * 7 AS INT) AS y0, CAST(floor(n_nationkey / 5) * 7 + 6 AS INT) AS y1
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "discs": """SELECT s_suppkey AS disc_id, s_name AS disc, CAST((s_suppkey * 37) % 64 AS INT) AS cx,
  CAST((s_suppkey * 17) % 32 AS INT) AS cy, CAST(2 + s_suppkey % 6 AS INT) AS r,
  make_date(CAST(1996 + s_suppkey % 5 AS INT), 5, CAST(1 + s_suppkey % 28 AS INT)) AS event_date
FROM {supplier}""",
    "persons": """SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS serial, l_linenumber AS pernum,
  CAST(c_nationkey % 5 AS INT) AS geolev1, c_nationkey AS geolev2,
  CAST(round(l_quantity) AS BIGINT) AS perwt, CAST(1 + o_custkey % 9 AS BIGINT) AS hhwt,
  CAST((l_partkey * 7 + l_suppkey) % 95 AS INT) AS age, CAST(1 + l_suppkey % 2 AS INT) AS sex,
  CAST(l_partkey % 3 AS INT) AS lit, CAST(l_partkey % 4 AS INT) AS edattain, CAST(l_suppkey % 3 AS INT) AS school,
  CAST((l_partkey + l_suppkey) % 4 AS INT) AS empstat, CAST(l_suppkey % 3 AS INT) AS labforce,
  CAST(CASE WHEN l_partkey % 40 = 0 THEN 1 ELSE 2 END AS INT) AS disabled, CAST((l_partkey + 1) % 5 AS INT) AS marst,
  CAST(l_partkey % 36 AS INT) AS yrschool, CAST(l_partkey % 10 AS INT) AS religion,
  CAST(o_orderkey % 5 * 100 AS INT) AS wall, CAST(o_orderkey % 4 * 100 AS INT) AS roof,
  CAST(o_custkey % 3 * 10 AS INT) AS toilet,
  CAST(o_orderkey % 3 AS INT) AS electric, CAST(o_custkey % 3 AS INT) AS ownership,
  CAST(1 + o_orderkey % 2 AS INT) AS urban, CAST(o_orderkey % 8 AS INT) AS famsize
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    "fwf": """SELECT concat(lpad(CAST(o_orderkey AS STRING), 12, ' '),
  lpad(CAST((o_custkey * 7919) % 3000000 AS STRING), 8, ' '), lpad(CAST(1 + o_custkey % 9 AS STRING), 2, ' '),
  CAST(1 + o_orderkey % 2 AS STRING), CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE CAST(1 + o_custkey % 5 AS STRING) END,
  lpad(CAST(o_custkey % 400001 - 200000 AS STRING), 8, ' '),
  lpad(CAST(o_orderkey % 1400 - 700 AS STRING), 5, ' '), lpad(CAST(o_custkey % 1200 - 600 AS STRING), 5, ' '),
  lpad(CAST((o_orderkey * 3) % 1400 - 700 AS STRING), 5, ' '),
  CAST(o_orderkey % 10 AS STRING), CAST(o_custkey % 3 AS STRING), CAST(o_orderkey % 6 AS STRING),
  CAST(o_custkey % 5 AS STRING), CAST(o_orderkey % 4 AS STRING), lpad(CAST(o_custkey % 12 AS STRING), 2, ' '),
  lpad(CAST(10 + o_orderkey % 45 AS STRING), 2, ' '), lpad(CAST(o_custkey % 9 AS STRING), 2, ' ')) AS value
FROM {orders}""",
}

EPOCHS = (1990, 1995, 2000)
_SQL_EPOCHS = ("(SELECT * FROM part CROSS JOIN (SELECT 1990 AS e UNION ALL SELECT 1995 AS e "
               "UNION ALL SELECT 2000 AS e) q0) q")

# layout of the fixed-width view, one dictionary line per field
FWF_LAYOUT = """
str   id     1: 1-12
long  hv005  1: 13-20
byte  hv024  1: 21-22
byte  hv025  1: 23-23
byte  hv270  1: 24-24
long  hv271  1: 25-32
int   hw70   1: 33-37
int   hw71   1: 38-42
int   hw72   1: 43-47
byte  h11    1: 48-48
byte  h22    1: 49-49
byte  h2     1: 50-50
byte  h9     1: 51-51
byte  v313   1: 52-52
byte  m14    1: 53-54
byte  m15    1: 55-56
byte  v201   1: 57-58
"""


def view_sql(name: str) -> str:
    """The view as SQL over the plain table names."""
    tables = dict.fromkeys(("part", "lineitem", "orders", "customer", "nation", "region", "supplier"))
    return VIEWS[name].format(epochs=_SQL_EPOCHS, **{t: t for t in tables})


class Tables:
    """The views as lazily built DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _view(self, name: str, *sources: str) -> DataFrame:
        return self.spark.sql(VIEWS[name], **{s: self.source(s) for s in sources})

    @cached_property
    def cells(self) -> DataFrame:
        return self._view("cells", "part")

    @cached_property
    def settlement(self) -> DataFrame:
        epochs = self.source("part").withColumn("e", F.explode(F.array(*[F.lit(e) for e in EPOCHS])))
        return self.spark.sql(VIEWS["settlement"], epochs=epochs).withColumn("area_m2", GRID.area())

    @cached_property
    def obs(self) -> DataFrame:
        return self._view("obs", "lineitem")

    @cached_property
    def classes(self) -> DataFrame:
        return self._view("classes", "lineitem")

    @cached_property
    def signals(self) -> DataFrame:
        return self._view("signals", "lineitem")

    @cached_property
    def zones(self) -> DataFrame:
        return self._view("zones", "nation", "region")

    @cached_property
    def discs(self) -> DataFrame:
        return self._view("discs", "supplier")

    @cached_property
    def persons(self) -> DataFrame:
        return self._view("persons", "lineitem", "orders", "customer")

    @cached_property
    def fwf(self) -> DataFrame:
        # explode keeps the long text expression from being copied into every field slice,
        # as if the lines came from a file
        return self._view("fwf", "orders").select(F.explode(F.array("value")).alias("value"))

    @cached_property
    def zone_cells(self) -> DataFrame:
        from gridlake.operators.zones import in_rectangles
        return in_rectangles(self.cells.select("cell_id", "x", "y"), self.zones).select(
            "zone_id", "zone", "division", "cell_id", "x", "y")

    @cached_property
    def disc_cells(self) -> DataFrame:
        from gridlake.operators.zones import in_discs
        return in_discs(self.cells.select("cell_id", "x", "y"), self.discs).select(
            "disc_id", "disc", "cx", "cy", "r", "event_date", "cell_id", "x", "y")
