"""Readers for raster products and survey tables."""
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.model import Grid
from gridlake.sources.fixed_width import to_float, to_int

CENSUS_INTS = ("YEAR SERIAL PERNUM AGE SEX LIT EDATTAIN SCHOOL EMPSTAT LABFORCE WALL ROOF TOILET ELECTRIC OWNERSHIP URBAN "
               "DISABLED RELIGION MARST YRSCHOOL FAMSIZE").split()
CENSUS_DEFAULTS = {"YRSCHOOL": 99}


def product(spark: SparkSession, path: str, name: str, columns=None, years: tuple | None = None) -> DataFrame:
    """A raster product from Parquet partitioned by product and year: partitions and columns
    are pruned before reading."""
    df = spark.read.parquet(path).filter(F.col("product") == name)
    if years is not None:
        df = df.filter(F.col("year").between(*years))
    return df.select(*columns) if columns else df


def box(cells: DataFrame, grid: Grid, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells whose centre lies in a lon/lat box.

    A range of whole x and y, one cell wider, reaches the scan; the exact test follows."""
    x0, x1 = math.floor((west - grid.lon0) / grid.step) - 1, math.ceil((east - grid.lon0) / grid.step) + 1
    y0, y1 = math.floor((grid.lat0 - north) / grid.step) - 1, math.ceil((grid.lat0 - south) / grid.step) + 1
    cells = cells.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return (cells.filter((grid.lon() >= west) & (grid.lon() <= east) & (grid.lat() >= south) & (grid.lat() <= north))
            .withColumns({"lon": grid.lon(), "lat": grid.lat()}))


def cell_km2(step_degrees: float, latitude: float = 23.7, km_per_degree: float = 111.32) -> float:
    """Area of a cell from its size in degrees at one reference latitude."""
    return (step_degrees * km_per_degree) * (step_degrees * km_per_degree * math.cos(math.radians(latitude)))


def census(spark: SparkSession, path: str) -> DataFrame:
    """Census microdata CSV (plain or gzip) with tolerant number parsing; names in lower case.

    Every column is read as text and parsed with a default, as files mix blanks and codes; a
    column that the file lacks has its default in every row, a region it lacks is NULL.
    A gzip file is one task: convert it once with ``sinks.write_table`` before analysis."""
    raw = spark.read.option("header", True).csv(path)
    present = set(raw.columns)
    columns = [to_int(F.col(c) if c in present else F.lit(None).cast("string"), CENSUS_DEFAULTS.get(c, 0)).alias(c.lower()) for c in CENSUS_INTS]
    # a blank or invalid weight counts nothing; a file without the column weighs every row alike
    columns += [(to_float(F.col(c), 0.0) if c in present else F.lit(1.0)).alias(c.lower()) for c in ("PERWT", "HHWT")]
    columns += [(F.nullif(F.trim(F.col(c)), F.lit("")) if c in present else F.lit(None).cast("string")).alias(c.lower()) for c in ("GEOLEV1", "GEOLEV2")]
    return raw.select(*columns)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
