"""Rasters on another grid: every target cell looks up where it lies in the source."""
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.projection import LonLat
from gridlake.model import Grid


@dataclass(frozen=True)
class TargetGrid:
    """width x height cells of side ``step`` in a projection; (x0, y0) is the centre of cell 0, y grows southward."""
    projection: object
    x0: float
    y0: float
    step: float
    width: int
    height: int

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell_id, lon, lat) of every cell, computed from its number."""
        n = F.col("id")
        east = F.lit(self.x0) + (n % self.width) * F.lit(self.step)
        north = F.lit(self.y0) - F.floor(n / self.width) * F.lit(self.step)
        lon, lat = self.projection.inverse(east.cast("double"), north.cast("double"))
        return spark.range(self.width * self.height).select(n.alias("cell_id"), lon.alias("lon"), lat.alias("lat"))


def reproject(raster: DataFrame, values, source: Grid, target: TargetGrid, keys=(), method: str = "nearest", source_projection=LonLat()) -> DataFrame:
    """Values of a raster (x, y, values, keys) on the cells of another grid: (keys, cell_id, values).

    Inverse mapping, so the target has no holes. nearest takes the source cell that holds the
    target's centre. bilinear weighs the four cells around it; masked or missing ones are left
    out and the other weights fill up. Target cells outside the source have no row. One equi
    join on the source cell (four rows per target cell for bilinear), whatever the sizes."""
    values = [values] if isinstance(values, str) else list(values)
    spots = target.cells(raster.sparkSession)
    east, north = source_projection.forward(F.col("lon"), F.col("lat"))
    fx, fy = (east - F.lit(source.lon0)) / F.lit(source.step), (F.lit(source.lat0) - north) / F.lit(source.step)
    kinds = {c: raster.schema[c].dataType for c in "xy"}
    if method == "nearest":
        spots = spots.select("cell_id", F.floor(fx + 0.5).cast(kinds["x"]).alias("x"), F.floor(fy + 0.5).cast(kinds["y"]).alias("y"))
        return raster.select(*keys, "x", "y", *values).join(spots, ["x", "y"]).select(*keys, "cell_id", *values)
    if method != "bilinear":
        raise ValueError(f"unknown resampling method: {method}")
    x, y = F.floor(fx), F.floor(fy)
    spots = spots.select("cell_id", x.alias("_x"), y.alias("_y"), (fx - x).alias("_u"), (fy - y).alias("_v"))
    u, v = F.col("_u"), F.col("_v")
    corners = [F.struct((F.col("_x") + dx).cast(kinds["x"]).alias("x"), (F.col("_y") + dy).cast(kinds["y"]).alias("y"), (wu * wv).alias("_w"))
               for dx, wu in ((0, 1 - u), (1, u)) for dy, wv in ((0, 1 - v), (1, v))]
    spots = spots.select("cell_id", F.inline(F.array(*corners))).filter("_w > 0")
    joined = raster.select(*keys, "x", "y", *values).join(spots, ["x", "y"])
    weight = F.col("_w")
    return joined.groupBy(*keys, "cell_id").agg(*[
        (F.sum(weight * F.col(c)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), weight)), F.lit(0.0))).alias(c) for c in values])
