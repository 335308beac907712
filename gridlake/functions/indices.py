"""Spectral indices as column expressions over the canonical band names."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.algebra import flag, norm_diff, ratio

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")


def _c(name):
    return F.col(name) if isinstance(name, str) else name


def ndwi(green="green", nir="nir") -> Column:
    return norm_diff(_c(green), _c(nir))


def mndwi(green="green", swir1="swir1") -> Column:
    return norm_diff(_c(green), _c(swir1))


def awei(green="green", nir="nir", swir1="swir1", swir2="swir2") -> Column:
    return F.lit(4.0) * (_c(green) - _c(swir1)) - (F.lit(0.25) * _c(nir) + F.lit(2.75) * _c(swir2))


def ndvi(nir="nir", red="red") -> Column:
    return norm_diff(_c(nir), _c(red))


def evi(nir="nir", red="red", blue="blue", scale=1.0) -> Column:
    """``scale`` turns stored integers into reflectance (the +1 makes it matter)."""
    n, r, b = (_c(v) * F.lit(scale) for v in (nir, red, blue))
    return ratio(F.lit(2.5) * (n - r), n + F.lit(6.0) * r - F.lit(7.5) * b + F.lit(1.0))


def savi(nir="nir", red="red", soil=0.5, scale=1.0) -> Column:
    n, r = (_c(v) * F.lit(scale) for v in (nir, red))
    return ratio((n - r) * F.lit(1.0 + soil), n + r + F.lit(soil))


def lswi(nir="nir", swir1="swir1") -> Column:
    return norm_diff(_c(nir), _c(swir1))


def gcvi(nir="nir", green="green") -> Column:
    return ratio(_c(nir), _c(green)) - F.lit(1.0)


def ndbi(swir1="swir1", nir="nir") -> Column:
    return norm_diff(_c(swir1), _c(nir))


def urban_index(swir2="swir2", nir="nir") -> Column:
    return norm_diff(_c(swir2), _c(nir))


def bui() -> Column:
    return ndbi() - ndvi()


def turbidity(green="green", nir="nir", scale=1.0) -> Column:
    g, n = (_c(v) * F.lit(scale) for v in (green, nir))
    return (g - n) / (g + n + F.lit(1e-6))


def bare_soil() -> Column:
    """((swir1 + red) - (nir + blue)) / ((swir1 + red) + (nir + blue))"""
    return norm_diff(_c("swir1") + _c("red"), _c("nir") + _c("blue"))


def with_water_indices(df: DataFrame) -> DataFrame:
    return df.withColumns({"ndwi": ndwi(), "mndwi": mndwi(), "awei": awei()})


def water_vote(ndwi_min=0.0, mndwi_min=0.0, awei_min=0.0) -> Column:
    """1 where at least two of the three water indices reach their threshold.

    Thresholds may be numbers or columns. A masked index masks the result."""
    def reach(index, bound):
        return flag(index >= (bound if isinstance(bound, Column) else F.lit(float(bound))))
    votes = reach(ndwi(), ndwi_min) + reach(mndwi(), mndwi_min) + reach(awei(), awei_min)
    return flag(votes >= 2)
