"""Cell algebra with raster mask rules.

A mask is an INT column of 0/1/NULL. NULL means "masked" and every operation
here passes it on, which differs from SQL three-valued logic (FALSE AND NULL)
and from ``least``/``greatest`` (they skip NULL).
"""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """Comparison to 0/1; NULL operands give NULL."""
    return condition.cast("int")


def mask_and(*masks: Column) -> Column:
    return reduce(lambda a, b: a * b, masks)


def mask_or(*masks: Column) -> Column:
    return flag(reduce(lambda a, b: a + b, masks) > 0)


def mask_not(mask: Column) -> Column:
    return F.lit(1) - mask


def bits_clear(qa: Column, bits: int) -> Column:
    """True where none of the given flag bits is set."""
    return qa.bitwiseAND(F.lit(bits)) == 0


def update_mask(value: Column, mask: Column) -> Column:
    return F.when(mask != 0, value)


def self_mask(value: Column) -> Column:
    return F.when(value != 0, value)


def unmask(value: Column, fill=0) -> Column:
    return F.coalesce(value, F.lit(fill))


def where_chain(base, *rules) -> Column:
    """Overwrite ``base`` rule by rule; the last matching ``(condition, value)`` wins."""
    out = None
    for condition, value in reversed(rules):
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    base = base if isinstance(base, Column) else F.lit(base)
    return base if out is None else out.otherwise(base)


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero denominator."""
    return a / F.nullif(b, F.lit(0))


def norm_diff(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def clamp(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def unit_scale(x: Column, lo, hi) -> Column:
    """(x - lo) / (hi - lo); a reversed range flips the direction."""
    return (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def norm(x: Column, lo, hi) -> Column:
    return clamp(unit_scale(x, lo, hi), 0.0, 1.0)


def min2(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def max2(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def expression(text: str, **bands: str) -> Column:
    """Free expression over named bands, e.g. ``expression("n - r", n="nir", r="red")``.

    A name is replaced only as a whole word."""
    import re
    if not bands:
        return F.expr(text)
    pattern = r"\b(" + "|".join(sorted(bands, key=len, reverse=True)) + r")\b"
    return F.expr(re.sub(pattern, lambda m: bands[m.group(1)], text))


def correlation(x, y) -> Column:
    """Aggregate: Pearson r, NULL for a constant column (``corr`` raises there in ANSI mode)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def km2(mask: Column, area_m2: Column) -> Column:
    """Aggregate: area of a mask in square kilometres, summed in whole square metres."""
    return F.sum(mask * area_m2) / F.lit(1e6)


def km2_where(condition: Column, area_m2: Column) -> Column:
    return F.sum(F.when(condition, area_m2).otherwise(F.lit(0))) / F.lit(1e6)


def rounded(x: Column) -> Column:
    """Seven significant digits and ten decimals, once, at the end: a floating sum then does not
    depend on the order of its terms. The significant digits are cut in binary because averages
    of integers often fall exactly between two decimal neighbours; the decimals turn the noise of
    a difference of equals into 0. Adding zero turns -0.0 into 0.0."""
    return F.round(x, 10).cast("float").cast("double") + F.lit(0.0)
