"""Fixed-width survey records."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_layout(text: str) -> dict[str, tuple[int, int]]:
    """Layout dictionary text to {name: (start, width)}, start counted from 0.

    Lines read ``type name %8f`` (fields follow each other) or ``type name 1: 13-20``
    (positions counted from 1); lines with fewer than three words are ignored."""
    fields, position = {}, 0
    for line in text.splitlines():
        words = line.split()
        if len(words) < 3:
            continue
        if words[2].startswith("%"):
            width = int("".join(ch for ch in words[2] if ch.isdigit()))
            fields[words[1]] = (position, width)
            position += width
        elif len(words) >= 4 and ":" in words[2] and words[3].count("-") == 1:
            first, last = (int(v) for v in words[3].split("-"))
            fields[words[1]] = (first - 1, last - first + 1)
    return fields


def read_layout(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Layout file of a few hundred lines, read on the driver."""
    return parse_layout("\n".join(row.value for row in spark.read.text(path).toLocalIterator()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Survey lines as a ``value`` column; files are split by Spark."""
    return spark.read.text(path, lineSep="\n")


def field(layout: dict, name: str, value: str = "value") -> Column:
    """Trimmed slice, NULL when empty or when the layout lacks the field."""
    if name not in layout:
        return F.lit(None).cast("string")
    start, width = layout[name]
    return F.nullif(F.trim(F.substring(value, start + 1, width)), F.lit(""))


def int_field(layout: dict, name: str, default: int | None = None, value: str = "value") -> Column:
    """Whole number; empty or invalid text gives the default."""
    return to_int(field(layout, name, value), default)


def to_int(text: Column, default: int | None = 0) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(default).cast("bigint"))


def to_float(text: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default).cast("double"))


def field_profile(lines: DataFrame, layout: dict) -> DataFrame:
    """One row per field: position, width, number of filled records. One pass over the lines."""
    wide = lines.agg(*[F.count(field(layout, n)).alias(n) for n in layout])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(s).alias("start"), F.lit(w).alias("width"), F.col(n).alias("filled"))
        for n, (s, w) in layout.items()])))
