"""Questions to the library: lookups, joins and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of many keys at once."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def through(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left and right joined over a bridge of key pairs; Spark broadcasts a side that is small enough."""
    return left.join(bridge, left_key).join(right, right_key)


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row of the greatest order for each key, by aggregation: no sort, no window."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*")


def ranked(rows: DataFrame, keys: list[str], order: list, n: int | None = None, name: str = "position") -> DataFrame:
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if n is None else out.filter(F.col(name) <= n)


def clock(seconds: Column) -> Column:
    """mm:ss."""
    return F.format_string("%02d:%02d", (seconds / 60).cast("int"), (seconds % 60).cast("int"))
