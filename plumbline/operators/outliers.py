"""Outliers by the 1.5 x IQR fences; a value on a fence is not an outlier."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.rounding import percent, rnd
from plumbline.functions.types import INT, ColumnInfo, quoted
from plumbline.profile import Profile, as_profile


def iqr_outliers(table: DataFrame | Profile) -> DataFrame:
    """Fences, and outlier count and share of the non-null values, per numeric column.

    A column with fewer than two distinct values has a zero IQR, no fences and no outliers.
    """
    return as_profile(table).fences.select("column_name", *[c.alias(n) for n, c in outlier_columns().items()])


def outlier_columns() -> dict[str, Column]:
    """The reported columns, from the fences."""
    return {
        "iqr": F.when(F.col("lower").isNotNull(), rnd("iqr", 4)).otherwise(0.0),
        "lower_bound": rnd("lower", 4),
        "upper_bound": rnd("upper", 4),
        "outlier_count": F.col("outlier_count"),
        "outlier_percentage": percent("outlier_count", "non_null"),
    }


def outlier_rows(table: DataFrame | Profile, column: str) -> DataFrame:
    """Rows of the table whose ``column`` lies outside its fences."""
    p = as_profile(table)
    for info, lo, hi in p.bounds():
        if info.name == column:
            return p.df.where(_outside(info, lo, hi))
    return p.df.limit(0)


def _outside(info: ColumnInfo, lo: float, hi: float) -> Column:
    """Beyond a fence, as comparisons of the bare column with literals of its type, which reach the file scan."""
    x = F.col(quoted(info.name))
    if info.family == INT:
        return (x < math.ceil(lo)) | (x > math.floor(hi))
    beyond = (x < lo) | (x > hi)
    # NaN compares greater than any number
    return beyond & ~F.isnan(x) if isinstance(info.data_type, (T.FloatType, T.DoubleType)) else beyond


def outlier_samples(table: DataFrame | Profile, per_column: int = 10) -> DataFrame:
    """The first outliers of each numeric column in row order."""
    p = as_profile(table)
    order = p.order()
    cells = []
    for info, lo, hi in p.bounds():
        x = info.number()
        cells.append(
            F.struct(
                F.lit(info.name).alias("column_name"),
                F.when((x < lo) | (x > hi), x).alias("value"),
            )
        )
    keys = [c.alias(f"row_{n}") for c, n in zip(order, p.order_by)]
    if not cells:
        empty = p.df.limit(0).select(*keys)
        return empty.select(
            F.lit("").alias("column_name"), F.lit(0).alias("position"), *empty.columns, F.lit(0.0).alias("value")
        )
    # One array of the row's outliers: rows without any produce nothing.
    outside = p.df.select(*keys, F.filter(F.array(*cells), lambda c: c["value"].isNotNull()).alias("cells"))
    long = outside.select(*[quoted(f"row_{n}") for n in p.order_by], F.inline("cells"))
    w = Window.partitionBy("column_name").orderBy(*[F.col(quoted(f"row_{n}")) for n in p.order_by])
    # A limit on row_number is applied before the shuffle too, so a task gets a few rows per input partition.
    return (
        long.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= per_column)
        .select("column_name", "position", *[quoted(f"row_{n}") for n in p.order_by], rnd("value", 4).alias("value"))
    )


def cap_outliers(table: DataFrame | Profile, columns: list[str] | None = None) -> DataFrame:
    """The table with values beyond a fence set to that fence. Missing values stay missing."""
    p = as_profile(table)
    capped = {}
    for info, lo, hi in p.bounds():
        if columns is None or info.name in columns:
            x = info.number()
            capped[info.name] = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))
    return reduce(lambda df, kv: df.withColumn(*kv), capped.items(), p.df)
