"""Counts, sizes, extremes and central moments of every column: two scans, each one global aggregate.

The first scan gives counts, means and extremes. The second sums powers of the distance from the mean, which is
both cheaper than a streaming moment update and free of cancellation. Only partial sums are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import BOOL, DATETIME, STRING, ColumnInfo, columns_of, epoch_micros
from plumbline.plans.blocks import cut
from plumbline.plans.small import local, pinned

BASIC = {
    "non_null": "bigint", "bytes": "bigint", "mean": "double", "min_num": "double", "max_num": "double",
    "zeros": "bigint", "negatives": "bigint", "infinite": "bigint",
    "avg_len": "double", "min_len": "bigint", "max_len": "bigint", "min_us": "bigint", "max_us": "bigint",
}


def _basic(info: ColumnInfo) -> dict[str, Column]:
    v = info.value()
    out = {"non_null": F.count(v)}
    size = info.fixed_bytes()
    if size is not None:
        out["bytes"] = F.count(v) * F.lit(size)
    elif info.family == STRING:
        out["bytes"] = F.coalesce(F.sum(F.octet_length(v).cast("bigint")), F.lit(0))
    else:
        out["bytes"] = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(v))).cast("bigint")), F.lit(0))
    if info.is_numeric:
        x = info.number()
        out |= {
            "mean": F.avg(x), "min_num": F.min(x), "max_num": F.max(x),
            "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0),
        }
        if info.family == "float":
            out["infinite"] = F.count_if(F.abs(x) == float("inf"))
    elif info.family == STRING:
        n = F.length(v)
        out |= {"avg_len": F.avg(n), "min_len": F.min(n), "max_len": F.max(n)}
    elif info.family == DATETIME:
        us = epoch_micros(info)
        out |= {"min_us": F.min(us), "max_us": F.max(us)}
    elif info.family == BOOL:
        # the printed lengths of True and False
        n = F.when(v, 4).when(~v, 5)
        out |= {"avg_len": F.avg(n), "min_len": F.min(n), "max_len": F.max(n)}
    return out


def _long(df: DataFrame, columns: list[ColumnInfo], metrics_of, schema: dict[str, str], extra=()) -> DataFrame:
    """One wide aggregate per block of columns, turned into one row per column."""
    cells = [[(c, m, a) for m, a in metrics_of(c).items()] for c in columns]
    parts = []
    for block in cut(cells):
        in_block = {c.ordinal: c for c, _, _ in block}
        have = {(c.ordinal, m) for c, m, _ in block}
        aggregated = df.agg(
            F.count(F.lit(1)).alias("n_rows"), *[a.alias(f"c{c.ordinal}_{m}") for c, m, a in block]
        )
        rows = [
            F.struct(
                F.lit(o).alias("ordinal"),
                *[e(c) for e in extra],
                F.col("n_rows"),
                *[
                    (F.col(f"c{o}_{m}") if (o, m) in have else F.lit(None)).cast(t).alias(m)
                    for m, t in schema.items()
                ],
            )
            for o, c in in_block.items()
        ]
        parts.append(aggregated.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def counts(df: DataFrame, columns: list[ColumnInfo] | None = None) -> DataFrame:
    """First scan: one lazy row per column with counts, sizes, means and extremes."""
    columns = columns_of(df) if columns is None else columns
    labels = (
        lambda c: F.lit(c.name).alias("column_name"),
        lambda c: F.lit(c.data_type.simpleString()).alias("data_type"),
        lambda c: F.lit(c.family).alias("family"),
    )
    long = _long(df, columns, _basic, BASIC, labels)
    return long.withColumn("null_count", F.col("n_rows") - F.col("non_null"))


def spread(df: DataFrame, columns: list[ColumnInfo], means: dict[str, float | None]) -> DataFrame:
    """Second scan: central moments about the given means (one row per numeric column with any value)."""

    def powers(c: ColumnInfo) -> dict[str, Column]:
        d = c.number() - F.lit(means[c.name])
        return {"s2": F.sum(d * d), "s3": F.sum(d * d * d), "s4": F.sum(d * d * d * d), "n": F.count(d)}

    columns = [c for c in columns if c.is_numeric and means.get(c.name) is not None]
    schema = {"s2": "double", "s3": "double", "s4": "double", "n": "bigint"}
    if not columns:
        empty = ", ".join(["ordinal int", *[f"{m} {t}" for m, t in schema.items()]])
        return local(df.sparkSession, [], empty)
    return _long(df, columns, powers, schema).drop("n_rows")


def moments(df: DataFrame, columns: list[ColumnInfo] | None = None, first: DataFrame | None = None) -> DataFrame:
    """All per-column facts, one row per column. ``first`` is a pinned result of ``counts``.

    ``skew_pop`` and ``kurt_pop`` are the population forms; they are null for a constant column.
    """
    columns = columns_of(df) if columns is None else columns
    first = pinned(counts(df, columns)) if first is None else first
    means = {r["column_name"]: r["mean"] for r in first.select("column_name", "mean").collect()}
    second = spread(df, columns, means)
    n, s2 = F.col("n"), F.col("s2")
    m2 = F.try_divide(s2, n)
    varies = (F.col("min_num") < F.col("max_num")) & (s2 > 0)
    return (
        first.join(second, "ordinal", "left")
        .withColumn("variance", F.when(varies, F.try_divide(s2, n - 1)))
        .withColumn("std", F.sqrt("variance"))
        .withColumn("skew_pop", F.when(varies, F.try_divide(F.col("s3") / n, F.pow(m2, 1.5))))
        .withColumn("kurt_pop", F.when(varies, F.try_divide(F.col("s4") / n, m2 * m2) - 3.0))
        .drop("n", "s2", "s3", "s4")
    )
