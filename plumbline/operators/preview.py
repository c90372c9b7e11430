"""Shape, types, sizes and sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rounding import percent, rnd
from plumbline.functions.types import columns_of, quoted
from plumbline.plans.small import local
from plumbline.profile import Profile, as_profile

MEGABYTE = 1024.0 * 1024.0


def table_shape(table: DataFrame | Profile) -> DataFrame:
    """Number of rows and columns, and the column names."""
    p = as_profile(table)
    names = F.lit(",".join(c.name for c in p.columns))
    return p.df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(p.columns)).alias("n_columns"), names.alias("column_names")
    )


def dtype_summary(table: DataFrame | Profile) -> DataFrame:
    """Columns per type."""
    p = as_profile(table)
    rows = [(c.data_type.simpleString(),) for c in p.columns]
    return local(p.spark, rows, "data_type string").groupBy("data_type").agg(F.count(F.lit(1)).alias("columns"))


def column_info(table: DataFrame | Profile) -> DataFrame:
    """Position, name, type, value and null counts, null percentage and logical bytes per column."""
    p = as_profile(table)
    return p.counts.select(
        "ordinal", "column_name", "data_type", F.col("non_null").alias("non_null_count"), "null_count",
        percent("null_count", "n_rows").alias("null_percentage"), "bytes",
    )


def logical_bytes(table: DataFrame | Profile) -> DataFrame:
    """Bytes of data per column, and of the table in megabytes."""
    p = as_profile(table)
    total = F.lit(sum(r["bytes"] for r in p.count_rows.values())).cast("bigint")
    return p.counts.withColumn("total_bytes", total).select(
        "column_name", "bytes", "total_bytes", rnd(f"total_bytes / {MEGABYTE}D", 4).alias("total_mb")
    )


def _clean(df: DataFrame) -> DataFrame:
    """Rows with NaN shown as missing."""
    return df.select(*[c.value().alias(c.name) for c in columns_of(df)])


def preview_head(table: DataFrame | Profile, n: int = 5) -> DataFrame:
    """The first rows; a top-n per partition and a merge, not a full sort."""
    p = as_profile(table)
    return _clean(p.df.orderBy(*p.order()).limit(n))


def preview_tail(table: DataFrame | Profile, n: int = 5) -> DataFrame:
    """The last rows, in their own order."""
    p = as_profile(table)
    last = p.df.orderBy(*[c.desc() for c in p.order()]).limit(n)
    return _clean(last.orderBy(*p.order()))


def sampling_order(p: Profile, seed: int) -> list[Column]:
    """An order that mixes the rows: by the MD5 of seed and row order, written as text with colons between them."""
    keys = [F.col(quoted(c)).cast("string") for c in p.order_by]
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), *keys)), *p.order()]


def preview_sample(table: DataFrame | Profile, n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` rows picked by a hash of the row order: the same rows however the table is partitioned."""
    p = as_profile(table)
    return _clean(p.df.orderBy(*sampling_order(p, seed)).limit(n))
