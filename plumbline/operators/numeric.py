"""Descriptive statistics of numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rounding import rnd
from plumbline.functions.types import FLOAT, INT
from plumbline.plans.small import local
from plumbline.profile import Profile, as_profile

NOTE_ALL_MISSING = "All values are missing; no statistics."


def numeric_columns(table: DataFrame | Profile) -> DataFrame:
    """Names of the numeric columns; booleans are not numeric."""
    return _names(as_profile(table), as_profile(table).numeric)


def categorical_columns(table: DataFrame | Profile) -> DataFrame:
    """Names of the string and boolean columns."""
    return _names(as_profile(table), as_profile(table).categorical)


def _names(p: Profile, columns) -> DataFrame:
    rows = [(c.ordinal, c.name, c.data_type.simpleString()) for c in columns]
    return local(p.spark, rows, "ordinal int, column_name string, data_type string")


def adjusted_skewness(n: Column, population: Column) -> Column:
    """Sample skewness G1; 0.0 for fewer than three values or a constant column, null if not a number."""
    n = n.cast("double")
    g1 = F.when((n > 2) & population.isNotNull(), population * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    return F.when(~F.isnan(g1), g1)


def adjusted_kurtosis(n: Column, population: Column) -> Column:
    """Sample excess kurtosis G2; 0.0 for fewer than four values or a constant column, null if not a number."""
    n = n.cast("double")
    g2 = F.when(
        (n > 3) & population.isNotNull(), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6.0)
    ).otherwise(0.0)
    return F.when(~F.isnan(g2), g2)


def distribution_class(skewness: Column) -> Column:
    """Shape label of an unrounded skewness. Kurtosis plays no part."""
    return (
        F.when(skewness > 1.0, "Highly Right Skewed")
        .when(skewness < -1.0, "Highly Left Skewed")
        .when(skewness > 0.5, "Slightly Right Skewed")
        .when(skewness < -0.5, "Slightly Left Skewed")
        .otherwise("Normal")
    )


def _or_zero(x: str) -> str:
    """Zero for a missing value or NaN."""
    return f"if(isnan({x}), 0D, coalesce({x}, 0D))"


def _numeric_rows(p: Profile) -> DataFrame:
    skew = adjusted_skewness(F.col("non_null"), F.col("skew_pop"))
    kurt = adjusted_kurtosis(F.col("non_null"), F.col("kurt_pop"))
    return p.moments.where(F.col("family").isin(INT, FLOAT)).withColumns({"skew_adj": skew, "kurt_adj": kurt})


def numeric_describe(table: DataFrame | Profile) -> DataFrame:
    """Count, mean, standard deviation, variance (n-1), minimum, maximum and range of columns with any value."""
    p = as_profile(table)
    return _numeric_rows(p).where("non_null > 0").select(
        "column_name",
        F.col("non_null").alias("count"),
        rnd("mean", 4).alias("mean"),
        rnd(_or_zero("std"), 4).alias("std"),
        rnd(_or_zero("variance"), 4).alias("variance"),
        rnd("min_num", 4).alias("min"),
        rnd("max_num", 4).alias("max"),
        rnd("max_num - min_num", 4).alias("range"),
    )


def numeric_quantiles(table: DataFrame | Profile) -> DataFrame:
    """Quartiles, median and interquartile range by linear interpolation; exact unless the profile is not."""
    p = as_profile(table)
    rows = [(name, q[0], q[1], q[2]) for name, q in p.quartiles.items()]
    df = local(p.spark, rows, "column_name string, q1 double, median double, q3 double")
    return df.select(
        "column_name",
        *[rnd(c, 4).alias(c) for c in ("q1", "median", "q3")],
        rnd("q3 - q1", 4).alias("iqr"),
    )


def numeric_mode(table: DataFrame | Profile) -> DataFrame:
    """The most frequent value, the smallest one on ties."""
    p = as_profile(table)
    return _of_numeric(p, p.distinct).where("ndv > 0").select(
        "column_name", rnd("mode_number", 4).alias("mode"), F.col("mode_n").alias("mode_count")
    )


def _of_numeric(p: Profile, df: DataFrame) -> DataFrame:
    return df.where(F.col("ordinal").isin([c.ordinal for c in p.numeric]))


def skewness_kurtosis(table: DataFrame | Profile) -> DataFrame:
    """Adjusted skewness and excess kurtosis, and the shape label."""
    p = as_profile(table)
    return _numeric_rows(p).where("non_null > 0").select(
        "column_name",
        rnd("skew_adj", 4).alias("skewness"),
        rnd("kurt_adj", 4).alias("kurtosis"),
        distribution_class(F.col("skew_adj")).alias("distribution"),
    )


def zero_negative_counts(table: DataFrame | Profile) -> DataFrame:
    """Values equal to zero and below zero."""
    p = as_profile(table)
    return _numeric_rows(p).select(
        "column_name", F.col("zeros").alias("zero_count"), F.col("negatives").alias("negative_count")
    )


def invalid_values(table: DataFrame | Profile) -> DataFrame:
    """Infinite values per numeric column, and over the whole table."""
    p = as_profile(table)
    found = p.counts.where(F.col("family").isin(INT, FLOAT)).select(
        "ordinal", "column_name", F.coalesce("infinite", F.lit(0)).alias("infinite_count")
    )
    total = sum(r["infinite_count"] for r in found.collect())
    return found.select("column_name", "infinite_count", F.lit(total).cast("bigint").alias("infinite_total"))


def numeric_profile(table: DataFrame | Profile) -> DataFrame:
    """All statistics per numeric column, or a note for a column without values."""
    p = as_profile(table)
    p.warm("moments", "distinct", "fences")
    stats = (
        _numeric_rows(p)
        .join(p.fences.drop("column_name", "non_null"), "ordinal")
        .join(p.distinct.drop("column_name"), "ordinal")
    )
    has = F.col("non_null") > 0

    def shown(c: Column, name: str) -> Column:
        return F.when(has, c).alias(name)

    return stats.select(
        "column_name",
        shown(F.col("non_null"), "count"),
        shown(rnd("mean", 4), "mean"),
        shown(rnd("median", 4), "median"),
        shown(rnd("mode_number", 4), "mode"),
        shown(rnd(_or_zero("std"), 4), "std"),
        shown(rnd(_or_zero("variance"), 4), "variance"),
        shown(rnd("min_num", 4), "min"),
        shown(rnd("max_num", 4), "max"),
        shown(rnd("max_num - min_num", 4), "range"),
        shown(rnd("q1", 4), "q1"),
        shown(rnd("q3", 4), "q3"),
        shown(rnd("iqr", 4), "iqr"),
        shown(rnd("skew_adj", 4), "skewness"),
        shown(rnd("kurt_adj", 4), "kurtosis"),
        shown(distribution_class(F.col("skew_adj")), "distribution"),
        shown(F.col("ndv"), "unique_count"),
        shown(F.col("zeros"), "zero_count"),
        shown(F.col("negatives"), "negative_count"),
        shown(F.col("outlier_count"), "outlier_count"),
        F.when(~has, NOTE_ALL_MISSING).alias("note"),
    )


def distribution_summary(table: DataFrame | Profile) -> DataFrame:
    """Shape label per numeric column."""
    return skewness_kurtosis(table).select("column_name", "distribution")


def numeric_feature_summary(table: DataFrame | Profile) -> DataFrame:
    """Shape, skewness, kurtosis and outlier count per numeric column."""
    p = as_profile(table)
    p.warm("moments", "fences")
    outliers = p.fences.select("column_name", "outlier_count")
    return skewness_kurtosis(p).join(outliers, "column_name").select(
        "column_name", "distribution", "skewness", "kurtosis", "outlier_count",
        F.format_string("%s: %s, skewness %.4f, %d outliers", "column_name", "distribution", "skewness", "outlier_count")
        .alias("note"),
    )
