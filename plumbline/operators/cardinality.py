"""Distinct values, modes, categories and constants.

Ties between equally frequent values go to the smaller value, so that results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed import HIGH_CARDINALITY_RATIO, TOP_CATEGORIES
from plumbline.functions.rounding import percent, ratio, rnd
from plumbline.functions.types import DIGEST_OVER, STRING, ColumnInfo
from plumbline.plans.running import running_total
from plumbline.profile import Profile, as_profile


def _joined(p: Profile) -> DataFrame:
    base = p.counts.select("ordinal", "column_name", "data_type", "family", "kind", "n_rows", "non_null", "null_count")
    return base.join(p.distinct.drop("column_name"), "ordinal")


def distinct_profile(table: DataFrame | Profile) -> DataFrame:
    """Distinct non-missing values, their ratio to all rows, and whether every row differs."""
    p = as_profile(table)
    return _joined(p).select(
        "column_name",
        F.col("ndv").alias("unique_count"),
        rnd(ratio("ndv", "n_rows"), 4).alias("unique_ratio"),
        ((F.col("ndv") == F.col("n_rows")) & (F.col("n_rows") > 0)).alias("is_unique"),
    )


def most_frequent(table: DataFrame | Profile) -> DataFrame:
    """The mode as text, its count, and its share of all rows."""
    p = as_profile(table)
    return _joined(p).select(
        "column_name",
        F.col("mode_text").alias("most_frequent_value"),
        F.col("mode_n").alias("most_frequent_count"),
        percent("mode_n", "n_rows").alias("most_frequent_percentage"),
    )


def cardinality_label(identifier: Column) -> Column:
    """Cardinality class from ``unique_count`` and ``n_rows``; the first that applies."""
    ndv, n_rows = F.col("unique_count"), F.col("n_rows")
    unique = (ndv == n_rows) & (n_rows > 0)
    return (
        F.when(unique | identifier, "Unique Identifier")
        .when(rnd(ratio("unique_count", "n_rows"), 4) > HIGH_CARDINALITY_RATIO, "High Cardinality")
        .when(ndv <= 1, "Zero Variance / Constant")
        .when(ndv <= 10, "Low Cardinality")
        .otherwise("Moderate Cardinality")
    )


def unique_values(table: DataFrame | Profile) -> DataFrame:
    """Distinct counts, mode, semantic type and cardinality class per column."""
    from plumbline.operators.semantics import semantic_types

    p = as_profile(table)
    unique = distinct_profile(p)  # first, for the exact counts serve the types too
    kinds = semantic_types(p).select("column_name", "semantic_type", "ignored")
    return (
        unique
        .join(most_frequent(p), "column_name")
        .join(kinds, "column_name")
        .withColumn("n_rows", F.lit(p.n_rows).cast("bigint"))
        .withColumn(
            "cardinality_status",
            cardinality_label(F.col("semantic_type") == "Identifier"),
        )
        .withColumnRenamed("ignored", "is_identifier")
        .drop("n_rows")
    )


def categorical_profile(table: DataFrame | Profile) -> DataFrame:
    """Distinct count, cardinality ratio and the high-cardinality flag of string and boolean columns."""
    p = as_profile(table)
    share = rnd(ratio("ndv", "n_rows"), 4)
    return (
        _joined(p)
        .where(F.col("ordinal").isin([c.ordinal for c in p.categorical]))
        .select(
            "column_name",
            F.col("ndv").alias("unique_count"),
            share.alias("cardinality_ratio"),
            (share > HIGH_CARDINALITY_RATIO).alias("is_high_cardinality"),
        )
    )


def high_cardinality_columns(table: DataFrame | Profile) -> DataFrame:
    """Names of the string and boolean columns whose rounded ratio exceeds one half."""
    return categorical_profile(table).where("is_high_cardinality").select("column_name", "cardinality_ratio")


def constant_columns(table: DataFrame | Profile) -> DataFrame:
    """Columns with at most one distinct value, including columns without any."""
    p = as_profile(table)
    return p.rule_counts.where("ndv <= 1").select("column_name", F.col("ndv").alias("unique_count"))


def category_counts(table: DataFrame | Profile) -> DataFrame:
    """``(ordinal, column_name, key, n)`` for every category. ``key`` is a digest for a long text."""
    p = as_profile(table)
    names = p.counts.select("ordinal", "column_name")
    return p.category_frequencies.join(F.broadcast(names), "ordinal").select(
        "ordinal", "column_name", F.col("s").alias("key"), "n"
    )


def top_categories(table: DataFrame | Profile, top: int = TOP_CATEGORIES) -> DataFrame:
    """The most frequent values per string or boolean column, with their share of all rows; ties by value.

    The rank limit is applied within each input partition before the shuffle, so a column with a billion distinct
    values sends only ``top`` rows per partition. Columns with long texts are counted by the texts themselves.
    """
    p = as_profile(table)
    long = _long_texts(p)
    w = Window.partitionBy("ordinal").orderBy(F.desc("n"), "key")
    counted = category_counts(p)
    if long:
        counted = counted.where(~F.col("ordinal").isin([c.ordinal for c in long]))
    for c in long:
        best = _value_counts(p, c).orderBy(F.desc("n"), "key").limit(top)
        counted = counted.unionByName(best.select(F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("column_name"), "key", "n"))
    ranked = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select(
        "column_name", "rank", F.col("key").alias("value"), F.col("n").alias("count"),
        percent("n", str(p.n_rows)).alias("percentage"),
    )


def _long_texts(p: Profile) -> list[ColumnInfo]:
    """The columns whose shared frequencies have digests for keys."""
    return [c for c in p.categorical if c.family == STRING and (p.count_rows[c.name]["max_len"] or 0) > DIGEST_OVER]


def _value_counts(p: Profile, c: ColumnInfo) -> DataFrame:
    """``key`` (the value as text) and ``n`` of one column."""
    return p.df.select(c.value().cast("string").alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def frequency_tables(table: DataFrame | Profile, top: int = TOP_CATEGORIES) -> DataFrame:
    """Per column, a map from its most frequent values to their counts."""
    entry = F.struct("rank", "value", "count")
    return (
        top_categories(table, top)
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .select(
            "column_name",
            F.map_from_entries(F.transform("entries", lambda e: F.struct(e["value"], e["count"]))).alias("frequencies"),
        )
    )


def pareto(table: DataFrame | Profile, column: str) -> DataFrame:
    """All values of one column by falling count, with the running share of the column's values in percent."""
    p = as_profile(table)
    counted = _value_counts(p, p.column(column)).select(F.lit(column).alias("column_name"), "key", "n")
    total = F.lit(p.count_rows[column]["non_null"]).cast("bigint")
    summed = running_total(counted, [F.desc("n"), F.asc("key")], "n", "running", text="key").withColumn("total", total)
    return summed.select(
        "column_name",
        F.col("key").alias("value"),
        F.col("n").alias("count"),
        percent("running", "total", 4).alias("cumulative_percentage"),
    )


def class_distribution(table: DataFrame | Profile, column: str) -> DataFrame:
    """Count and share of the non-missing values per value of one column."""
    p = as_profile(table)
    info = p.column(column)
    values = p.df.select(info.value().alias("class")).where("class IS NOT NULL")
    total = F.lit(values.count()).cast("bigint")
    return values.groupBy("class").count().withColumn("total", total).select(
        F.col("class").cast("string").alias("class"),
        "count",
        percent("count", "total").alias("percentage"),
    )
