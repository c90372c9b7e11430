"""Scores and ratings computed from the shared aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import (
    HIGH_CARDINALITY_RATIO,
    QUALITY_SLOPE,
    QUALITY_WEIGHT,
    READINESS_PENALTY,
    READINESS_STATUS,
)
from plumbline.functions.rounding import percent, ratio, rnd
from plumbline.functions.types import BOOL, FLOAT, INT, STRING
from plumbline.operators.association import correlation_buckets
from plumbline.operators.numeric import adjusted_kurtosis, adjusted_skewness, distribution_class
from plumbline.operators.outliers import outlier_columns
from plumbline.operators.semantics import semantic_types
from plumbline.plans.small import pinned
from plumbline.profile import Profile, as_profile


def column_facts(table: DataFrame | Profile) -> DataFrame:
    """One row per column with everything that ratings and column-level findings need."""
    p = as_profile(table)
    if "column_facts" not in p.__dict__:
        p.warm("moments", "distinct", "fences", "distinct_rows")
        p.__dict__["column_facts"] = pinned(_joined_facts(p))
    return p.__dict__["column_facts"]


def _joined_facts(p: Profile) -> DataFrame:
    number = F.col("family").isin(INT, FLOAT)
    described = number & (F.col("non_null") > 0)
    category = F.col("family").isin(STRING, BOOL)
    cardinality = rnd(ratio("ndv", "n_rows"), 4)
    joined = (
        p.moments.join(p.distinct.drop("column_name"), "ordinal")
        .join(p.fences.drop("column_name", "non_null", "median", "q1", "q3"), "ordinal", "left")
        .join(semantic_types(p).drop("column_name"), "ordinal")
        .withColumn("skew_adj", adjusted_skewness(F.col("non_null"), F.col("skew_pop")))
        .withColumn("kurt_adj", adjusted_kurtosis(F.col("non_null"), F.col("kurt_pop")))
    )
    return joined.select(
        "ordinal", "column_name", "data_type", "family", "kind", "n_rows", "non_null", "bytes", "mean", "infinite",
        F.col("null_count").alias("missing_count"),
        percent("null_count", "n_rows").alias("missing_percentage"),
        F.col("ndv").alias("unique_count"),
        cardinality.alias("unique_ratio"),
        "semantic_type", "ignored", "mode_text", "mode_n",
        F.col("iqr").alias("raw_iqr"),
        *[F.when(number, c).alias(name) for name, c in outlier_columns().items()],
        F.when(described, rnd("skew_adj", 4)).alias("skewness"),
        F.when(described, rnd("kurt_adj", 4)).alias("kurtosis"),
        F.when(described, distribution_class(F.col("skew_adj"))).alias("distribution"),
        F.when(category, cardinality).alias("cardinality_ratio"),
        F.when(category, cardinality > HIGH_CARDINALITY_RATIO).alias("is_high_cardinality"),
    )


def table_facts(table: DataFrame | Profile) -> DataFrame:
    """One row with everything that the scores and table-level findings need."""
    p = as_profile(table)
    if "table_facts" not in p.__dict__:
        columns = column_facts(p)  # first, for its exact counts serve the correlations too
        strong = correlation_buckets(p).where(F.col("bucket").startswith("strong")).count()
        duplicates = p.n_rows - p.distinct_rows
        p.__dict__["table_facts"] = pinned(_totals(columns, duplicates, strong))
    return p.__dict__["table_facts"]


def _totals(columns: DataFrame, duplicates: int, strong: int) -> DataFrame:
    def total(condition: str, value: str = "outlier_count"):
        return F.expr(f"coalesce(sum({value}) FILTER (WHERE {condition}), 0L)")

    def number_of(condition: str):
        return F.expr(f"count_if({condition})")

    facts = columns.agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_columns"),
        F.sum("bytes").alias("bytes"),
        number_of("kind IN ('int', 'float')").alias("numeric_columns"),
        number_of("kind = 'object'").alias("object_columns"),
        total("true", "missing_count").alias("total_missing_cells"),
        total("true", "n_rows").alias("total_cells"),
        number_of("missing_count > 0").alias("columns_with_missing"),
        number_of("missing_percentage = 100").alias("empty_columns"),
        total("true").alias("outlier_count"),
        number_of("iqr <> 0").alias("spread_columns"),
        number_of("outlier_count > 0 AND outlier_percentage >= 1").alias("outlier_columns"),
        total("outlier_percentage >= 0.5").alias("notable_outliers"),
        total("raw_iqr > 0").alias("spread_outliers"),
        number_of("unique_count <= 1").alias("constant_columns"),
        number_of("is_high_cardinality IS NOT NULL").alias("categorical_columns"),
        number_of("is_high_cardinality").alias("high_cardinality_columns"),
        total("true", "infinite").alias("infinite_count"),
        number_of("abs(skewness) > 1").alias("skewed_columns"),
        F.lit(duplicates).cast("bigint").alias("duplicate_rows"),
        F.lit(strong).cast("bigint").alias("strong_pairs"),
    )
    return facts.withColumns(
        {
            "overall_missing_percentage": percent("total_missing_cells", "total_cells"),
            "duplicate_percentage": percent("duplicate_rows", "n_rows"),
        }
    )


# Percent of the table that each dimension finds affected.
_AFFECTED = {
    "missing_values": "overall_missing_percentage",
    "duplicates": "duplicate_percentage",
    # all outliers, over the cells of the columns whose rounded IQR is not zero
    "outliers": ratio("outlier_count", "spread_columns * n_rows") + " * 100D",
    "constant_columns": ratio("constant_columns", "n_columns") + " * 100D",
    "high_cardinality": ratio("high_cardinality_columns", "categorical_columns") + " * 100D",
    "invalid_values": ratio("infinite_count", "n_rows * n_columns") + " * 100D",
}


def _raw_score(dimension: str) -> str:
    """SQL of an unrounded sub-score: it falls by a fixed number of points per percent affected, not below zero."""
    return f"greatest(0D, 100D - ({_AFFECTED[dimension]}) * {QUALITY_SLOPE[dimension]}D)"


def quality_subscores(table: DataFrame | Profile) -> DataFrame:
    """Six scores from 0 to 100, one row each, with their weight."""
    rows = [
        F.struct(F.lit(d).alias("dimension"), rnd(_raw_score(d), 1).alias("score"), F.lit(w).alias("weight"))
        for d, w in QUALITY_WEIGHT.items()
    ]
    return table_facts(table).select(F.inline(F.array(*rows)))


def quality_score(table: DataFrame | Profile) -> DataFrame:
    """The weighted score, from unrounded sub-scores."""
    total = " + ".join(f"{_raw_score(d)} * {w}D" for d, w in QUALITY_WEIGHT.items())
    return table_facts(table).selectExpr(f"{total} AS total").select(rnd("total", 1).alias("quality_score"))


def quality_radar(table: DataFrame | Profile) -> DataFrame:
    """The chart's own score: completeness, uniqueness, outlier health, a fixed validity, and their overall value.

    Outliers count only in columns with a positive IQR, over all cells of the table.
    """

    def health(bad: str, whole: str):
        share = rnd(f"(1D - {bad} / greatest(1, {whole})) * 100D", 1)
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))

    axes = table_facts(table).select(
        health("total_missing_cells", "total_cells").alias("completeness"),
        health("duplicate_rows", "n_rows").alias("uniqueness"),
        health("spread_outliers", "total_cells").alias("outlier_health"),
        F.lit(100.0).alias("validity"),
    )
    return axes.withColumn("overall", rnd("completeness * 0.4D + uniqueness * 0.3D + outlier_health * 0.3D", 1))


def column_health(table: DataFrame | Profile) -> DataFrame:
    """Rating, reasons, distribution and duplicate impact per column."""
    p = as_profile(table)
    outlier_count = F.coalesce("outlier_count", F.lit(0))
    outlier_pct = F.coalesce("outlier_percentage", F.lit(0.0))
    missing_pct = F.col("missing_percentage")
    poor = (missing_pct > 15.0) | (outlier_pct > 5.0) | (F.col("unique_count") <= 1)
    fair = (missing_pct > 0) | (outlier_count > 0) | (F.col("unique_ratio") > 0.5)
    reasons = F.concat_ws(
        ", ",
        F.when(missing_pct > 15.0, "missing values"),
        F.when(outlier_pct > 5.0, "outliers"),
        F.when(F.col("unique_count") <= 1, "constant"),
    )
    duplicated = F.lit(p.n_rows > p.distinct_rows)
    return column_facts(p).select(
        "column_name", "data_type", "missing_count", "missing_percentage",
        outlier_count.alias("outlier_count"), outlier_pct.alias("outlier_percentage"),
        F.coalesce("distribution", F.lit("Categorical")).alias("distribution"),
        "unique_count", "unique_ratio",
        F.when(F.col("ignored"), "Good").when(poor, "Needs Attention").when(fair, "Good").otherwise("Excellent")
        .alias("column_health"),
        F.when(~F.col("ignored"), reasons).otherwise("").alias("reasons"),
        F.when(duplicated & ~F.col("ignored"), "High").otherwise("Low").alias("duplicate_impact"),
    )


_PENALISED = {
    "missing_values": "overall_missing_percentage",
    "duplicate_rows": "duplicate_percentage",
    "multicollinearity": "strong_pairs",
    "outliers": "outlier_columns",
    "skewed_features": "skewed_columns",
    "constant_columns": "constant_columns",
    "high_cardinality": "high_cardinality_columns",
}


def _penalty(factor: str) -> str:
    """SQL of the points a factor costs."""
    per_unit, most = READINESS_PENALTY[factor]
    return f"least({most}D, {_PENALISED[factor]} * {per_unit}D)"


def readiness_deductions(table: DataFrame | Profile) -> DataFrame:
    """The factors that cost points, with the amount behind each."""
    rows = [
        F.struct(
            F.lit(factor).alias("factor"),
            F.col(_PENALISED[factor]).cast("double").alias("amount"),
            rnd(_penalty(factor), 1).alias("deduction"),
        )
        for factor in _PENALISED
    ]
    return table_facts(table).select(F.inline(F.array(*rows))).where("amount > 0")


def ml_readiness(table: DataFrame | Profile) -> DataFrame:
    """100 less all deductions, and its status."""
    left = " - ".join(["100D", *[_penalty(factor) for factor in _PENALISED]])
    scored = table_facts(table).selectExpr(f"greatest(0D, {left}) AS left").select(rnd("left", 1).alias("score"))
    status = F
    for name, least in READINESS_STATUS:
        status = status.when(F.col("score") >= least, name)
    return scored.withColumn("status", status.otherwise("Poor"))
