"""The whole profile of a table, section by section."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from plumbline.operators import (
    association,
    cardinality,
    duplicates,
    findings,
    missing,
    numeric,
    outliers,
    preview,
    quality,
    semantics,
    temporal,
)
from plumbline.plans.small import local
from plumbline.profile import Profile, as_profile

SECTIONS = {
    "shape": preview.table_shape,
    "types": preview.dtype_summary,
    "columns": preview.column_info,
    "numeric": numeric.numeric_profile,
    "numeric_features": numeric.numeric_feature_summary,
    "distributions": numeric.distribution_summary,
    "missing": missing.missing_by_column,
    "missing_totals": missing.missing_totals,
    "duplicates": duplicates.duplicate_summary,
    "semantics": semantics.semantic_types,
    "unique_values": cardinality.unique_values,
    "categories": cardinality.categorical_profile,
    "top_categories": cardinality.top_categories,
    "outliers": outliers.iqr_outliers,
    "correlations": association.pearson_matrix,
    "correlation_pairs": association.rank_pairs,
    "relationships": association.feature_relationships,
    "datetimes": temporal.datetime_summary,
    "column_health": quality.column_health,
    "quality_subscores": quality.quality_subscores,
    "quality_score": quality.quality_score,
    "readiness": quality.ml_readiness,
    "findings": findings.findings,
    "preparation": findings.prep_plan,
}
# These show rows in row order, so they need ``order_by``.
ORDERED_SECTIONS = {"head": preview.preview_head, "tail": preview.preview_tail, "sample": preview.preview_sample}


def full_profile(table: DataFrame | Profile, sections: list[str] | None = None) -> dict[str, DataFrame]:
    """Every section by name. Sections share the profile's aggregates, each of which runs once."""
    p = as_profile(table)
    known = SECTIONS | (ORDERED_SECTIONS if p.order_by else {})
    return {name: make(p) for name, make in known.items() if sections is None or name in sections}


def profile_meta(table: DataFrame | Profile) -> DataFrame:
    """Column counts, and the seconds that the shared aggregates took."""
    p = as_profile(table)
    started = time.monotonic()
    rows, numeric_count, categorical_count = p.n_rows, len(p.numeric), len(p.categorical)
    seconds = round(time.monotonic() - started, 4)
    schema = "n_rows bigint, numeric_columns int, categorical_columns int, seconds double"
    return local(p.spark, [(rows, numeric_count, categorical_count, seconds)], schema)
