"""Missing values: null or NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rounding import percent
from plumbline.profile import Profile, as_profile


def missing_by_column(table: DataFrame | Profile) -> DataFrame:
    """Missing count and percentage per column."""
    p = as_profile(table)
    return p.counts.select(
        "ordinal",
        "column_name",
        F.col("null_count").alias("missing_count"),
        percent("null_count", "n_rows").alias("missing_percentage"),
    )


def missing_totals(table: DataFrame | Profile) -> DataFrame:
    """Missing cells, all cells and overall percentage."""
    p = as_profile(table)
    return p.counts.agg(
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("total_missing_cells"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_cells"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_missing"),
    ).withColumn("overall_missing_percentage", percent("total_missing_cells", "total_cells"))


def missing_flags(table: DataFrame | Profile) -> DataFrame:
    """Columns with any missing value; ``fully_missing`` tests the rounded percentage, so 99.995 % counts."""
    return (
        missing_by_column(table)
        .where("missing_count > 0")
        .select("column_name", (F.col("missing_percentage") == 100.0).alias("fully_missing"))
    )


def missing_bars(table: DataFrame | Profile) -> DataFrame:
    """Columns with missing values, most affected first."""
    found = missing_by_column(table).where("missing_count > 0")
    return found.orderBy(F.desc("missing_percentage"), "ordinal").drop("ordinal")


def worst_missing_column(table: DataFrame | Profile) -> DataFrame:
    """The column with the highest missing percentage; the first one on ties."""
    found = missing_by_column(table)
    return found.orderBy(F.desc("missing_percentage"), "ordinal").limit(1).drop("ordinal")


def missing_matrix(table: DataFrame | Profile, rows: int = 50) -> DataFrame:
    """Which cells of the first ``rows`` rows are missing, one boolean per column."""
    p = as_profile(table)
    head = p.df.orderBy(*p.order()).limit(rows)
    return head.select(*[c.value().isNull().alias(c.name) for c in p.columns])


def complete_cases(table: DataFrame | Profile, columns: list[str] | None = None) -> DataFrame:
    """Rows without a missing value in the given columns."""
    p = as_profile(table)
    df = p.df
    for c in p.columns:
        if columns is None or c.name in columns:
            df = df.where(c.value().isNotNull())
    return df
