"""Fully equal rows; missing values equal each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rounding import percent
from plumbline.functions.types import grouping_key, quoted
from plumbline.plans.small import local
from plumbline.profile import Profile, as_profile, row_keys


def duplicate_summary(table: DataFrame | Profile) -> DataFrame:
    """Rows that repeat an earlier row: their number, share, and what that suggests.

    Rows less distinct rows. Copies collapse in the map-side aggregate, so a row that makes up a third of the table
    is one key per task.
    """
    p = as_profile(table)
    counted = local(p.spark, [(p.n_rows, p.n_rows - p.distinct_rows)], "n_rows bigint, duplicate_rows bigint")
    share = percent("duplicate_rows", "n_rows")
    return counted.select(
        "n_rows",
        "duplicate_rows",
        share.alias("duplicate_percentage"),
        F.when(F.col("duplicate_rows") == 0, "none").when(share > 30.0, "redundant").otherwise("contextual")
        .alias("assessment"),
        (F.col("duplicate_rows") > 50).alias("truncated"),
    )


def duplicate_rows(table: DataFrame | Profile, row_id: str) -> DataFrame:
    """Second and later copies of equal rows by the unique column ``row_id`` (not compared itself), in no order.

    The first row of each group is found by a grouped minimum, and the rest is an anti-join on the unique row id.
    No group of copies is ever brought together, as a window over all columns would do.
    """
    p = as_profile(table)
    compared = Profile(p.df.drop(row_id))
    firsts = p.df.groupBy(*row_keys(compared)).agg(F.min(quoted(row_id)).alias(row_id)).select(quoted(row_id))
    return p.df.join(firsts, row_id, "left_anti")


def duplicate_samples(table: DataFrame | Profile, row_id: str, rows: int = 20) -> DataFrame:
    """The first duplicate rows in row order. (Use ``rows=50`` for the sample of duplicate indices.)"""
    return duplicate_rows(table, row_id).orderBy(quoted(row_id)).limit(rows)


def dedupe_rows(table: DataFrame | Profile) -> DataFrame:
    """One of each row, by the keys that the summary counts: NaN and null are one value, and maps can be compared."""
    p = as_profile(table)
    keys = {f"__k{c.ordinal}": grouping_key(c) for c in p.columns}
    return p.df.withColumns(keys).dropDuplicates(list(keys)).drop(*keys) if keys else p.df
