"""Counts per (column, value) for many columns with one scan and one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import (
    BOOL,
    DATETIME,
    FLOAT,
    INT,
    ColumnInfo,
    columns_of,
    epoch_micros,
    grouping_key,
)


SLOT_TYPES = {"l": "bigint", "d": "double", "s": "string"}


def value_slot(info: ColumnInfo) -> tuple[str, Column]:
    """Where a column's values go, and the value: ``l`` for integers and instants, ``d`` for doubles, ``s`` for keys."""
    if info.family == INT:
        return "l", info.value().cast("bigint")
    if info.family == FLOAT:
        return "d", info.number()
    if info.family == DATETIME:
        return "l", epoch_micros(info)
    if info.family == BOOL:
        return "s", F.initcap(info.value().cast("string"))
    return "s", grouping_key(info)


def long_values(df: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """Non-null cells as rows of ``ordinal`` and the slots that the columns need; one slot holds the value."""
    values = {c.ordinal: value_slot(c) for c in columns}
    used = [s for s in SLOT_TYPES if s in {slot for slot, _ in values.values()}]
    cells = [F.lit(len(columns))]
    for ordinal, (slot, value) in values.items():
        cells.append(F.lit(ordinal))
        cells += [value if s == slot else F.lit(None).cast(SLOT_TYPES[s]) for s in used]
    long = df.select(F.stack(*cells).alias("ordinal", *used))
    return long.where(" OR ".join(f"{s} IS NOT NULL" for s in used))


def frequencies(df: DataFrame, columns: list[ColumnInfo] | None = None) -> DataFrame:
    """``(ordinal, slots, n)``: how often each non-null value occurs.

    Hot values collapse in the map-side partial count, so no value is ever a hot shuffle key. Strings over
    ``DIGEST_OVER`` characters are keyed by their digest.
    """
    long = long_values(df, columns_of(df) if columns is None else columns)
    return long.groupBy(*long.columns).agg(F.count(F.lit(1)).alias("n"))


def distinct_stats(freq: DataFrame) -> DataFrame:
    """One row per column: distinct count, mode (smallest among ties), its count, and the extreme values.

    Values are first folded by how often they occur. A table of N rows has at most sqrt(2N) different occurrence
    counts per column, so the second step is small however many distinct values there are, and its ``max_by`` has no
    ties to break.
    """
    used = [s for s in SLOT_TYPES if s in freq.columns]
    by_count = freq.groupBy("ordinal", "n").agg(
        F.count(F.lit(1)).alias("values"), *[f(c).alias(f"{f.__name__}_{c}") for c in used for f in (F.min, F.max)]
    )
    return by_count.groupBy("ordinal").agg(
        F.sum("values").alias("ndv"),
        F.max("n").alias("mode_n"),
        F.max_by("values", "n").alias("mode_ties"),
        *[F.max_by(f"min_{c}", "n").alias(f"mode_{c}") for c in used],
        *[F.min(f"min_{c}").alias(f"min_{c}") for c in used],
        *[F.max(f"max_{c}").alias(f"max_{c}") for c in used],
    )


def distinct_by_column(df: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """``distinct_stats`` of columns of any type.

    Numbers and texts are counted apart. Each reads only its own columns, the rows shuffled are narrower, and numbers
    are folded by hash, which strings in the aggregation buffer would turn into a sort.
    """
    texts = [c for c in columns if value_slot(c)[0] == "s"]
    numbers = [c for c in columns if value_slot(c)[0] != "s"]
    parts = [distinct_stats(frequencies(df, part)) for part in (numbers, texts) if part]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    absent = {f"{what}_{s}": t for what in ("mode", "min", "max") for s, t in SLOT_TYPES.items()}
    return out.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in out.columns})
