"""Columns with few values: which they are, codes for the values, and the cells of all their pairs counted in one scan.

Tasks gather the values of every column until there are too many, so one scan, whose shuffle holds few values of each task,
tells columns with few values apart for certain. A column's dictionary has its values in order, and a value's code is its place
there, 0 for a missing value. A pair's cell is one integer made of both codes, so that a task counts cells of small pairs in an array
and hands on a row for each that is not empty; pairs with more cells are counted batch by batch. Nothing is shuffled but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.types import DATETIME, FLOAT, ColumnInfo, epoch_micros, grouping_key
from plumbline.plans.frequencies import SLOT_TYPES, value_slot
from plumbline.plans.small import pinned

#: Most values of a column that has codes.
CODED = 1_000
#: Most cells of a pair, and of all such pairs together, that a task counts in arrays.
PAIR_CELLS, TASK_CELLS = 1 << 16, 1 << 22


def text_key(c: ColumnInfo) -> Column:
    """A value as text, alike exactly where values are equal; null for a missing value."""
    key = epoch_micros(c) if c.family == DATETIME else grouping_key(c)
    if isinstance(c.data_type, (T.FloatType, T.DoubleType)):
        key = key + F.lit(0.0)  # one zero
    return key.cast("string")


def _typed(c: ColumnInfo) -> tuple[str, Column]:
    """The slot and a value that is equal exactly where values are: decimals as text, for a double may not tell them apart."""
    if isinstance(c.data_type, T.DecimalType):
        return "s", text_key(c)
    slot, value = value_slot(c)
    return slot, value + F.lit(0.0) if c.family == FLOAT else value


@dataclass
class Values:
    """The values of a column in order, or None if there are too many; and whether one was seen to come twice."""

    values: list | None
    repeated: bool


def few_values(df: DataFrame, columns: list[ColumnInfo], most: int) -> dict[int, Values]:
    """By ordinal, the values of the columns that have ``most`` at most. One scan."""
    if not columns:
        return {}
    slots = [_typed(c)[0] for c in columns]
    ordinals = [c.ordinal for c in columns]

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        types = {"l": pa.int64(), "d": pa.float64(), "s": pa.string()}
        schema = pa.schema([("ordinal", pa.int32()), ("many", pa.bool_()), ("repeated", pa.bool_()), *types.items()])
        known: list[pa.Array | None] = [pa.array([], types[s]) for s in slots]
        repeated = [False] * len(slots)
        for batch in batches:
            for k, column in enumerate(batch.columns):
                if known[k] is None and repeated[k]:
                    continue
                own = pc.unique(column.drop_null())
                repeated[k] |= len(own) < len(column) - column.null_count
                if known[k] is not None:
                    known[k] = pc.unique(pa.concat_arrays([known[k], own.cast(types[slots[k]])]))
                    known[k] = None if len(known[k]) > most else known[k]
        for ordinal, slot, values, twice in zip(ordinals, slots, known, repeated, strict=True):
            n = 1 if values is None else len(values) + 1
            # A row without a value for what else there is to say, and one for each value.
            held = pa.concat_arrays([pa.nulls(1, types[slot]), *([] if values is None else [values])])
            facts = {"ordinal": pa.array([ordinal] * n, pa.int32()), slot: held}
            facts |= {c: pa.array([x] * n, pa.bool_()) for c, x in (("many", values is None), ("repeated", twice))}
            yield pa.RecordBatch.from_arrays([facts.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    gathered = df.select(*[_typed(c)[1].alias(f"c{c.ordinal}") for c in columns]).mapInArrow(
        gather, "ordinal int, many boolean, repeated boolean, " + ", ".join(f"{s} {t}" for s, t in SLOT_TYPES.items())
    )
    each = gathered.groupBy("ordinal", *SLOT_TYPES).agg(
        F.max("many").alias("many"), F.max("repeated").alias("repeated"), F.count(F.lit(1)).alias("tasks")
    )
    # In a task a value stands once: one that several tasks have is repeated.
    order = Window.partitionBy("ordinal").orderBy(*SLOT_TYPES)
    rows = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 2).drop("place")
    found: dict[int, list] = {o: [] for o in ordinals}
    many, twice = set(), set()
    for r in pinned(rows).toLocalIterator():
        value = next((r[s] for s in SLOT_TYPES if r[s] is not None), None)
        if r["many"]:
            many.add(r["ordinal"])
        if r["repeated"] or (value is not None and r["tasks"] > 1):
            twice.add(r["ordinal"])
        if value is not None:
            found[r["ordinal"]].append(value)
    return {o: Values(None if o in many or len(v) > most else sorted(v), o in twice) for o, v in found.items()}


def dictionaries(df: DataFrame, columns: list[ColumnInfo], most: int | None = None) -> dict[int, list]:
    """The values of each column in order, by ordinal, of those columns that have ``most`` at most."""
    most = CODED if most is None else most
    found = few_values(df, columns, most) if most > 0 else {}
    return {o: f.values for o, f in found.items() if f.values is not None}


def count_cells(df: DataFrame, pairs: list[tuple[int, ColumnInfo, ColumnInfo]], codes: dict[int, list]) -> DataFrame:
    """``pair``, ``a``, ``b`` (codes from 1 on) and ``cell``, the rows that have both. One scan for all numbered pairs."""
    used = list({c.ordinal: c for _, *both in pairs for c in both}.values())
    place = {c.ordinal: i for i, c in enumerate(used)}
    values, slots = [codes[c.ordinal] for c in used], [_typed(c)[0] for c in used]
    sizes = [len(v) + 1 for v in values]
    plan, cells = [], 0
    for number, a, b in sorted(pairs, key=lambda x: sizes[place[x[1].ordinal]] * sizes[place[x[2].ordinal]]):
        i, j = place[a.ordinal], place[b.ordinal]
        cells += sizes[i] * sizes[j]
        plan.append((number, i, j, sizes[i] * sizes[j] <= PAIR_CELLS and cells <= TASK_CELLS))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        types = {"l": pa.int64(), "d": pa.float64(), "s": pa.string()}
        sets = [pa.array(v, types[s]) for v, s in zip(values, slots, strict=True)]
        totals = {number: np.zeros(sizes[i] * sizes[j], np.int64) for number, i, j, dense in plan if dense}

        def rows(number: int, j: int, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            a, b = np.divmod(cell, sizes[j])
            use = (a > 0) & (b > 0) & (n > 0)
            columns = [np.full(use.sum(), number), a[use], b[use], n[use]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["pair", "a", "b", "n"])

        for batch in batches:
            coded = [
                pc.fill_null(pc.index_in(column.cast(s.type), value_set=s), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                for column, s in zip(batch.columns, sets, strict=True)
            ]
            for number, i, j, dense in plan:
                cell = coded[i] * sizes[j] + coded[j]
                if dense:
                    totals[number] += np.bincount(cell, minlength=len(totals[number]))
                else:
                    yield rows(number, j, *np.unique(cell, return_counts=True))
        for number, _, j, dense in plan:
            if dense:
                yield rows(number, j, np.arange(len(totals[number])), totals[number])

    counted = df.select(*[_typed(c)[1].alias(f"c{c.ordinal}") for c in used]).mapInArrow(count, "pair int, a int, b int, n bigint")
    return counted.groupBy("pair", "a", "b").agg(F.sum("n").cast("double").alias("cell"))


def contingency(counted: DataFrame) -> DataFrame:
    """By pair: ``s``, the sum of cell^2 / (row total x column total), ``n``, and the rows and columns that are not empty.

    A row or column has as many cells as the other side has values, which are few.
    """
    row, column = Window.partitionBy("pair", "a"), Window.partitionBy("pair", "b")
    weighed = (
        counted.withColumn("col_total", F.sum("cell").over(column))
        .withColumn("in_column", F.row_number().over(column.orderBy("a")))
        .withColumn("row_total", F.sum("cell").over(row))
        .withColumn("in_row", F.row_number().over(row.orderBy("b")))
    )
    return weighed.groupBy("pair").agg(
        F.sum(F.expr("cell * cell / row_total / col_total")).alias("s"),
        F.sum("cell").alias("n"),
        F.count_if(F.col("in_column") == 1).alias("n_cols"),
        F.count_if(F.col("in_row") == 1).alias("n_rows"),
    )
