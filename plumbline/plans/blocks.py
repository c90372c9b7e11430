"""Wide global aggregates, cut into blocks that the JVM can compile."""

from __future__ import annotations

from collections.abc import Hashable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aggregate expressions per block. Far beyond this the generated update method outgrows what the JIT compiles and
# runs many times slower. Blocks hold whole columns, so on columnar files cutting adds no bytes read.
PER_BLOCK = 32
# The same for aggregates that are arrays of several expressions.
ARRAYS_PER_BLOCK = 8


def cut(groups: list[list], per_block: int = PER_BLOCK) -> list[list]:
    """Pack groups (one per column) into blocks of at most ``per_block`` entries, or one group if it is larger."""
    blocks: list[list] = []
    for g in groups:
        if blocks and len(blocks[-1]) + len(g) <= per_block:
            blocks[-1] += g
        else:
            blocks.append(list(g))
    return blocks


def aggregate_arrays(df: DataFrame, groups: list[dict[Hashable, Column]]) -> dict[Hashable, list]:
    """Evaluate global aggregates that each yield an array of doubles; one dict of expressions per column.

    All blocks run as parallel branches of one job, and one row per block reaches the driver.
    """
    blocks = cut([list(g.items()) for g in groups if g], ARRAYS_PER_BLOCK)
    if not blocks:
        return {}
    parts = [
        df.agg(F.array(*[e.cast("array<double>") for _, e in block]).alias("a")).select(F.lit(i).alias("b"), "a")
        for i, block in enumerate(blocks)
    ]
    rows = reduce(DataFrame.union, parts).collect()
    return {key: value for r in rows for (key, _), value in zip(blocks[r["b"]], r["a"])}
