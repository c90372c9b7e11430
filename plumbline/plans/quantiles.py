"""Exact quantiles with linear interpolation, without ever gathering a whole column in one task.

Each wanted order statistic is found by selection. A pass over the data sketches the column, which gives an open
interval that is all but sure to hold the wanted rank. The next pass counts exactly how many rows lie below, on and
between the interval's ends. Every round shrinks the interval by the sketch's error, or, on heavily repeated values,
at least drops both ends; a miss only widens it again. So the answer is exact whatever the sketch returned. Once at
most ``GATHER_ROWS`` values remain inside, they are gathered and sorted within the aggregate, which hands on the wanted
ones alone: the driver gets a few numbers per column. Each pass is a global aggregate: it shuffles sketches and counts. Two sketching rounds and a last look do for 10^12 rows; a table of up to
``GATHER_ROWS`` rows takes one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import ColumnInfo
from plumbline.plans.blocks import aggregate_arrays

QUARTILES = (0.25, 0.5, 0.75)
GATHER_ROWS = 100_000
# Size of the KLL sketch, and a rank distance its error stays within in all but freak cases.
SKETCH_K = 4_096
SLACK = 0.004


@dataclass
class _Search:
    """The search for the value of 0-based rank ``rank``, known to lie strictly between ``lo`` and ``hi``."""

    column: ColumnInfo
    rank: int
    below: int  # rows <= lo
    inside: int  # rows in (lo, hi)
    lo: float = -math.inf
    hi: float = math.inf
    value: float | None = None

    @property
    def interval(self):
        return (self.column.name, self.lo, self.hi)

    def within(self) -> str:
        """SQL of the column's values inside the interval; an open end still leaves infinities out."""
        x = self.column.number_sql
        above = f"{x} > {_literal(self.lo)}"
        return f"if({above} AND {x} < {_literal(self.hi)}, {x}, NULL)"

    def share(self) -> float:
        return (self.rank - self.below) / max(self.inside - 1, 1)


def _literal(x: float) -> str:
    return f"{x!r}D" if abs(x) < math.inf else f"double('{x}')"


def _per_column(entries) -> list[dict]:
    """Expressions keyed uniquely and grouped by column, so that a block reads whole columns."""
    grouped: dict[str, dict] = {}
    for name, key, sql in entries:
        grouped.setdefault(name, {}).setdefault(key, sql)
    return [{key: F.expr(sql) for key, sql in g.items()} for g in grouped.values()]


def exact_quantiles(
    df: DataFrame,
    columns: list[ColumnInfo],
    probs: tuple[float, ...] = QUARTILES,
    *,
    counts: dict[str, int],
    infinite: dict[str, tuple[int, int]] | None = None,
    gather_rows: int = GATHER_ROWS,
    sketch_k: int = SKETCH_K,
    slack: float = SLACK,
) -> dict[str, list[float]]:
    """Quantiles per column name, for columns with any value.

    ``counts`` holds the non-null rows per column, ``infinite`` the rows equal to minus and plus infinity of the
    columns that have some.
    """
    columns = [c for c in columns if counts[c.name] > 0]
    searches: dict[tuple[str, int], _Search] = {}
    for c in columns:
        n = counts[c.name]
        low, high = (infinite or {}).get(c.name, (0, 0))
        for p in probs:
            for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                s = _Search(c, rank, low, n - low - high)
                s.value = -math.inf if rank < low else math.inf if rank >= n - high else None
                searches[(c.name, rank)] = s

    while pending := [s for s in searches.values() if s.value is None]:
        _narrow(df, pending, gather_rows, sketch_k, slack)

    out = {}
    for c in columns:
        values = []
        for p in probs:
            at = p * (counts[c.name] - 1)
            a, b = (searches[(c.name, r)].value for r in (math.floor(at), math.ceil(at)))
            values.append(a if a == b else a + (b - a) * (at - math.floor(at)))
        out[c.name] = values
    return out


def _narrow(df: DataFrame, pending: list[_Search], gather_rows: int, sketch_k: int, slack: float) -> None:
    """One round: settle the searches whose interval is small, and shrink the intervals of the others."""
    small = [s for s in pending if s.inside <= gather_rows]
    large = [s for s in pending if s.inside > gather_rows]

    def ends_of(s: _Search) -> tuple[float, float]:
        return max(0.0, s.share() - slack), min(1.0, s.share() + slack)

    probes: dict[tuple, list[float]] = {}
    for s in large:
        wanted = probes.setdefault(s.interval, [])
        wanted += [p for p in ends_of(s) if p not in wanted]

    places: dict[tuple, list[int]] = {}
    for s in small:
        places.setdefault(s.interval, []).append(s.rank - s.below)
    entries = []
    for s in small:
        wanted = ", ".join(f"element_at(sort_array(collect_list({s.within()})), {at + 1})" for at in places[s.interval])
        entries.append((s.column.name, ("at", s.interval), f"array({wanted})"))
    for s in large:
        ranks = ", ".join(map(_literal, probes[s.interval]))
        ends = f"kll_sketch_get_quantile_double(kll_sketch_agg_double({s.within()}, {sketch_k}), array({ranks}))"
        entries.append((s.column.name, ("ends", s.interval), ends))
    found = aggregate_arrays(df, _per_column(entries))
    for s in small:
        s.value = found[("at", s.interval)][places[s.interval].index(s.rank - s.below)]

    entries, brackets = [], []
    for s in large:
        at = dict(zip(probes[s.interval], found[("ends", s.interval)]))
        brackets.append(tuple(at[p] for p in ends_of(s)))
        x = s.column.number_sql
        entries += [
            (s.column.name, (s.column.name, t), f"array(count_if({x} < {_literal(t)}), count_if({x} <= {_literal(t)}))")
            for t in brackets[-1]
        ]
    found = aggregate_arrays(df, _per_column(entries))
    for s, (a, b) in zip(large, brackets):
        (lt_a, le_a), (lt_b, le_b) = (map(int, found[(s.column.name, t)]) for t in (a, b))
        if lt_a <= s.rank < le_a:
            s.value = a
        elif lt_b <= s.rank < le_b:
            s.value = b
        elif s.rank < lt_a:  # missed: it lies between the old lower end and a
            s.hi, s.inside = a, lt_a - s.below
        elif s.rank >= le_b:  # missed: it lies between b and the old upper end
            s.lo, s.inside, s.below = b, s.below + s.inside - le_b, le_b
        else:
            s.lo, s.hi, s.below, s.inside = a, b, le_a, lt_b - le_a


def approx_quantiles(
    df: DataFrame, columns: list[ColumnInfo], probs: tuple[float, ...] = QUARTILES, accuracy: int = 10_000
) -> dict[str, list[float]]:
    """One pass with the built-in sketch; the rank is off by at most ``1/accuracy``."""
    wanted = F.array(*[F.lit(p) for p in probs])
    found = aggregate_arrays(
        df, [{c.name: F.approx_percentile(c.number(), wanted, F.lit(accuracy))} for c in columns]
    )
    return {name: values for name, values in found.items() if values is not None}
