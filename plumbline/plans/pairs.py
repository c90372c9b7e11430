"""Association between two columns: Pearson, Cramer's V and the correlation ratio, many pairs per scan."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import BOOL, ColumnInfo
from plumbline.plans import coded
from plumbline.plans.blocks import aggregate_arrays
from plumbline.plans.coded import text_key
from plumbline.plans.lookup import lookup
from plumbline.plans.small import local, pinned
from plumbline.profile import Profile

# More numeric columns than this are correlated by matrix products over Arrow batches.
WIDE = 16
# Numeric columns per correlation-ratio scan.
NUMBERS_PER_SCAN = 8
# Largest number of row totals that is broadcast.
BROADCAST_TOTALS = 100_000

Pair = tuple[ColumnInfo, ColumnInfo]
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "min_x", "max_x", "min_y", "max_y")


def _centre(p: Profile, c: ColumnInfo) -> float:
    """A value near the column's mean; sums of differences from it do not cancel."""
    facts = p.count_rows[c.name]
    mean = facts["mean"]
    return mean if mean is not None and abs(mean) < float("inf") else 0.0


def _has_nulls(p: Profile, c: ColumnInfo) -> bool:
    return p.count_rows[c.name]["null_count"] > 0


def pearson(p: Profile, pairs: list[Pair]) -> DataFrame:
    """``(column_a, column_b, n, r, varies)`` over the rows where both columns have a value.

    ``r`` is null where undefined, and ``varies`` says that both sides have two or more values there.
    """
    schema = "column_a string, column_b string, " + ", ".join(f"{s} double" for s in _SUMS)
    names = {c.name for pair in pairs for c in pair}
    if not pairs:
        sums = local(p.spark, [], schema)
    elif len(names) > WIDE:
        sums = _gram(p, pairs)
    else:
        found = aggregate_arrays(p.df, [{(a.name, b.name): _pair_sums(p, a, b)} for a, b in pairs])
        sums = local(p.spark, [(*k, *v) for k, v in found.items()], schema)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    varies = (F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y"))
    raw = F.try_divide(F.col("sxy") - sx * sy / n, F.sqrt(vx * vy))
    r = F.when((n > 0) & varies & ~F.isnan(raw), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    return pinned(
        sums.select("column_a", "column_b", n.cast("bigint").alias("n"), r.alias("r"), varies.alias("varies"))
    )


def _pair_sums(p: Profile, a: ColumnInfo, b: ColumnInfo) -> Column:
    """Sums over complete rows. Between columns without nulls, Spark shares the single-column sums of all pairs."""
    x, y = a.number_sql, b.number_sql
    if _has_nulls(p, b):
        x = f"if({b.number_sql} IS NOT NULL, {x}, NULL)"
    if _has_nulls(p, a):
        y = f"if({a.number_sql} IS NOT NULL, {y}, NULL)"
    dx, dy = f"({x} - {_centre(p, a)!r}D)", f"({y} - {_centre(p, b)!r}D)"
    n = f"count({dx} + {dy})" if _has_nulls(p, a) or _has_nulls(p, b) else "count(1)"
    sums = [dx, dy, f"{dx} * {dx}", f"{dy} * {dy}", f"{dx} * {dy}"]
    listed = ", ".join([f"double({n})", *[f"sum({s})" for s in sums], f"min({x})", f"max({x})", f"min({y})", f"max({y})"])
    return F.expr(f"array({listed})")


def _gram(p: Profile, pairs: list[Pair]) -> DataFrame:
    """The same sums for a wide table: matrix products of each batch, whose totals each task hands on once.

    The extremes of a column beside one without nulls are those of the whole column, which the profile has. Beside one
    with nulls they are taken over the rows where that has a value, of all columns at once. So steps grow with the
    columns that have nulls, not with the pairs.
    """
    used = list({c.name: c for pair in pairs for c in pair}.values())
    place = {c.name: i for i, c in enumerate(used)}
    wanted = np.array([(place[a.name], place[b.name]) for a, b in pairs])
    centres = np.array([_centre(p, c) for c in used])
    lows = np.array([_extreme(p, c, "min_num") for c in used])
    highs = np.array([_extreme(p, c, "max_num") for c in used])
    gaps = np.flatnonzero([_has_nulls(p, c) for c in used])

    def multiply(batches):
        import pyarrow as pa

        totals = None
        width = len(used)
        low, high = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        for batch in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False).astype(float) for col in batch.columns])
            known = ~np.isnan(x)
            m = known.astype(float)
            endless = np.isinf(x).astype(float)
            d = np.where(np.isfinite(x), x - centres, 0.0)
            # Infinite values are counted apart: in a product, one beside a missing value would spoil the pair's sum.
            sums = [m.T @ m, d.T @ m, (d * d).T @ m, d.T @ d, endless.T @ m]
            totals = sums if totals is None else [t + s for t, s in zip(totals, sums, strict=True)]
            # Row k: the extremes of every column where column k has a value.
            for k in gaps:
                rows = x[known[:, k]]
                if len(rows):
                    low[k] = np.fmin(low[k], np.fmin.reduce(rows, axis=0))
                    high[k] = np.fmax(high[k], np.fmax.reduce(rows, axis=0))
        if totals is None:
            return
        mm, dm, qm, dd, em = totals
        dd = np.where(em + em.T > 0, np.nan, dd)
        whole = np.setdiff1d(np.arange(width), gaps)
        low[whole], high[whole] = lows, highs
        left, right = wanted[:, 0], wanted[:, 1]
        values = [mm[left, right], dm[left, right], dm[right, left], qm[left, right], qm[right, left], dd[left, right]]
        ends = [low[right, left], high[right, left], low[left, right], high[left, right]]
        arrays = [pa.array(left, pa.int32()), pa.array(right, pa.int32())]
        arrays += [pa.array(v, pa.float64()) for v in (*values, *ends)]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "j", *_SUMS])

    parts = p.df.select(*[c.number().alias(f"x{i}") for i, c in enumerate(used)]).mapInArrow(
        multiply, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    )
    folds = {s: F.min if s.startswith("min") else F.max if s.startswith("max") else F.sum for s in _SUMS}
    names = F.array(*[F.lit(c.name) for c in used])
    return (
        parts.groupBy("i", "j")
        .agg(*[folds[s](s).alias(s) for s in _SUMS])
        .select(names[F.col("i")].alias("column_a"), names[F.col("j")].alias("column_b"), *_SUMS)
    )


def _extreme(p: Profile, c: ColumnInfo, which: str) -> float:
    found = p.count_rows[c.name][which]
    return float("nan") if found is None else found


def cramers_v(p: Profile, pairs: list[Pair]) -> DataFrame:
    """``(column_a, column_b, n, chi2, v)`` without bias correction, over rows where both have a value.

    chi2 / n + 1 is the sum over non-empty cells of n_ij^2 / (row total x column total), so no dense table is
    built. Columns of few values get codes, and the cells of all pairs of them come from one scan. The other pairs
    are counted by their values, one scan for each column of many values: scans grow with the columns, not the pairs.
    """
    columns = {c.ordinal: c for pair in pairs for c in pair}
    if "small_values" in p.__dict__:  # has run already
        codes = {o: p.small_values[o].values for o in columns if p.small_values[o].values is not None}
    else:
        codes = coded.dictionaries(p.df, list(columns.values()))
    size = p.cardinalities([c for o, c in columns.items() if o not in codes]) | {o: len(v) for o, v in codes.items()}
    numbered = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    few = [(i, a, b) for i, a, b in numbered if a.ordinal in codes and b.ordinal in codes]
    parts = [coded.contingency(coded.count_cells(p.df, few, codes))] if few else []
    by_column: dict[int, list] = {}
    for i, a, b in numbered:
        if a.ordinal not in codes or b.ordinal not in codes:
            rows, cols = sorted((a, b), key=lambda c: (c.ordinal not in codes, size[c.ordinal]))
            by_column.setdefault(cols.ordinal, []).append((i, rows, cols))
    parts += [_by_value(p, block, codes) for block in by_column.values()]
    names = local(p.spark, 
        [(i, a.name, b.name) for i, (a, b) in enumerate(pairs)], "pair int, column_a string, column_b string"
    )
    if not parts:
        return local(p.spark, [], "column_a string, column_b string, n bigint, chi2 double, v double")
    joined = names.join(reduce(DataFrame.unionByName, parts), "pair", "left")
    inside = F.greatest(F.col("s") - 1.0, F.lit(0.0))
    smaller = F.least(F.col("n_rows"), F.col("n_cols")) - 1
    # A few ulps of the sum are noise: an independent pair has no association.
    v = F.when((smaller > 0) & (inside > 1e-12), F.least(F.lit(1.0), F.sqrt(inside / smaller))).otherwise(0.0)
    return joined.select(
        "column_a", "column_b",
        F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("n"),
        F.coalesce(F.col("n") * inside, F.lit(0.0)).alias("chi2"),
        v.alias("v"),
    )


def _by_value(p: Profile, block: list[tuple[int, ColumnInfo, ColumnInfo]], codes: dict[int, list]) -> DataFrame:
    """What ``coded.contingency`` gives, from the values themselves, for pairs of one column with others in one scan.

    The side with fewer distinct values gives the row totals, which are broadcast where they are known to be few. The
    column totals come out of the same aggregation that adds up the cells.
    """
    cells = [F.lit(len(block))]
    for i, rows, cols in block:
        both = rows.value().isNotNull() & cols.value().isNotNull()
        cells += [F.lit(i), F.when(both, text_key(rows)), F.when(both, text_key(cols))]
    counted = (
        p.df.select(F.stack(*cells).alias("pair", "a", "b"))
        .where("a IS NOT NULL")
        .groupBy("pair", "a", "b")
        .agg(F.count(F.lit(1)).cast("double").alias("cell"))
    )
    totals = counted.groupBy("pair", "a").agg(F.sum("cell").alias("row_total"), F.count(F.lit(1)).alias("n"))
    if all(rows.ordinal in codes for _, rows, _ in block) and sum(len(codes[r.ordinal]) for _, r, _ in block) <= BROADCAST_TOTALS:
        weighed = counted.join(F.broadcast(totals), ["pair", "a"])
    else:  # a value with many cells is no hot key either
        weighed = lookup(counted, ["pair", "a"], totals)
    by_column = weighed.groupBy("pair", "b").agg(
        F.sum(F.expr("cell * cell / row_total")).alias("w"), F.sum("cell").alias("col_total")
    )
    summed = by_column.groupBy("pair").agg(
        F.sum(F.col("w") / F.col("col_total")).alias("s"),
        F.sum("col_total").alias("n"),
        F.count(F.lit(1)).alias("n_cols"),
    )
    height = counted.groupBy("pair", "a").agg(F.lit(1).alias("one")).groupBy("pair").agg(F.sum("one").alias("n_rows"))
    return summed.join(height, "pair")


def correlation_ratio(p: Profile, categories: list[ColumnInfo], numbers: list[ColumnInfo]) -> DataFrame:
    """``(category, number, n, eta)`` for every category column against every numeric column.

    Rows are folded to one row per (category column, value) with map-side partials, so a value that holds a third of
    the table is one row per task; the second step adds up the groups.
    """
    parts = []
    for at in range(0, len(numbers), NUMBERS_PER_SCAN):
        block = numbers[at : at + NUMBERS_PER_SCAN]
        cells = [F.lit(len(categories))]
        for c in categories:
            cells += [F.lit(c.ordinal), text_key(c)]
        xs = [c.number().alias(f"x{c.ordinal}") for c in block]
        long = p.df.select(*xs, F.stack(*cells).alias("category", "key")).where("key IS NOT NULL")
        first, second, outputs = [], [], []
        for c in block:
            o = c.ordinal
            x = F.col(f"x{o}")
            d = x - F.lit(_centre(p, c))
            first += [
                F.count(x).alias(f"n{o}"), F.sum(d).alias(f"s{o}"), F.sum(d * d).alias(f"q{o}"),
                F.min(x).alias(f"lo{o}"), F.max(x).alias(f"hi{o}"),
            ]
            s, n = F.col(f"s{o}"), F.col(f"n{o}")
            second += [
                F.sum(n).alias(f"n{o}"), F.sum(s).alias(f"s{o}"), F.sum(f"q{o}").alias(f"q{o}"),
                F.sum(F.when(n > 0, s * s / n)).alias(f"b{o}"), F.count_if(n > 0).alias(f"g{o}"),
                F.min(f"lo{o}").alias(f"lo{o}"), F.max(f"hi{o}").alias(f"hi{o}"),
            ]
            outputs.append(
                F.struct(
                    F.lit(c.name).alias("number"), F.col(f"n{o}").alias("n"), F.col(f"s{o}").alias("s"),
                    F.col(f"q{o}").alias("q"), F.col(f"b{o}").alias("b"), F.col(f"g{o}").alias("g"),
                    (F.col(f"lo{o}") < F.col(f"hi{o}")).alias("varies"),
                )
            )
        folded = long.groupBy("category", "key").agg(*first).groupBy("category").agg(*second)
        parts.append(folded.select(F.col("category").alias("ordinal"), F.inline(F.array(*outputs))))
    names = local(p.spark, [(c.ordinal, c.name) for c in categories], "ordinal int, category string")
    if not parts:
        return names.select("category", F.lit("").alias("number"), F.lit(0).alias("n"), F.lit(0.0).alias("eta")).limit(0)
    shift = F.col("s") * F.col("s") / F.col("n")
    between, total = F.col("b") - shift, F.col("q") - shift
    raw = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(between, total)))
    defined = (F.col("n") > 0) & (F.col("g") > 1) & F.col("varies") & (total > 0) & ~F.isnan(raw)
    eta = F.when(defined, F.least(F.lit(1.0), raw)).otherwise(0.0)
    return (
        reduce(DataFrame.unionByName, parts)
        .join(F.broadcast(names), "ordinal")
        .select("category", "number", "n", F.coalesce(eta, F.lit(0.0)).alias("eta"))
    )


def is_number(p: Profile, c: ColumnInfo) -> bool:
    """Numeric for association purposes: numbers, and booleans without nulls."""
    return c.is_numeric or (c.family == BOOL and not _has_nulls(p, c))
