"""The aggregates behind the usual charts. Only these leave the cluster, never whole columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rounding import percent, rnd
from plumbline.functions.types import quoted
from plumbline.operators.association import rank_pairs
from plumbline.operators.cardinality import top_categories
from plumbline.operators.missing import complete_cases
from plumbline.operators.numeric import adjusted_skewness
from plumbline.operators.preview import sampling_order
from plumbline.operators.temporal import detect_datetime, records_per
from plumbline.plans.blocks import aggregate_arrays
from plumbline.plans.small import local, pinned
from plumbline.profile import Profile, as_profile

MOST_BINS = 200
# How often the sides of a scatter cell are halved at most, by the number of dimensions; 65,536 and 32,768 of the finest cells.
HALVINGS = {1: 12, 2: 8, 3: 5}


def _bin_count(n: int, low: float, high: float, iqr: float) -> int:
    """The larger of Sturges' and Freedman-Diaconis' number of bins, at most ``MOST_BINS``."""
    if not low < high:
        return 1
    bins = math.ceil(math.log2(n) + 1)
    width = 2.0 * iqr / n ** (1.0 / 3.0)
    if width > 0:
        bins = max(bins, math.ceil((high - low) / width))
    return min(bins, MOST_BINS)


def _bins(p: Profile) -> DataFrame:
    """``(column_name, bin, low, width, n)`` with empty bins, from one scan; infinite values are in no bin."""
    if "bins" in p.__dict__:
        return p.__dict__["bins"]
    shape, cells = [], []
    finite = _finite_facts(p)
    for c in p.numeric:
        facts = p.count_rows[c.name]
        n, low, high, _ = finite.get(c.name, (facts["non_null"], facts["min_num"], facts["max_num"], None))
        if not n:
            continue
        q = p.quartiles[c.name]
        iqr = q[2] - q[0]
        bins = _bin_count(n, low, high, iqr if math.isfinite(iqr) else 0.0)
        width = (high - low) / bins if low < high else 1.0
        x = F.when(F.abs(c.number()) < float("inf"), c.number()) if c.name in finite else c.number()
        at = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1)))
        cells += [F.lit(c.ordinal), at]
        shape.append((c.ordinal, c.name, bins, low, width, n))
    schema = "ordinal int, column_name string, bins int, low double, width double, non_null bigint"
    grid = local(p.spark, shape, schema).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))
    )
    if cells:
        long = p.df.select(F.stack(F.lit(len(shape)), *cells).alias("ordinal", "bin")).where("bin IS NOT NULL")
        counted = long.groupBy("ordinal", "bin").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = local(p.spark, [], "ordinal int, bin int, n bigint")
    filled = grid.join(counted, ["ordinal", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p.__dict__["bins"] = pinned(filled)
    return p.__dict__["bins"]


def _finite_facts(p: Profile) -> dict[str, tuple[int, float, float, float]]:
    """Number, extremes and standard deviation of the finite values, for the columns that also hold infinite ones."""
    if "finite_facts" not in p.__dict__:
        groups = []
        for c in p.numeric:
            if p.count_rows[c.name]["infinite"]:
                x = F.when(F.abs(c.number()) < float("inf"), c.number())
                groups.append({c.name: F.array(F.count(x).cast("double"), F.min(x), F.max(x), F.stddev_samp(x))})
        p.__dict__["finite_facts"] = {k: (int(v[0]), *v[1:]) for k, v in aggregate_arrays(p.df, groups).items()}
    return p.__dict__["finite_facts"]


def histogram_bins(table: DataFrame | Profile) -> DataFrame:
    """Equal-width bins of each numeric column; the maximum belongs to the last bin."""
    p = as_profile(table)
    start = "low + bin * width"
    return _bins(p).select(
        "column_name", "bin", rnd(start, 4).alias("bin_start"), rnd(f"({start}) + width", 4).alias("bin_end"),
        F.col("n").alias("count"),
    )


def density_curve(table: DataFrame | Profile) -> DataFrame:
    """Gaussian kernel density of the finite values at the bin centres, over the binned counts, with Scott's bandwidth."""
    p = as_profile(table)
    finite = _finite_facts(p)
    own = local(p.spark, [(k, v[3], v[0]) for k, v in finite.items()], "column_name string, std double, total bigint")
    whole = p.moments.where(~F.col("column_name").isin(list(finite))).select("column_name", "std", F.col("non_null").alias("total"))
    spread = whole.unionByName(own)
    bins = _bins(p).join(spread, "column_name").withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * F.col("width"))
    points = bins.select("column_name", "bin", "centre", "total", (F.col("std") * F.pow("total", F.lit(-0.2))).alias("h"))
    masses = bins.select("column_name", F.col("centre").alias("at"), "n").where("n > 0")
    z = (F.col("centre") - F.col("at")) / F.col("h")
    kernel = F.exp(-0.5 * z * z) / (F.col("h") * math.sqrt(2.0 * math.pi))
    return (
        points.where("h > 0")
        .join(masses, "column_name")  # at most 200 x 200 rows per column
        .groupBy("column_name", "bin", "centre")
        .agg((F.sum(F.col("n") * kernel) / F.first("total")).alias("density"))
        .select("column_name", "bin", rnd("centre", 4).alias("x"), "density")
    )


def box_stats(table: DataFrame | Profile) -> DataFrame:
    """Five-number summary, whiskers (the last values inside the fences), mean and outlier count."""
    p = as_profile(table)
    means = p.counts.select("column_name", "mean", "min_num", "max_num")
    return p.fences.where("non_null > 0").join(means, "column_name").select(
        "column_name",
        *[
            rnd(c, 4).alias(n)
            for c, n in (
                ("min_num", "min"), ("whisker_low", "whisker_low"), ("q1", "q1"), ("median", "median"), ("q3", "q3"),
                ("whisker_high", "whisker_high"), ("max_num", "max"), ("mean", "mean"),
            )
        ],
        "outlier_count",
    )


def skewness_bars(table: DataFrame | Profile) -> DataFrame:
    """Skewness per numeric column to three decimals."""
    p = as_profile(table)
    skew = adjusted_skewness(F.col("non_null"), F.col("skew_pop"))
    shown = p.moments.where("mean IS NOT NULL").withColumn("skew_adj", skew)
    shown = shown.select("column_name", rnd("skew_adj", 3).alias("skewness"))
    return shown.where("skewness IS NOT NULL")


def _first_category(p: Profile) -> str | None:
    return p.categorical[0].name if p.categorical else None


def category_counts_chart(table: DataFrame | Profile) -> DataFrame:
    """Top ten values of the first categorical column."""
    p = as_profile(table)
    top = top_categories(Profile(p.df.select(quoted(_first_category(p)))) if p.categorical else p)
    return top.select("column_name", "rank", "value", "count")


def category_shares(table: DataFrame | Profile, slices: int = 8) -> DataFrame:
    """Top eight values of the first categorical column, as shares of those eight."""
    top = category_counts_chart(table).where(F.col("rank") <= slices)
    shown = sum(r["count"] for r in top.collect())  # of at most ``slices`` rows
    return top.withColumn("share", percent("count", str(shown)))


def scatter_fit(table: DataFrame | Profile) -> DataFrame:
    """Least-squares line of the strongest pair (b on a); no row without a strong pair."""
    p = as_profile(table)
    top = rank_pairs(p).where("strong_rank = 1").first()
    if top is None:
        return local(p.spark, [], "column_a string, column_b string, correlation double, slope double, intercept double")
    x, y = p.column(top["column_a"]).number(), p.column(top["column_b"]).number()
    line = p.df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return line.select(
        F.lit(top["column_a"]).alias("column_a"), F.lit(top["column_b"]).alias("column_b"),
        F.lit(top["correlation"]).alias("correlation"), rnd("slope", 4).alias("slope"),
        rnd("intercept", 4).alias("intercept"),
    )


def _points(p: Profile, names: list[str], n: int | None, seed: int = 42) -> DataFrame:
    """All complete cases, or a repeatable sample of ``n`` picked by a hash of the row order."""
    kept = complete_cases(p, names)
    picked = kept if n is None else kept.orderBy(*sampling_order(p, seed)).limit(n)
    return picked.select(*p.order(), *[p.column(c).number().alias(c) for c in names if c not in p.order_by])


def scatter_sample(table: DataFrame | Profile, n: int | None = None) -> DataFrame:
    """The points of the strongest pair: all of them, or ``n``."""
    p = as_profile(table)
    top = rank_pairs(p).where("strong_rank = 1").first()
    if top is None:
        return p.df.limit(0)
    return _points(p, [top["column_a"], top["column_b"]], n)


def scatter3d_sample(table: DataFrame | Profile, n: int | None = None) -> DataFrame:
    """Complete cases of the first three numeric columns: all of them, or ``n``."""
    p = as_profile(table)
    return _points(p, [c.name for c in p.numeric[:3]], n)


def _finest_cells(p: Profile, names: list[str], halvings: int) -> tuple[DataFrame, list[tuple[float, float]]]:
    """``(at_0, at_1, ..., n)`` of the complete cases in a regular grid, places null beside an infinity, and each axis' start and range."""
    finite, places, axes = _finite_facts(p), [], []
    for i, name in enumerate(names):
        facts = p.count_rows[name]
        _, low, high, _ = finite.get(name, (0, facts["min_num"], facts["max_num"], None))
        low, high = (0.0, 1.0) if low is None else (low, high if high > low else low + 1.0)
        x, last = p.column(name).number(), (1 << halvings) - 1
        at = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / (1 << halvings))).cast("int"), F.lit(last))
        places.append(F.when(F.abs(x) < float("inf"), at).alias(f"at_{i}"))
        axes.append((low, high - low))
    points = complete_cases(p, names).select(*places)
    beside = F.greatest(*[F.col(f"at_{i}").isNull().cast("int") for i in range(len(names))], F.lit(0)) == 1
    inside = [F.when(~beside, F.col(f"at_{i}")).alias(f"at_{i}") for i in range(len(names))]
    return points.select(*inside).groupBy(*[f"at_{i}" for i in range(len(names))]).agg(F.count(F.lit(1)).alias("n")), axes


def cells(table: DataFrame | Profile, columns: list[str], most: int = 100, halvings: int | None = None) -> DataFrame:
    """Complete cases of one to three numeric columns counted in cells that are smaller where there are more points.

    The box of all finite values is one cell; a cell of more than ``most`` points is halved along every axis, at most
    ``halvings`` times. Every complete case is in one cell, so the counts add up to them; those with an infinite value
    are counted in a row without ``level`` and bounds. One scan counts the finest cells, map-side first; the coarser ones
    are sums of these. An empty table has no rows.
    """
    p = as_profile(table)
    axes_n = len(columns)
    halvings = HALVINGS[axes_n] if halvings is None else halvings
    finest, axes = _finest_cells(p, columns, halvings)
    names = [f"at_{i}" for i in range(axes_n)]
    finest = pinned(finest)  # no more rows than the finest cells
    inside = finest.where("at_0 IS NOT NULL").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(halvings))))
    coarse = [F.expr(f"shiftright({c}, {halvings} - level)").alias(c) for c in names]
    levels = inside.select("level", *coarse, "n").groupBy("level", *names).agg(F.sum("n").alias("n"))
    split = levels.where((F.col("n") > most) & (F.col("level") < halvings))
    below = split.select((F.col("level") + 1).alias("level"), *[F.col(c).alias(f"_{c}") for c in names])
    on = [F.col("c.level") == F.col("s.level"), *[F.expr(f"shiftright(c.{c}, 1) = s._{c}") for c in names]]
    ends = levels.where((F.col("n") <= most) | (F.col("level") == halvings)).alias("c")
    kept = ends.where("level = 0").unionByName(ends.where("level > 0").join(below.alias("s"), on, "left_semi"))
    bounds = []
    for i, (low, span) in enumerate(axes):
        side = f"({span!r}D / power(2.0D, level))"
        bounds += [
            rnd(f"{low!r}D + {names[i]} * {side}", 4).alias(f"low_{i}"),
            rnd(f"{low!r}D + ({names[i]} + 1) * {side}", 4).alias(f"high_{i}"),
        ]
    titles = [F.lit(c).alias(f"column_{i}") for i, c in enumerate(columns)]
    unplaced = finest.where("at_0 IS NULL").withColumn("level", F.lit(None).cast("int"))
    return kept.unionByName(unplaced.select(*kept.columns)).select(*titles, "level", *bounds, F.col("n").alias("count"))


def scatter_cells(table: DataFrame | Profile, most: int = 100) -> DataFrame:
    """The points of the strongest pair, counted in cells; no row without a strong pair."""
    p = as_profile(table)
    top = rank_pairs(p).where("strong_rank = 1").first()
    if top is None:
        schema = "column_0 string, column_1 string, level int, low_0 double, high_0 double, low_1 double, high_1 double, count bigint"
        return local(p.spark, [], schema)
    return cells(p, [top["column_a"], top["column_b"]], most)


def scatter3d_cells(table: DataFrame | Profile, most: int = 100) -> DataFrame:
    """Complete cases of the first three numeric columns, counted in cells."""
    p = as_profile(table)
    return cells(p, [c.name for c in p.numeric[:3]], most)


def datetime_bars(table: DataFrame | Profile) -> DataFrame:
    """Rows per year, month and weekday of the first datetime column."""
    p = as_profile(table)
    first = detect_datetime(p).where("detected").join(p.counts.select("ordinal", "column_name"), "column_name")
    name = first.orderBy("ordinal").select("column_name").first()
    chosen = F.col("column_name") == (name[0] if name else "")
    parts = [records_per(p, part).where(chosen).withColumn("part", F.lit(part)) for part in ("year", "month", "weekday")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
