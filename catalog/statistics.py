"""Numeric statistics, outliers and chart aggregates."""

from __future__ import annotations

from catalog.registry import EVENTS, GAPS, INFINITE, LINEITEM, ORDERS, PRICES, Source, query
from catalog.sql import EVENTS as EVENTS_COLUMNS
from catalog.sql import GAPS as GAPS_COLUMNS
from catalog.sql import LINEITEM_NUMERIC, column_facts, pct, r, shape_label, union
from plumbline.functions.rounding import rnd
from plumbline.operators import charts, numeric, outliers

NUMBERS = Source("lineitem", *[c for c, _ in LINEITEM_NUMERIC], order_by=LINEITEM.order_by)
_FACTS = f"WITH {column_facts(NUMBERS.sql, LINEITEM_NUMERIC)}"
_GAPS_NUMERIC = [c for c in GAPS_COLUMNS if c[1] in ("int", "float")]
_GAPS_FACTS = f"WITH {column_facts(GAPS.sql, _GAPS_NUMERIC)}"
_EVENTS_NUMERIC = [c for c in EVENTS_COLUMNS if c[1] in ("int", "float")]
_EVENTS_FACTS = f"WITH {column_facts(EVENTS.sql, _EVENTS_NUMERIC)}"


def _coarse_variance(df):
    """Variances of prices have no four stable decimals: the order of additions shows in the last ones."""
    return df.withColumn("variance", rnd("variance", 0))


_VARIANCE = r(r("variance"), 0)


@query(
    "numeric_describe",
    f"{_FACTS} SELECT column_name, n AS count, {r('mean')} AS mean, {r('std')} AS std, {_VARIANCE} AS variance,"
    f" {r('mn')} AS min, {r('mx')} AS max, {r('mx - mn')} AS range FROM cols",
)
def numeric_describe(spark, sf_dir):
    return _coarse_variance(numeric.numeric_describe(NUMBERS.frame(spark, sf_dir)))


@query(
    "numeric_quantiles",
    f"{_FACTS} SELECT column_name, {r('q1')} AS q1, {r('q2')} AS median, {r('q3')} AS q3, {r('iqr')} AS iqr FROM cols",
)
def numeric_quantiles(spark, sf_dir):
    return numeric.numeric_quantiles(NUMBERS.frame(spark, sf_dir))


@query("numeric_quantiles_approx")
def numeric_quantiles_approx(spark, sf_dir):
    return numeric.numeric_quantiles(NUMBERS.profile(spark, sf_dir, exact=False))


@query("numeric_mode", f"{_FACTS} SELECT column_name, {r('mode_number')} AS mode, mode_n AS mode_count FROM cols")
def numeric_mode(spark, sf_dir):
    return numeric.numeric_mode(NUMBERS.frame(spark, sf_dir))


@query("skewness_adj", f"{_EVENTS_FACTS} SELECT column_name, {r('skew')} AS skewness FROM cols")
def skewness_adj(spark, sf_dir):
    return numeric.skewness_kurtosis(EVENTS.frame(spark, sf_dir)).select("column_name", "skewness")


@query("kurtosis_adj", f"{_EVENTS_FACTS} SELECT column_name, {r('kurt')} AS kurtosis FROM cols")
def kurtosis_adj(spark, sf_dir):
    return numeric.skewness_kurtosis(EVENTS.frame(spark, sf_dir)).select("column_name", "kurtosis")


@query("distribution_class", f"{_EVENTS_FACTS} SELECT column_name, {shape_label('skew')} AS distribution FROM cols")
def distribution_class(spark, sf_dir):
    return numeric.distribution_summary(EVENTS.frame(spark, sf_dir))


@query("distribution_summary", f"{_FACTS} SELECT column_name, {shape_label('skew')} AS distribution FROM cols")
def distribution_summary(spark, sf_dir):
    return numeric.distribution_summary(NUMBERS.frame(spark, sf_dir))


@query(
    "zero_negative_counts", f"{_FACTS} SELECT column_name, zeros AS zero_count, negatives AS negative_count FROM cols"
)
def zero_negative_counts(spark, sf_dir):
    return numeric.zero_negative_counts(NUMBERS.frame(spark, sf_dir))


def _numeric_profile_sql(facts: str) -> str:
    return (
        f"{facts} SELECT column_name, CASE WHEN n > 0 THEN n END AS count, {r('mean')} AS mean, {r('q2')} AS median,"
        f" {r('mode_number')} AS mode, CASE WHEN n > 0 THEN {r('std')} END AS std, CASE WHEN n > 0 THEN {_VARIANCE} END AS variance,"
        f" {r('mn')} AS min, {r('mx')} AS max, {r('mx - mn')} AS range, {r('q1')} AS q1, {r('q3')} AS q3, {r('iqr')} AS iqr,"
        f" CASE WHEN n > 0 THEN {r('skew')} END AS skewness, CASE WHEN n > 0 THEN {r('kurt')} END AS kurtosis,"
        f" CASE WHEN n > 0 THEN {shape_label('skew')} END AS distribution, CASE WHEN n > 0 THEN ndv END AS unique_count,"
        " CASE WHEN n > 0 THEN zeros END AS zero_count, CASE WHEN n > 0 THEN negatives END AS negative_count,"
        " CASE WHEN n > 0 THEN outliers END AS outlier_count,"
        " CASE WHEN n = 0 THEN 'All values are missing; no statistics.' END AS note FROM cols"
    )


@query("numeric_profile", _numeric_profile_sql(_FACTS))
def numeric_profile(spark, sf_dir):
    return _coarse_variance(numeric.numeric_profile(NUMBERS.frame(spark, sf_dir)))


@query("numeric_profile_gaps", _numeric_profile_sql(_GAPS_FACTS))
def numeric_profile_gaps(spark, sf_dir):
    """With missing values, and a column that has no value at all."""
    return _coarse_variance(numeric.numeric_profile(GAPS.frame(spark, sf_dir)))


@query(
    "numeric_feature_summary",
    f"{_EVENTS_FACTS} SELECT column_name, {shape_label('skew')} AS distribution, {r('skew')} AS skewness, {r('kurt')} AS kurtosis,"
    f" outliers AS outlier_count, printf('%s: %s, skewness %.4f, %d outliers', column_name, {shape_label('skew')}, {r('skew')}, outliers)"
    " AS note FROM cols",
)
def numeric_feature_summary(spark, sf_dir):
    return numeric.numeric_feature_summary(EVENTS.frame(spark, sf_dir))


def _outliers_sql(facts: str) -> str:
    return (
        f"{facts} SELECT column_name, CASE WHEN ndv > 1 THEN {r('iqr')} ELSE 0 END AS iqr, {r('lo')} AS lower_bound,"
        f" {r('hi')} AS upper_bound, outliers AS outlier_count, {pct('outliers', 'n')} AS outlier_percentage FROM cols"
    )


@query("iqr_outliers", _outliers_sql(_GAPS_FACTS))
def iqr_outliers(spark, sf_dir):
    return outliers.iqr_outliers(GAPS.frame(spark, sf_dir))


@query("iqr_outliers_lineitem", _outliers_sql(_FACTS))
def iqr_outliers_lineitem(spark, sf_dir):
    return outliers.iqr_outliers(NUMBERS.frame(spark, sf_dir))


_EVENT_FENCES = (
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),"
    " f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"
)


@query("outlier_rows", f"{_EVENT_FENCES} SELECT events.* FROM events, f WHERE value < lo OR value > hi")
def outlier_rows(spark, sf_dir):
    return outliers.outlier_rows(EVENTS.profile(spark, sf_dir), "value")


@query(
    "outlier_samples",
    f"{_EVENT_FENCES} SELECT 'value' AS column_name, CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS position,"
    f" event_id AS row_event_id, {r('value')} AS value FROM events, f WHERE value < lo OR value > hi"
    " ORDER BY event_id LIMIT 10",
)
def outlier_samples(spark, sf_dir):
    return outliers.outlier_samples(EVENTS.profile(spark, sf_dir))


@query(
    "cap_outliers",
    f"{_EVENT_FENCES}, g AS {GAPS.sql}, q2 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM g)"
    f" SELECT event_id, {r('CASE WHEN value IS NOT NULL THEN greatest(least(value, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) END')}"
    " AS value FROM g, q2",
)
def cap_outliers(spark, sf_dir):
    capped = outliers.cap_outliers(GAPS.profile(spark, sf_dir), ["value"])
    return capped.select("event_id", rnd("value", 4).alias("value"))


@query(
    "box_stats",
    f"{_EVENTS_FACTS}, w AS ("
    + union(
        f"SELECT '{c}' AS column_name, min({c}) FILTER (WHERE {c} >= lo) AS wl, max({c}) FILTER (WHERE {c} <= hi) AS wh"
        f" FROM src, cols WHERE column_name = '{c}'"
        for c, _ in _EVENTS_NUMERIC
    )
    + f") SELECT column_name, {r('mn')} AS min, {r('wl')} AS whisker_low, {r('q1')} AS q1, {r('q2')} AS median, {r('q3')} AS q3,"
    f" {r('wh')} AS whisker_high, {r('mx')} AS max, {r('mean')} AS mean, outliers AS outlier_count FROM cols JOIN w USING (column_name)",
)
def box_stats(spark, sf_dir):
    return charts.box_stats(EVENTS.frame(spark, sf_dir))


_HIST = [("l_quantity", "float"), ("l_extendedprice", "float")]
HISTOGRAM = Source("lineitem", *[c for c, _ in _HIST])
_BINNED = (
    f"WITH {column_facts(HISTOGRAM.sql, _HIST)}, shape AS (SELECT column_name, mn, mx, n, iqr, CAST(least(200, greatest("
    "ceil(log2(n) + 1), CASE WHEN iqr > 0 THEN ceil((mx - mn) / (2.0 * iqr / pow(n, 1.0 / 3.0))) ELSE 1 END)) AS INTEGER) AS bins"
    " FROM cols), grid AS (SELECT column_name, mn, (mx - mn) / bins AS width, bins, unnest(range(bins)) AS b FROM shape),"
    " hits AS ("
    + union(
        f"SELECT '{c}' AS column_name, least(CAST(floor(({c} - mn) / ((mx - mn) / bins)) AS BIGINT), bins - 1) AS b, count(*) AS n"
        f" FROM src, shape WHERE column_name = '{c}' GROUP BY ALL"
        for c, _ in _HIST
    )
    + ")"
)


@query(
    "histogram_bins",
    f"{_BINNED} SELECT column_name, CAST(b AS INTEGER) AS bin, {r('mn + b * width')} AS bin_start, {r('(mn + b * width) + width')}"
    " AS bin_end, COALESCE(n, 0) AS count FROM grid LEFT JOIN hits USING (column_name, b)",
)
def histogram_bins(spark, sf_dir):
    return charts.histogram_bins(HISTOGRAM.frame(spark, sf_dir))


@query(
    "density_curve",
    f"{_BINNED}, pts AS (SELECT g.column_name, g.b, g.mn + (g.b + 0.5) * g.width AS x, c.std * pow(c.n, -0.2) AS h, c.n AS total"
    " FROM grid g JOIN cols c USING (column_name)) SELECT p.column_name, CAST(p.b AS INTEGER) AS bin,"
    f" {r('p.x')} AS x, {r('1e6 * sum(hits.n * exp(-0.5 * pow((p.x - q.x) / p.h, 2)) / (p.h * sqrt(2 * pi()))) / p.total')}"
    " AS density FROM pts p JOIN pts q USING (column_name) JOIN hits ON hits.column_name = q.column_name AND hits.b = q.b"
    " GROUP BY p.column_name, p.b, p.x, p.h, p.total",
)
def density_curve(spark, sf_dir):
    """Density in millionths, so that four decimals say something about prices."""
    curve = charts.density_curve(HISTOGRAM.frame(spark, sf_dir))
    return curve.withColumn("density", rnd("density * 1e6", 4))


@query("skewness_bars", f"{_EVENTS_FACTS} SELECT column_name, {r('skew', 3)} AS skewness FROM cols")
def skewness_bars(spark, sf_dir):
    return charts.skewness_bars(EVENTS.frame(spark, sf_dir))


@query(
    "scatter_fit",
    f"WITH src AS {PRICES.sql} SELECT 'l_extendedprice' AS column_a, 'owed' AS column_b, {r('corr(l_extendedprice, owed)')} AS correlation,"
    f" {r('regr_slope(owed, l_extendedprice)')} AS slope, {r('regr_intercept(owed, l_extendedprice)', 4)} AS intercept FROM src",
)
def scatter_fit(spark, sf_dir):
    return charts.scatter_fit(PRICES.profile(spark, sf_dir))


@query("scatter_sample", f"SELECT o, n, l_extendedprice, net, owed FROM {PRICES.sql}")
def scatter_sample(spark, sf_dir):
    return charts.scatter_sample(PRICES.profile(spark, sf_dir))


@query(
    "scatter3d_sample", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders"
)
def scatter3d_sample(spark, sf_dir):
    return charts.scatter3d_sample(ORDERS.profile(spark, sf_dir))


def _cells_sql(src: str, columns: list[str], halvings: int, most: int = 100) -> str:
    """Adaptive cells of complete, finite columns, level by level."""
    axes = range(len(columns))
    facts = ", ".join(f"min({c}) AS mn{i}, CAST(max({c}) - min({c}) AS DOUBLE) AS sp{i}" for i, c in enumerate(columns))
    fine = ", ".join(
        f"least(CAST(floor(({c} - mn{i}) / (sp{i} / {1 << halvings})) AS BIGINT), {(1 << halvings) - 1}) AS a{i}" for i, c in enumerate(columns)
    )
    keys = ", ".join(f"a{i}" for i in axes)
    up = ", ".join(f"a{i} >> ({halvings} - level) AS a{i}" for i in axes)
    parent = " AND ".join(f"c.a{i} >> 1 = s.a{i}" for i in axes)
    bounds = ", ".join(
        f"{r(f'mn{i} + c.a{i} * (sp{i} / pow(2.0, c.level))')} AS low_{i}, {r(f'mn{i} + (c.a{i} + 1) * (sp{i} / pow(2.0, c.level))')} AS high_{i}"
        for i in axes
    )
    titles = ", ".join(f"'{c}' AS column_{i}" for i, c in enumerate(columns))
    return (
        f"WITH src AS {src}, box AS (SELECT {facts} FROM src), fine AS (SELECT {fine}, count(*) AS n FROM src, box GROUP BY ALL),"
        f" lev AS (SELECT level, {up}, CAST(sum(n) AS BIGINT) AS n FROM fine, range({halvings + 1}) t(level) GROUP BY ALL)"
        f" SELECT {titles}, CAST(c.level AS INTEGER) AS level, {bounds}, c.n AS count FROM box, lev c"
        f" LEFT JOIN lev s ON s.level = c.level - 1 AND {parent}"
        f" WHERE (c.n <= {most} OR c.level = {halvings}) AND (c.level = 0 OR s.n > {most})"
    )


@query("scatter_cells", _cells_sql(PRICES.sql, ["l_extendedprice", "owed"], 8))
def scatter_cells(spark, sf_dir):
    return charts.scatter_cells(PRICES.profile(spark, sf_dir))


_NUMBERS_3D = Source("lineitem", "l_quantity", "l_extendedprice", "l_discount")


@query("scatter3d_cells", _cells_sql(_NUMBERS_3D.sql, list(_NUMBERS_3D.columns), 5))
def scatter3d_cells(spark, sf_dir):
    return charts.scatter3d_cells(_NUMBERS_3D.frame(spark, sf_dir))


@query(
    "numeric_profile_infinite",
    f"WITH src AS {INFINITE.sql}, b AS (SELECT CASE WHEN isinf(value) THEN NULL ELSE value END AS v, value FROM src)"
    f" SELECT 'value' AS column_name, count(value) AS count, {r('quantile_cont(value, 0.5)')} AS median, count(DISTINCT value) AS unique_count,"
    " count(*) FILTER (WHERE value < 0) AS negative_count FROM b",
)
def numeric_profile_infinite(spark, sf_dir):
    """Infinite values count as values: they are ranked, counted and distinct."""
    found = numeric.numeric_profile(INFINITE.frame(spark, sf_dir)).where("column_name = 'value'")
    return found.select("column_name", "count", "median", "unique_count", "negative_count")
