"""Scores, ratings, findings and the whole report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import EVENTS, GAPS, MIXED, ORDERS, Source, query
from catalog.sql import EVENTS as EVENTS_COLUMNS
from catalog.sql import GAPS as GAPS_COLUMNS
from catalog.sql import MIXED as MIXED_COLUMNS
from catalog.sql import ORDERS as ORDERS_COLUMNS
from catalog.sql import column_facts, pct, r, shape_label, share, union
from plumbline import report
from plumbline.functions.rounding import rnd
from plumbline.operators import findings, quality

_CORR = "CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _tables(source: Source, columns: list[tuple[str, str]], identifiers: tuple[str, ...] = ()) -> str:
    """CTEs with rounded facts per column (``f``), per numeric pair (``pairs``) and per table (``t``)."""
    names = ", ".join(c for c, _ in columns)
    numeric = [c for c, family in columns if family in ("int", "float") and c not in identifiers]
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    correlations = union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(_CORR.format(a=a, b=b))} AS correlation FROM src" for a, b in pairs
    ) or "SELECT '' AS column_a, '' AS column_b, NULL::DOUBLE AS correlation"
    listed = ", ".join(f"'{c}'" for c in identifiers) or "''"
    is_number = "family IN ('int', 'float')"
    extra = (
        f"f AS (SELECT *, {pct('nulls', 'n_rows')} AS missing_pct, CASE WHEN {is_number} THEN {pct('outliers', 'n')} ELSE 0 END AS outlier_pct,"
        f" {r(share('ndv', 'n_rows'))} AS ratio, CASE WHEN {is_number} AND n > 0 THEN {r('skew')} END AS skew4,"
        f" CASE WHEN {is_number} AND n > 0 THEN {r('kurt')} END AS kurt4, CASE WHEN {is_number} AND n > 0 THEN {shape_label('skew')} END AS dist,"
        f" CASE WHEN ndv > 1 THEN {r('iqr')} ELSE 0 END AS iqr4, column_name IN ({listed}) AS ignored, {pct('mode_n', 'n_rows')} AS top_pct,"
        f" {is_number} AS is_number, family = 'string' AS is_category FROM cols),"
        f" pairs AS ({correlations}),"
        f" t AS (SELECT max(n_rows) AS n_rows, count(*) AS n_columns, CAST(sum(nulls) AS DOUBLE) AS missing, {pct('sum(nulls)', 'sum(n_rows)')} AS missing_pct,"
        f" count(*) FILTER (WHERE nulls > 0) AS gappy, count(*) FILTER (WHERE missing_pct = 100) AS empty, sum(outliers) AS outliers,"
        " count(*) FILTER (WHERE is_number AND iqr4 <> 0) AS spread, count(*) FILTER (WHERE outliers > 0 AND outlier_pct >= 1) AS outlier_columns,"
        " COALESCE(sum(outliers) FILTER (WHERE outlier_pct >= 0.5), 0) AS notable, COALESCE(sum(outliers) FILTER (WHERE iqr > 0), 0) AS spread_outliers,"
        " count(*) FILTER (WHERE ndv <= 1) AS constants, count(*) FILTER (WHERE is_category) AS categories,"
        " count(*) FILTER (WHERE is_category AND ratio > 0.5) AS high, count(*) FILTER (WHERE abs(skew4) > 1) AS skewed,"
        " count(*) FILTER (WHERE is_number) AS numbers,"
        " (SELECT count(*) FROM pairs WHERE abs(correlation) >= 0.7) AS strong,"
        f" max(n_rows) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM src)) AS dups FROM f),"
        f" u AS (SELECT *, {pct('dups', 'n_rows')} AS dup_pct FROM t),"
        " s AS (SELECT *, greatest(0, 100 - missing_pct * 2) AS s1, greatest(0, 100 - dup_pct * 1.5) AS s2,"
        f" greatest(0, 100 - {share('outliers', 'spread * n_rows')} * 100 * 3) AS s3,"
        f" greatest(0, 100 - {share('constants', 'n_columns')} * 100 * 2) AS s4, greatest(0, 100 - {share('high', 'categories')} * 100 * 1.5) AS s5,"
        " 100.0::DOUBLE AS s6 FROM u),"
        f" q AS (SELECT *, {r('s1 * 0.30 + s2 * 0.25 + s3 * 0.15 + s4 * 0.15 + s5 * 0.10 + s6 * 0.05', 1)} AS score FROM s)"
    )
    return f"WITH {column_facts(source.sql, columns, extra)}"


_MIXED = _tables(MIXED, MIXED_COLUMNS)
_GAPS = _tables(GAPS, GAPS_COLUMNS, ("event_id", "user_id"))
_ORDERS = _tables(ORDERS, ORDERS_COLUMNS, ("o_orderkey",))
_EVENTS = _tables(EVENTS, EVENTS_COLUMNS, ("event_id", "user_id"))

_SCORES = (
    ("missing_values", "s1", 0.30), ("duplicates", "s2", 0.25), ("outliers", "s3", 0.15), ("constant_columns", "s4", 0.15),
    ("high_cardinality", "s5", 0.10), ("invalid_values", "s6", 0.05),
)


def _subscores(facts: str) -> str:
    return f"{facts} " + union(
        f"SELECT '{k}' AS dimension, {r(s, 1)} AS score, {w}::DOUBLE AS weight FROM q" for k, s, w in _SCORES
    )


@query("quality_subscores", _subscores(_MIXED))
def quality_subscores(spark, sf_dir):
    return quality.quality_subscores(MIXED.frame(spark, sf_dir))


@query("quality_subscores_gaps", _subscores(_GAPS))
def quality_subscores_gaps(spark, sf_dir):
    return quality.quality_subscores(GAPS.profile(spark, sf_dir))


@query("quality_score", f"{_MIXED} SELECT score AS quality_score FROM q")
def quality_score(spark, sf_dir):
    return quality.quality_score(MIXED.frame(spark, sf_dir))


@query("quality_score_orders", f"{_ORDERS} SELECT score AS quality_score FROM q")
def quality_score_orders(spark, sf_dir):
    return quality.quality_score(ORDERS.profile(spark, sf_dir))


def _health(bad: str, whole: str) -> str:
    return f"greatest(0, least(100, {r(f'(1 - CAST({bad} AS DOUBLE) / {whole}) * 100', 1)}))"


@query(
    "quality_radar",
    f"{_MIXED}, a AS (SELECT {_health('missing', '(n_rows * n_columns)')} AS completeness, {_health('dups', 'n_rows')} AS uniqueness,"
    f" {_health('spread_outliers', '(n_rows * n_columns)')} AS outlier_health, 100.0::DOUBLE AS validity FROM q)"
    f" SELECT *, {r('completeness * 0.4 + uniqueness * 0.3 + outlier_health * 0.3', 1)} AS overall FROM a",
)
def quality_radar(spark, sf_dir):
    return quality.quality_radar(MIXED.frame(spark, sf_dir))


_DECLARED = {
    "visitor": "bigint", "event_type": "string", "bucket": "double", "price": "double", "k": "int", "event_id": "bigint",
    "ts": "timestamp_ntz", "user_id": "bigint", "value": "double", "nothing": "double",
}


def _column_health(facts: str, columns) -> str:
    declared = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{_DECLARED[c]}'" for c, _ in columns) + " END"
    return (
        f"{facts} SELECT column_name, {declared} AS data_type, nulls AS missing_count, f.missing_pct AS missing_percentage,"
        " CASE WHEN is_number THEN f.outliers ELSE 0 END AS outlier_count, CAST(outlier_pct AS DOUBLE) AS outlier_percentage,"
        " COALESCE(dist, 'Categorical') AS distribution, ndv AS unique_count, ratio AS unique_ratio,"
        " CASE WHEN ignored THEN 'Good' WHEN f.missing_pct > 15 OR outlier_pct > 5 OR ndv <= 1 THEN 'Needs Attention'"
        " WHEN f.missing_pct > 0 OR f.outliers > 0 OR ratio > 0.5 THEN 'Good' ELSE 'Excellent' END AS column_health,"
        " CASE WHEN ignored THEN '' ELSE concat_ws(', ', CASE WHEN f.missing_pct > 15 THEN 'missing values' END, CASE WHEN outlier_pct > 5"
        " THEN 'outliers' END, CASE WHEN ndv <= 1 THEN 'constant' END) END AS reasons,"
        " CASE WHEN q.dups > 0 AND NOT ignored THEN 'High' ELSE 'Low' END AS duplicate_impact FROM f, q"
    )


@query("column_health", _column_health(_MIXED, MIXED_COLUMNS))
def column_health(spark, sf_dir):
    return quality.column_health(MIXED.frame(spark, sf_dir))


@query("column_health_gaps", _column_health(_GAPS, GAPS_COLUMNS))
def column_health_gaps(spark, sf_dir):
    return quality.column_health(GAPS.profile(spark, sf_dir))


_PENALTIES = (
    ("missing_values", "missing_pct", 1.5, 35), ("duplicate_rows", "dup_pct", 1.0, 25), ("multicollinearity", "strong", 2.5, 15),
    ("outliers", "outlier_columns", 3.0, 15), ("skewed_features", "skewed", 2.0, 10), ("constant_columns", "constants", 5.0, 15),
    ("high_cardinality", "high", 2.5, 10),
)


@query(
    "ml_readiness",
    f"{_MIXED}, m AS (SELECT {r('greatest(0, 100 - ' + ' - '.join(f'least({cap}, {c} * {k}::DOUBLE)' for _, c, k, cap in _PENALTIES) + ')', 1)}"
    " AS score FROM q) SELECT score, CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Moderate'"
    " ELSE 'Poor' END AS status FROM m",
)
def ml_readiness(spark, sf_dir):
    return quality.ml_readiness(MIXED.frame(spark, sf_dir))


@query(
    "readiness_deductions",
    f"{_MIXED} "
    + union(
        f"SELECT '{name}' AS factor, CAST({c} AS DOUBLE) AS amount, {r(f'least({cap}, {c} * {k}::DOUBLE)', 1)} AS deduction FROM q WHERE {c} > 0"
        for name, c, k, cap in _PENALTIES
    ),
)
def readiness_deductions(spark, sf_dir):
    return quality.readiness_deductions(MIXED.frame(spark, sf_dir))


# ---- findings: everything but the wording ----


def _rules(facts: str, rules: list[tuple[str, str, str, str, str, str]]) -> str:
    """(rule, table, column name or NULL, condition, severity, value) as rows."""
    return f"{facts} " + union(
        f"SELECT '{rule}' AS rule_id, {column} AS column_name, {severity} AS severity, {r(value, 2)} AS value FROM {table} WHERE {when}"
        for rule, table, column, when, severity, value in rules
    )


def _fired(source: Source, rule_set: str):
    def run(spark, sf_dir) -> DataFrame:
        found = findings.findings(source.profile(spark, sf_dir), rule_set)
        return found.select("rule_id", "column_name", "severity", rnd("value", 2).alias("value"))

    return run


_INFO, _PROBLEM, _ACTION = "'info'", "'problem'", "'action'"
_PAIR = "column_a || ' / ' || column_b"
_TOP_POSITIVE = "correlation = (SELECT max(correlation) FROM pairs WHERE correlation >= 0.7)"
_TOP_NEGATIVE = "correlation = (SELECT min(correlation) FROM pairs WHERE correlation <= -0.7)"
_TOP_ANY = "abs(correlation) = (SELECT max(abs(correlation)) FROM pairs WHERE abs(correlation) >= 0.7)"
_MONEY = "(" + " OR ".join(f"lower(column_name) LIKE '%{w}%'" for w in ("salary", "income", "price", "amount")) + ")"


def _register_findings(suffix: str, source: Source, facts: str, datetimes: dict[str, str], target: str | None) -> None:
    def rules(rule_set: str, rows: list) -> None:
        query(rule_set + suffix, _rules(facts, rows))(_fired(source, rule_set))

    rules("observations", [
        ("scale", "q", "NULL", "true", _INFO, "n_rows"),
        ("complete", "q", "NULL", "missing = 0", _INFO, "missing"),
        ("missing", "q", "NULL", "missing > 0", _INFO, "missing_pct"),
        ("no_duplicates", "q", "NULL", "dups = 0", _INFO, "dups"),
        ("duplicates", "q", "NULL", "dups > 0", _INFO, "dups"),
        ("identifier", "f", "column_name", "ignored", _INFO, "ndv"),
        ("symmetric", "f", "column_name", "dist = 'Normal'", _INFO, "skew4"),
        ("right_skewed", "f", "column_name", "dist LIKE '%Right%'", _INFO, "skew4"),
        ("left_skewed", "f", "column_name", "dist LIKE '%Left%'", _INFO, "skew4"),
        ("outliers", "f", "column_name", "is_number AND outliers > 0", _INFO, "outlier_pct"),
        ("top_category", "f", "column_name", "is_category AND ndv > 0", _INFO, "top_pct"),
        ("strong_positive", "pairs", _PAIR, _TOP_POSITIVE, _INFO, "correlation"),
        ("strong_negative", "pairs", _PAIR, _TOP_NEGATIVE, _INFO, "correlation"),
    ])
    rules("summary_findings", [
        ("overview", "q", "NULL", "true", _INFO, "numbers"),
        ("complete", "q", "NULL", "missing = 0", _INFO, "missing"),
        ("missing", "q", "NULL", "missing > 0", _INFO, "missing_pct"),
        ("duplicates", "q", "NULL", "dups > 0", _INFO, "dups"),
        ("strongest_pair", "pairs", _PAIR, _TOP_ANY, _INFO, "correlation"),
    ])
    rules("summary_problems", [
        ("duplicates", "q", "NULL", "dups > 0", _PROBLEM, "dups"),
        ("constant", "f", "column_name", "ndv <= 1", _PROBLEM, "ndv"),
        ("redundant_features", "q", "NULL", "strong > 2", _PROBLEM, "strong"),
        ("empty", "f", "column_name", "missing_pct = 100", _PROBLEM, "missing_pct"),
        ("none", "q", "NULL", "dups = 0 AND constants = 0 AND strong <= 2 AND empty = 0", _INFO, "0"),
    ])
    rules("summary_cleaning", [
        ("dedupe", "q", "NULL", "dups > 0", _ACTION, "dups"),
        ("impute", "q", "NULL", "gappy > 0", _ACTION, "gappy"),
        ("drop_constant", "f", "column_name", "ndv <= 1", _ACTION, "ndv"),
        ("health", "q", "NULL", "true", _INFO, "score"),
    ])
    rules("recommendations", [
        ("dedupe", "q", "NULL", "dups > 0", "CASE WHEN dup_pct > 5 THEN 'High' ELSE 'Medium' END", "dup_pct"),
        ("drop_empty", "f", "column_name", "missing_pct = 100", "'High'", "missing_pct"),
        ("impute_numeric", "f", "column_name", "is_number AND missing_pct > 0 AND missing_pct < 100", "'Medium'", "missing_pct"),
        ("drop_constant", "f", "column_name", "ndv <= 1", "'High'", "ndv"),
        ("one_hot", "f", "column_name", "is_category AND ratio <= 0.5", "'Medium'", "ratio"),
        ("encode_high_cardinality", "f", "column_name", "is_category AND ratio > 0.5", "'High'", "ratio"),
        ("log_transform", "f", "column_name", "abs(skew4) > 1", "'Medium'", "skew4"),
        ("standardize", "f", "column_name", "is_number", "'Medium'", "n"),
        ("cap_outliers", "f", "column_name", "is_number AND outliers > 0 AND outlier_pct >= 1", "'Medium'", "outlier_pct"),
    ])
    rules("insights", [
        ("scale", "q", "NULL", "true", _INFO, "n_rows"),
        ("quality_excellent", "q", "NULL", "score >= 90", _INFO, "score"),
        ("quality_moderate", "q", "NULL", "score >= 70 AND score < 90", _INFO, "score"),
        ("quality_low", "q", "NULL", "score < 70", _INFO, "score"),
        ("complete", "q", "NULL", "missing = 0", _INFO, "missing"),
        ("missing", "q", "NULL", "missing > 0", _INFO, "missing_pct"),
        ("worst_missing", "f", "column_name", "missing_pct > 0 AND ordinal = (SELECT ordinal FROM f ORDER BY missing_pct DESC, ordinal LIMIT 1)", _INFO, "missing_pct"),
        ("no_duplicates", "q", "NULL", "dups = 0", _INFO, "dups"),
        ("duplicates", "q", "NULL", "dups > 0", _INFO, "dup_pct"),
        ("right_skewed", "f", "column_name", "skew4 > 1", _INFO, "skew4"),
        ("left_skewed", "f", "column_name", "skew4 < -1", _INFO, "skew4"),
        ("symmetric", "f", "column_name", "dist = 'Normal' AND abs(skew4) <= 1", _INFO, "skew4"),
        ("heavy_tails", "f", "column_name", "kurt4 > 3", _INFO, "kurt4"),
        ("outliers", "f", "column_name", "is_number AND outliers > 0 AND outlier_pct >= 0.5", _INFO, "outlier_pct"),
        ("no_outliers", "q", "NULL", "notable = 0", _INFO, "notable"),
        ("dominant_category", "f", "column_name", "is_category AND ndv > 0", _INFO, "top_pct"),
        ("high_cardinality", "f", "column_name", "is_category AND ratio > 0.5", _INFO, "ratio"),
        ("strong_positive", "pairs", _PAIR, _TOP_POSITIVE, _INFO, "correlation"),
        ("strong_negative", "pairs", _PAIR, _TOP_NEGATIVE, _INFO, "correlation"),
        ("multicollinearity", "q", "NULL", "strong > 3", _INFO, "strong"),
        ("constant", "f", "column_name", "ndv <= 1", _INFO, "ndv"),
        *[("datetime", "q", f"'{c}'", "true", _INFO, f"(SELECT {share(f'count({c})', 'count(*)')} * 100 FROM src)") for c in datetimes],
        *([("target", "q", f"'{target}'", "true", _INFO, "1")] if target else []),
    ])
    rules("feature_suggestions", [
        ("bin_age", "f", "column_name", "is_number AND lower(column_name) LIKE '%age%'", _INFO, "skew4"),
        ("log", "f", "column_name", f"dist IS NOT NULL AND ({_MONEY} OR skew4 > 1)", _INFO, "skew4"),
        ("bin_bmi", "f", "column_name", "dist IS NOT NULL AND lower(column_name) LIKE '%bmi%'", _INFO, "skew4"),
        ("ratio", "pairs", _PAIR, "abs(correlation) >= 0.7", _INFO, "correlation"),
        *[("date_parts", "q", f"'{c}'", "true", _INFO, f"(SELECT {share(f'count({c})', 'count(*)')} * 100 FROM src)") for c in datetimes],
    ])


_register_findings("", MIXED, _MIXED, {}, "price")
_register_findings("_orders", ORDERS, _ORDERS, {"o_orderdate": "native"}, "o_orderstatus")
_register_findings("_gaps", GAPS, _GAPS, {"ts": "native"}, None)


def _plan(facts: str) -> str:
    steps = (
        ("drop_identifiers", "ignored"), ("drop_constants", "ndv <= 1"), ("dedupe_rows", None),
        ("impute_median", "is_number AND nulls > 0"), ("impute_mode", "is_category AND nulls > 0"),
        ("one_hot", "is_category AND ratio <= 0.5 AND NOT ignored"), ("encode_high_cardinality", "is_category AND ratio > 0.5 AND NOT ignored"),
        ("log1p", "abs(skew4) > 1 AND NOT ignored"), ("standard_scale", "is_number AND NOT ignored"),
    )
    rows = [
        f"SELECT {i} AS place, 'dedupe_rows' AS operation, '' AS columns FROM q WHERE dups > 0"
        if when is None
        else f"SELECT {i}, '{name}', string_agg(column_name, ', ' ORDER BY ordinal) AS members FROM f WHERE {when} HAVING count(*) > 0"
        for i, (name, when) in enumerate(steps)
    ]
    named = union([rows[2], *rows[:2], *rows[3:]])
    return f"{facts} SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS step, operation, columns FROM ({named})"


@query("prep_plan", _plan(_MIXED))
def prep_plan(spark, sf_dir):
    return findings.prep_plan(MIXED.frame(spark, sf_dir))


@query("prep_plan_gaps", _plan(_GAPS))
def prep_plan_gaps(spark, sf_dir):
    return findings.prep_plan(GAPS.profile(spark, sf_dir))


@query("full_profile")
def full_profile(spark, sf_dir):
    """Every section, each row as JSON."""
    sections = report.full_profile(EVENTS.profile(spark, sf_dir))
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, parts)
