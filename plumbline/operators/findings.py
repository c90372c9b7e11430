"""Rules over the profile, as rows instead of prose.

A rule is a condition on one row of the table facts, the column facts, the ranked pairs, the detected datetime columns
or the detected target, written in SQL over their columns. Result columns: ``rule_set, rule_id, column_name, severity,
metric, value, message``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rounding import percent
from plumbline.operators.association import rank_pairs
from plumbline.operators.quality import column_facts, quality_score, table_facts
from plumbline.operators.semantics import detect_target
from plumbline.operators.temporal import datetime_findings, detect_datetime
from plumbline.plans.small import pinned
from plumbline.profile import Profile, as_profile

SCHEMA = "rule_set string, rule_id string, column_name string, severity string, metric string, value double, message string"


@dataclass(frozen=True)
class Rule:
    """``when``, ``value`` and ``message`` are SQL; ``metric`` names the value; ``severity`` is SQL too."""

    rule_set: str
    rule_id: str
    when: str
    metric: str
    value: str
    message: str
    severity: str = "'info'"

    def sql(self, column: str) -> str:
        fields = {
            "rule_set": f"'{self.rule_set}'", "rule_id": f"'{self.rule_id}'", "column_name": f"string({column})",
            "severity": self.severity, "metric": f"'{self.metric}'", "value": f"double({self.value})",
            "message": self.message,
        }
        listed = ", ".join(f"'{k}', {v}" for k, v in fields.items())
        return f"if({self.when}, named_struct({listed}), NULL)"


_PROBLEM, _ACTION, _HIGH, _MEDIUM = "'problem'", "'action'", "'High'", "'Medium'"
_SCALE = "format_string('%d rows, %d columns', n_rows, n_columns)"
_MISSING = "format_string('%.2f %% of cells are missing (%d)', overall_missing_percentage, total_missing_cells)"
_REPEATED = "format_string('%d duplicate rows (%.2f %%)', duplicate_rows, duplicate_percentage)"
_REDUNDANT = "format_string('%d strongly correlated pairs', strong_pairs)"
_NO_GAPS, _NO_COPIES = "'no missing values'", "'no duplicate rows'"

TABLE_RULES = (
    Rule("observations", "scale", "true", "n_rows", "n_rows", _SCALE),
    Rule("observations", "complete", "total_missing_cells = 0", "missing_cells", "total_missing_cells", _NO_GAPS),
    Rule("observations", "missing", "total_missing_cells > 0", "missing_percentage", "overall_missing_percentage", _MISSING),
    Rule("observations", "no_duplicates", "duplicate_rows = 0", "duplicate_rows", "duplicate_rows", _NO_COPIES),
    Rule("observations", "duplicates", "duplicate_rows > 0", "duplicate_rows", "duplicate_rows", _REPEATED),
    Rule(
        "summary_findings", "overview", "true", "numeric_columns", "numeric_columns",
        "format_string('%d rows, %d columns: %d numeric, %d categorical', n_rows, n_columns, numeric_columns, object_columns)",
    ),
    Rule("summary_findings", "complete", "total_missing_cells = 0", "missing_cells", "total_missing_cells", _NO_GAPS),
    Rule(
        "summary_findings", "missing", "total_missing_cells > 0", "missing_percentage", "overall_missing_percentage",
        "format_string('%.2f %% of cells are missing in %d columns', overall_missing_percentage, columns_with_missing)",
    ),
    Rule("summary_findings", "duplicates", "duplicate_rows > 0", "duplicate_rows", "duplicate_rows", _REPEATED),
    Rule("summary_problems", "duplicates", "duplicate_rows > 0", "duplicate_rows", "duplicate_rows", _REPEATED, _PROBLEM),
    Rule("summary_problems", "redundant_features", "strong_pairs > 2", "strong_pairs", "strong_pairs", _REDUNDANT, _PROBLEM),
    Rule(
        "summary_problems", "none",
        "duplicate_rows = 0 AND constant_columns = 0 AND strong_pairs <= 2 AND empty_columns = 0",
        "problems", "0", "'no structural problems'",
    ),
    Rule("summary_cleaning", "dedupe", "duplicate_rows > 0", "duplicate_rows", "duplicate_rows", "'remove duplicate rows'", _ACTION),
    Rule(
        "summary_cleaning", "impute", "columns_with_missing > 0", "columns_with_missing", "columns_with_missing",
        "'fill numbers with the median and categories with the mode'", _ACTION,
    ),
    Rule(
        "summary_cleaning", "health", "true", "quality_score", "quality_score",
        "format_string('quality score %.1f of 100', quality_score)",
    ),
    Rule(
        "recommendations", "dedupe", "duplicate_rows > 0", "duplicate_percentage", "duplicate_percentage", _REPEATED,
        "if(duplicate_percentage > 5, 'High', 'Medium')",
    ),
    Rule("insights", "scale", "true", "n_rows", "n_rows", _SCALE),
    Rule(
        "insights", "quality_excellent", "quality_score >= 90", "quality_score", "quality_score",
        "format_string('quality is excellent (%.1f)', quality_score)",
    ),
    Rule(
        "insights", "quality_moderate", "quality_score >= 70 AND quality_score < 90", "quality_score", "quality_score",
        "format_string('quality is moderate (%.1f)', quality_score)",
    ),
    Rule(
        "insights", "quality_low", "quality_score < 70", "quality_score", "quality_score",
        "format_string('quality is low (%.1f)', quality_score)",
    ),
    Rule("insights", "complete", "total_missing_cells = 0", "missing_cells", "total_missing_cells", _NO_GAPS),
    Rule("insights", "missing", "total_missing_cells > 0", "missing_percentage", "overall_missing_percentage", _MISSING),
    Rule("insights", "no_duplicates", "duplicate_rows = 0", "duplicate_rows", "duplicate_rows", _NO_COPIES),
    Rule("insights", "duplicates", "duplicate_rows > 0", "duplicate_percentage", "duplicate_percentage", _REPEATED),
    Rule("insights", "no_outliers", "notable_outliers = 0", "outliers", "notable_outliers", "'no notable outliers'"),
    Rule("insights", "multicollinearity", "strong_pairs > 3", "strong_pairs", "strong_pairs", _REDUNDANT),
)

_IS_NUMBER = "family IN ('int', 'float')"
_IS_CATEGORY = "is_high_cardinality IS NOT NULL"
_UPPER = "format_string('long upper tail (skewness %.2f)', skewness)"
_LOWER = "format_string('long lower tail (skewness %.2f)', skewness)"
_AROUND = "format_string('roughly symmetric around %.2f', mean)"
_TOP = "format_string('most frequent: %s (%.2f %%)', mode_text, top_percentage)"
_MONEY = " OR ".join(f"lower(column_name) LIKE '%{w}%'" for w in ("salary", "income", "price", "amount"))

COLUMN_RULES = (
    Rule("observations", "identifier", "ignored", "unique_count", "unique_count", "'identifier, left out of analyses'"),
    Rule("observations", "symmetric", "distribution = 'Normal'", "skewness", "skewness", _AROUND),
    Rule("observations", "right_skewed", "distribution LIKE '%Right%'", "skewness", "skewness", _UPPER),
    Rule("observations", "left_skewed", "distribution LIKE '%Left%'", "skewness", "skewness", _LOWER),
    Rule(
        "observations", "outliers", "outlier_count > 0", "outlier_percentage", "outlier_percentage",
        "format_string('%d outliers (%.2f %%)', outlier_count, outlier_percentage)",
    ),
    Rule("observations", "top_category", f"{_IS_CATEGORY} AND unique_count > 0", "top_percentage", "top_percentage", _TOP),
    Rule("summary_problems", "constant", "unique_count <= 1", "unique_count", "unique_count", "'constant column'", _PROBLEM),
    Rule("summary_problems", "empty", "missing_percentage = 100", "missing_percentage", "missing_percentage", "'empty column'", _PROBLEM),
    Rule("summary_cleaning", "drop_constant", "unique_count <= 1", "unique_count", "unique_count", "'drop the constant column'", _ACTION),
    Rule("recommendations", "drop_empty", "missing_percentage = 100", "missing_percentage", "missing_percentage", "'drop the empty column'", _HIGH),
    Rule(
        "recommendations", "impute_numeric", f"{_IS_NUMBER} AND missing_percentage > 0 AND missing_percentage < 100",
        "missing_percentage", "missing_percentage", "'fill missing numbers with the median'", _MEDIUM,
    ),
    Rule("recommendations", "drop_constant", "unique_count <= 1", "unique_count", "unique_count", "'drop the constant column'", _HIGH),
    Rule("recommendations", "one_hot", "NOT is_high_cardinality", "cardinality_ratio", "cardinality_ratio", "'encode as indicators'", _MEDIUM),
    Rule(
        "recommendations", "encode_high_cardinality", "is_high_cardinality", "cardinality_ratio", "cardinality_ratio",
        "'encode by target or frequency'", _HIGH,
    ),
    Rule("recommendations", "log_transform", "abs(skewness) > 1", "skewness", "skewness", "'take logarithms'", _MEDIUM),
    Rule("recommendations", "standardize", _IS_NUMBER, "non_null", "non_null", "'scale to zero mean and unit variance'", _MEDIUM),
    Rule(
        "recommendations", "cap_outliers", "outlier_count > 0 AND outlier_percentage >= 1", "outlier_percentage",
        "outlier_percentage", "'cap at the fences'", _MEDIUM,
    ),
    Rule(
        "insights", "worst_missing", "is_worst AND missing_percentage > 0", "missing_percentage", "missing_percentage",
        "format_string('most missing values (%.2f %%)', missing_percentage)",
    ),
    Rule("insights", "right_skewed", "skewness > 1", "skewness", "skewness", _UPPER),
    Rule("insights", "left_skewed", "skewness < -1", "skewness", "skewness", _LOWER),
    Rule("insights", "symmetric", "distribution = 'Normal' AND abs(skewness) <= 1", "skewness", "skewness", _AROUND),
    Rule("insights", "heavy_tails", "kurtosis > 3", "kurtosis", "kurtosis", "format_string('heavy tails (kurtosis %.2f)', kurtosis)"),
    Rule(
        "insights", "outliers", "outlier_count > 0 AND outlier_percentage >= 0.5", "outlier_percentage", "outlier_percentage",
        "format_string('%d outliers outside [%.4f, %.4f]', outlier_count, lower_bound, upper_bound)",
    ),
    Rule("insights", "dominant_category", f"{_IS_CATEGORY} AND unique_count > 0", "top_percentage", "top_percentage", _TOP),
    Rule(
        "insights", "high_cardinality", "is_high_cardinality", "cardinality_ratio", "cardinality_ratio",
        "format_string('%d distinct values', unique_count)",
    ),
    Rule("insights", "constant", "unique_count <= 1", "unique_count", "unique_count", "'constant column'"),
    Rule("feature_suggestions", "bin_age", f"{_IS_NUMBER} AND lower(column_name) LIKE '%age%'", "skewness", "skewness", "'age bands'"),
    Rule("feature_suggestions", "log", f"distribution IS NOT NULL AND (skewness > 1 OR {_MONEY})", "skewness", "skewness", "'logarithm'"),
    Rule("feature_suggestions", "bin_bmi", "distribution IS NOT NULL AND lower(column_name) LIKE '%bmi%'", "skewness", "skewness", "'BMI bands'"),
)

_PAIR = "concat_ws(' / ', column_a, column_b)"
_PAIR_TEXT = f"format_string('%s (r = %.4f)', {_PAIR}, correlation)"
_FIRST_POSITIVE = "bucket = 'strong_positive' AND bucket_rank = 1"
_FIRST_NEGATIVE = "bucket = 'strong_negative' AND bucket_rank = 1"

PAIR_RULES = (
    Rule("observations", "strong_positive", _FIRST_POSITIVE, "correlation", "correlation", _PAIR_TEXT),
    Rule("observations", "strong_negative", _FIRST_NEGATIVE, "correlation", "correlation", _PAIR_TEXT),
    Rule("summary_findings", "strongest_pair", "strong_rank = 1", "correlation", "correlation", _PAIR_TEXT),
    Rule("insights", "strong_positive", _FIRST_POSITIVE, "correlation", "correlation", _PAIR_TEXT),
    Rule("insights", "strong_negative", _FIRST_NEGATIVE, "correlation", "correlation", _PAIR_TEXT),
    Rule("feature_suggestions", "ratio", "turn <= 3", "correlation", "correlation", f"concat('ratio ', {_PAIR})"),
)

DATETIME_RULES = (
    Rule("insights", "datetime", "detected", "parse_success", "parse_success", "'datetime column'"),
    Rule(
        "feature_suggestions", "date_parts", "detected", "parse_success", "parse_success",
        "'year, month, weekday and weekend flag'",
    ),
)

TARGET_RULES = (Rule("insights", "target", "true", "target", "1", "concat('likely target: ', task_type)"),)


def _table(p: Profile) -> DataFrame:
    return table_facts(p).withColumn("quality_score", F.lit(quality_score(p).first()[0]))


def _columns(p: Profile) -> DataFrame:
    worst = F.row_number().over(Window.orderBy(F.desc("missing_percentage"), "ordinal")) == 1  # one row per column
    return column_facts(p).withColumns({"is_worst": worst, "top_percentage": percent("mode_n", "n_rows")})


def _strong_pairs(p: Profile) -> DataFrame:
    in_turn = F.row_number().over(Window.orderBy(F.desc("bucket"), "bucket_rank"))  # positives first
    return rank_pairs(p).where("bucket LIKE 'strong%'").withColumn("turn", in_turn)


# Rules, the facts they read, and the SQL of the column they speak about.
SOURCES = (
    (TABLE_RULES, _table, "NULL"),
    (COLUMN_RULES, _columns, "column_name"),
    (PAIR_RULES, _strong_pairs, _PAIR),
    (DATETIME_RULES, detect_datetime, "column_name"),
    (TARGET_RULES, detect_target, "target_column"),
)


def findings(table: DataFrame | Profile, rule_set: str | None = None) -> DataFrame:
    """Findings of one rule set, or of all of them and of the datetime columns. Only the rules asked for are run."""
    p = as_profile(table)
    cache = p.__dict__.setdefault("findings_cache", {})
    if rule_set not in cache:
        cache[rule_set] = pinned(_all(p, rule_set))
    return cache[rule_set]


def _all(p: Profile, rule_set: str | None) -> DataFrame:
    parts = []
    for rules, facts, column in SOURCES:
        wanted = ", ".join(r.sql(column) for r in rules if rule_set in (None, r.rule_set))
        if wanted:
            parts.append(facts(p).selectExpr(f"inline(filter(array({wanted}), r -> r IS NOT NULL))"))
    if rule_set in (None, "datetime") and not detect_datetime(p).where("detected").isEmpty():
        parts.append(datetime_findings(p))
    return reduce(DataFrame.unionByName, parts) if parts else p.spark.createDataFrame([], SCHEMA)


def prep_plan(table: DataFrame | Profile) -> DataFrame:
    """Ordered preparation steps with the columns each one takes; a step without columns is left out."""
    p = as_profile(table)
    steps = {
        "drop_identifiers": "ignored",
        "drop_constants": "unique_count <= 1",
        "dedupe_rows": None,
        "impute_median": f"{_IS_NUMBER} AND missing_count > 0",
        "impute_mode": f"{_IS_CATEGORY} AND missing_count > 0",
        "one_hot": "NOT is_high_cardinality AND NOT ignored",
        "encode_high_cardinality": "is_high_cardinality AND NOT ignored",
        "log1p": "abs(skewness) > 1 AND NOT ignored",
        "standard_scale": f"{_IS_NUMBER} AND NOT ignored",
    }
    place = {name: i for i, name in enumerate(steps)}
    chosen = ", ".join(
        f"if({when}, named_struct('place', {place[name]}, 'operation', '{name}'), NULL)" for name, when in steps.items() if when
    )
    per_column = column_facts(p).selectExpr("ordinal", "column_name", f"inline(filter(array({chosen}), s -> s IS NOT NULL))")
    members = F.sort_array(F.collect_list(F.struct("ordinal", "column_name")))
    listed = per_column.groupBy("place", "operation").agg(members.alias("members"))
    listed = listed.select("place", "operation", F.array_join(F.col("members.column_name"), ", ").alias("columns"))
    dedupe = table_facts(p).where("duplicate_rows > 0").selectExpr(
        f"{place['dedupe_rows']} AS place", "'dedupe_rows' AS operation", "'' AS columns"
    )
    both = listed.unionByName(dedupe)
    return both.select(F.row_number().over(Window.orderBy("place")).alias("step"), "operation", "columns")
