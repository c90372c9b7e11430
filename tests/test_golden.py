"""Values worked out by hand for small tables."""

import pytest

from plumbline import Profile
from plumbline.operators import (
    association,
    cardinality,
    duplicates,
    findings,
    missing,
    numeric,
    quality,
    semantics,
    temporal,
)
from tests.conftest import by_column


@pytest.fixture(scope="module")
def profile(staff):
    return Profile(staff)


def test_numeric_profile(profile):
    found = by_column(numeric.numeric_profile(profile))
    age, salary = found["Age"], found["Salary"]
    assert (age["count"], age["unique_count"], age["mean"], age["median"], age["mode"]) == (6, 5, 39.1667, 37.5, 25.0)
    assert (age["std"], age["variance"], age["q1"], age["q3"]) == (14.6344, 214.1667, 26.25, 48.75)
    assert (age["skewness"], age["kurtosis"], age["distribution"]) == (0.3882, -1.81, "Normal")
    assert (salary["std"], salary["variance"]) == (58309.5189, 3400000000.0)
    assert (salary["q1"], salary["q3"], salary["outlier_count"]) == (55000.0, 135000.0, 0)
    assert (salary["skewness"], salary["kurtosis"]) == (0.9321, -0.4637)
    assert salary["distribution"] == "Slightly Right Skewed"


def test_association(profile):
    related = {(r["column_name"], r["feature"]): r for r in association.feature_relationships(profile).collect()}
    assert related[("Age", "Salary")]["score"] == 0.9941
    assert related[("Department", "Age")]["score"] == 0.7511
    assert related[("Salary", "Department")]["score"] == 0.8006
    assert related[("Department", "HireDate")]["score"] == 1.0
    assert related[("Department", "HireDate")]["metric"] == "cramers_v"


def test_missing_and_duplicates(profile):
    total = missing.missing_totals(profile).first()
    assert (total["total_missing_cells"], total["total_cells"], total["overall_missing_percentage"]) == (1, 28, 3.57)
    assert by_column(missing.missing_by_column(profile))["Age"]["missing_percentage"] == 14.29
    copies = duplicates.duplicate_summary(profile).first()
    assert (copies["duplicate_rows"], copies["duplicate_percentage"], copies["assessment"]) == (1, 14.29, "contextual")


def test_semantics_and_cardinality(profile):
    kinds = {c: r["semantic_type"] for c, r in by_column(semantics.semantic_types(profile)).items()}
    assert kinds == {"Age": "Numerical", "Salary": "Numerical", "Department": "Categorical", "HireDate": "Categorical"}
    ratios = by_column(cardinality.categorical_profile(profile))
    assert ratios["HireDate"]["cardinality_ratio"] == 0.8571 and ratios["HireDate"]["is_high_cardinality"]
    assert ratios["Department"]["cardinality_ratio"] == 0.4286 and not ratios["Department"]["is_high_cardinality"]


def test_quality(profile):
    scores = {r["dimension"]: r["score"] for r in quality.quality_subscores(profile).collect()}
    assert scores == {
        "missing_values": 92.9, "duplicates": 78.6, "outliers": 100.0, "constant_columns": 100.0, "high_cardinality": 25.0,
        "invalid_values": 100.0,
    }
    assert quality.quality_score(profile).first()[0] == 85.0
    assert quality.quality_radar(profile).first()["overall"] == 94.3
    assert quality.ml_readiness(profile).first()["score"] == 75.4
    lost = {r["factor"]: r["deduction"] for r in quality.readiness_deductions(profile).collect()}
    assert lost == {"missing_values": 5.4, "duplicate_rows": 14.3, "multicollinearity": 2.5, "high_cardinality": 2.5}
    health = {c: r["column_health"] for c, r in by_column(quality.column_health(profile)).items()}
    assert health == {"Age": "Good", "Salary": "Good", "Department": "Excellent", "HireDate": "Good"}


def test_text_dates(profile):
    found = temporal.datetime_summary(profile).first()
    assert (found["format"], found["earliest_date"], found["latest_date"]) == ("YYYY-MM-DD", "2018-11-05", "2022-02-01")
    assert (found["total_days"], found["duration"]) == (1184, "3 Years 2 Months 29 Days")
    assert (found["duplicate_timestamps"], found["trend"]) == (1, "Increasing Trend")
    assert (found["most_active_year"], found["most_active_month"], found["most_active_weekday"]) == ("2020", "January", "Wednesday")


def test_findings_and_plan(profile):
    rules = {(r["rule_set"], r["rule_id"], r["column_name"]) for r in findings.findings(profile).collect()}
    assert ("recommendations", "impute_numeric", "Age") in rules
    assert ("recommendations", "dedupe", None) in rules
    assert ("insights", "datetime", "HireDate") in rules
    assert ("feature_suggestions", "log", "Salary") in rules
    assert ("feature_suggestions", "bin_age", "Age") in rules
    steps = [r["operation"] for r in findings.prep_plan(profile).orderBy("step").collect()]
    assert steps == ["dedupe_rows", "impute_median", "one_hot", "encode_high_cardinality", "standard_scale"]


def test_identifier_by_name(spark):
    rows = [("PAT-01", 25, 14.2, 250000), ("PAT-02", 30, 13.5, 210000), ("PAT-03", 45, 15.1, 300000)]
    df = spark.createDataFrame(rows, "Patient_ID string, Age int, Hemoglobin double, Platelets int")
    kinds = {c: r["semantic_type"] for c, r in by_column(semantics.semantic_types(df)).items()}
    assert kinds == {"Patient_ID": "Identifier", "Age": "Ordinal", "Hemoglobin": "Numerical", "Platelets": "Ordinal"}


def test_one_row(spark):
    p = Profile(spark.createDataFrame([(10, "Text")], "A int, B string"))
    found = numeric.numeric_profile(p).first()
    assert (found["std"], found["variance"], found["skewness"], found["kurtosis"]) == (0.0, 0.0, 0.0, 0.0)
    assert quality.quality_score(p).first()[0] <= 100.0


def test_one_column(spark):
    p = Profile(spark.createDataFrame([(i,) for i in range(1, 6)], "Value int"), order_by="Value")
    assert by_column(semantics.semantic_types(p))["Value"]["semantic_type"] == "Ordinal"
    assert association.pearson_matrix(p).count() == 0
    assert temporal.datetime_summary(p).count() == 0


def test_no_rows(spark):
    p = Profile(spark.createDataFrame([], "a int, b string, c timestamp"))
    assert missing.missing_totals(p).first()["overall_missing_percentage"] == 0.0
    assert numeric.numeric_profile(p).first()["note"] is not None
    assert quality.quality_score(p).first()[0] is not None
    assert duplicates.duplicate_summary(p).first()["duplicate_rows"] == 0
