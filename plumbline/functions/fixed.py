"""Fixed values of the profile's definition: names, patterns and thresholds that results depend on."""

import re

# ---- fixed values -------------------------------------------------------------------------------------------

# Column names that mark an identifier.
ID_NAME = re.compile(
    r"(^|_)id$|^id(_|$)|uuid|guid|serial|patient_id|emp_id|employee_id|user_id|account_id|row_id",
    re.IGNORECASE,
)

# Parts of a column name that mark a likely target.
TARGET_KEYWORDS = (
    "target",
    "label",
    "class",
    "survived",
    "purchased",
    "price",
    "outcome",
    "churn",
    "status",
    "default",
)

# Values of a two-valued column that make it Boolean rather than Binary.
BOOLEAN_TOKENS = ("0", "1", "true", "false", "True", "False")

# Text that a CSV cell may hold in place of a value.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

HIGH_CARDINALITY_RATIO = 0.5
TOP_CATEGORIES = 10
STRONG, MODERATE, WEAK = 0.7, 0.4, 0.2

# Lowest absolute score per strength label; anything lower is "Very Weak".
PEARSON_STRENGTH = (("Very Strong", 0.85), ("Strong", 0.70), ("Moderate", 0.40), ("Weak", 0.20))
OTHER_STRENGTH = (("Very Strong", 0.50), ("Strong", 0.35), ("Moderate", 0.20), ("Weak", 0.10))

# Points lost per percent, and share of the total score.
QUALITY_SLOPE = {
    "missing_values": 2.0,
    "duplicates": 1.5,
    "outliers": 3.0,
    "constant_columns": 2.0,
    "high_cardinality": 1.5,
    "invalid_values": 5.0,
}
QUALITY_WEIGHT = {
    "missing_values": 0.30,
    "duplicates": 0.25,
    "outliers": 0.15,
    "constant_columns": 0.15,
    "high_cardinality": 0.10,
    "invalid_values": 0.05,
}

# Readiness penalties: points per unit, and most points that factor can cost.
READINESS_PENALTY = {
    "missing_values": (1.5, 35.0),
    "duplicate_rows": (1.0, 25.0),
    "multicollinearity": (2.5, 15.0),
    "outliers": (3.0, 15.0),
    "skewed_features": (2.0, 10.0),
    "constant_columns": (5.0, 15.0),
    "high_cardinality": (2.5, 10.0),
}
READINESS_STATUS = (("Excellent", 85.0), ("Good", 70.0), ("Moderate", 50.0))

# ---- end of fixed values ------------------------------------------------------------------------------------
