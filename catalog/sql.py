"""Pieces of SQL shared by the oracles. They restate the definitions; they share no code with the library."""

from __future__ import annotations


def r(x: str, digits: int = 4) -> str:
    """Correctly rounded decimal of a double; adding zero drops the sign of a negative zero."""
    return f"(CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0)"


def share(part: str, whole: str) -> str:
    return f"COALESCE(CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0), 0.0)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return r(f"{share(part, whole)} * 100.0", digits)


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def shape_label(skew: str) -> str:
    return (
        f"CASE WHEN {skew} > 1 THEN 'Highly Right Skewed' WHEN {skew} < -1 THEN 'Highly Left Skewed'"
        f" WHEN {skew} > 0.5 THEN 'Slightly Right Skewed' WHEN {skew} < -0.5 THEN 'Slightly Left Skewed' ELSE 'Normal' END"
    )


def column_facts(src: str, columns: list[tuple[str, str]], extra: str = "") -> str:
    """CTEs ``src``, ``base`` and ``cols``: one row of facts per column. Families: int, float, string, datetime."""
    rows = []
    for i, (c, family) in enumerate(columns):
        numeric = family in ("int", "float")
        x = f"CAST({c} AS DOUBLE)"
        num = (
            f"avg({x}) AS mean, CASE WHEN count({c}) > 1 THEN stddev_samp({x}) ELSE 0 END AS std,"
            f" CASE WHEN count({c}) > 1 THEN var_samp({x}) ELSE 0 END AS variance, min({x}) AS mn, max({x}) AS mx,"
            f" quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3,"
            f" CASE WHEN count({c}) > 2 AND count(DISTINCT {c}) > 1 THEN skewness({x}) ELSE 0 END AS skew,"
            f" CASE WHEN count({c}) > 3 AND count(DISTINCT {c}) > 1 THEN kurtosis({x}) ELSE 0 END AS kurt,"
            f" count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives"
            if numeric
            else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS variance, NULL::DOUBLE AS mn, NULL::DOUBLE AS mx,"
            " NULL::DOUBLE AS q1, NULL::DOUBLE AS q2, NULL::DOUBLE AS q3, NULL::DOUBLE AS skew, NULL::DOUBLE AS kurt,"
            " NULL::BIGINT AS zeros, NULL::BIGINT AS negatives"
        )
        length = f"avg(length({c}))" if family == "string" else "NULL::DOUBLE"
        rows.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, '{family}' AS family, count(*) AS n_rows, count({c}) AS n,"
            f" count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS ndv, {length} AS avg_len, {num} FROM src"
        )
    counted, modes = [], []
    for c, family in columns:
        if family in ("int", "float"):
            counted.append(
                f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
                f" AS outliers FROM src, base WHERE base.column_name = '{c}' GROUP BY ALL"
            )
        number = f"CAST({c} AS DOUBLE)" if family in ("int", "float") else "NULL::DOUBLE"
        text = f"CAST({c} AS VARCHAR)" if family != "float" else "NULL::VARCHAR"
        modes.append(
            f"(SELECT '{c}' AS column_name, {text} AS mode_text, {number} AS mode_number, count(*) AS mode_n FROM src"
            f" WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        )
    outliers = union(counted) or "SELECT NULL::VARCHAR AS column_name, 0 AS outliers"
    return (
        f"src AS {src}, base AS ({union(rows)}), outs AS ({outliers}), modes AS ({union(modes)}),"
        " cols AS (SELECT base.*, q3 - q1 AS iqr, CASE WHEN ndv > 1 THEN q1 - 1.5 * (q3 - q1) END AS lo,"
        " CASE WHEN ndv > 1 THEN q3 + 1.5 * (q3 - q1) END AS hi, COALESCE(outliers, 0) AS outliers, mode_text, mode_number,"
        " COALESCE(mode_n, 0) AS mode_n FROM base LEFT JOIN outs USING (column_name) LEFT JOIN modes USING (column_name))"
        + (f", {extra}" if extra else "")
    )


LINEITEM = [
    ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"),
    ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "datetime"),
]
LINEITEM_NUMERIC = [c for c in LINEITEM if c[1] in ("int", "float")]
ORDERS = [
    ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"), ("o_totalprice", "float"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
]
CUSTOMER = [
    ("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "string"),
]
PART = [
    ("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
    ("p_retailprice", "float"),
]
EVENTS = [
    ("event_id", "int"), ("ts", "datetime"), ("user_id", "int"), ("event_type", "string"), ("value", "float"),
    ("props", "string"),
]
GAPS = [
    ("event_id", "int"), ("ts", "datetime"), ("user_id", "int"), ("event_type", "string"), ("value", "float"),
    ("nothing", "float"),
]
MIXED = [("visitor", "int"), ("event_type", "string"), ("bucket", "float"), ("price", "float"), ("k", "int")]
