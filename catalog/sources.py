"""Reading, normalizing, previewing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import CUSTOMER, GAPS, INFINITE, LINEITEM, ORDERS, PART, Source, query
from catalog.sql import CUSTOMER as CUSTOMER_COLUMNS
from catalog.sql import GAPS as GAPS_COLUMNS
from catalog.sql import pct, r, union
from plumbline.functions.types import quoted
from plumbline.operators import missing, numeric, preview
from plumbline.sources import readers, sinks

TOKENS = Source(
    "customer",
    "c_custkey",
    "CASE WHEN c_custkey % 5 = 0 THEN 'NA' WHEN c_custkey % 5 = 1 THEN 'n/a' WHEN c_custkey % 5 = 2 THEN '' ELSE c_mktsegment"
    " END AS c_mktsegment",
)


@query("scan_table", "SELECT * FROM lineitem")
def scan_table(spark, sf_dir):
    return readers.read_table(spark, f"{sf_dir}/lineitem.parquet")


@query(
    "null_token_normalize",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def null_token_normalize(spark, sf_dir):
    return readers.null_tokens(TOKENS.frame(spark, sf_dir))


@query(
    "infer_types",
    "SELECT 'o_orderkey' AS column_name, count(*) AS n, count(*) AS integer, count(*) AS number, CAST(0 AS BIGINT) AS truth,"
    " 'bigint' AS inferred_type FROM orders UNION ALL"
    " SELECT 'o_custkey', count(*), count(*), count(*), 0, 'bigint' FROM orders UNION ALL"
    " SELECT 'o_orderstatus', count(*), 0, 0, 0, 'string' FROM orders UNION ALL"
    " SELECT 'o_totalprice', count(*), 0, count(*), 0, 'double' FROM orders UNION ALL"
    " SELECT 'o_orderdate', count(*), 0, 0, 0, 'string' FROM orders UNION ALL"
    " SELECT 'o_orderpriority', count(*), 0, 0, 0, 'string' FROM orders",
)
def infer_types(spark, sf_dir):
    df = ORDERS.frame(spark, sf_dir)
    return readers.type_evidence(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))


@query("infer_types_cast", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def infer_types_cast(spark, sf_dir):
    df = ORDERS.frame(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return readers.infer_types(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))


@query("assert_nonempty", "SELECT * FROM part")
def assert_nonempty(spark, sf_dir):
    return readers.assert_nonempty(PART.frame(spark, sf_dir))


@query(
    "write_report",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CASE WHEN event_id % 1000 IN (0, 1) THEN NULL ELSE value END"
    " AS value FROM events",
)
def write_report(spark, sf_dir):
    """What the sink writes: infinities as null, timestamps as ISO text."""
    return sinks.json_safe(INFINITE.frame(spark, sf_dir))


@query(
    "numeric_columns",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def numeric_columns(spark, sf_dir):
    df = LINEITEM.frame(spark, sf_dir)
    return df.select(*[quoted(r["column_name"]) for r in numeric.numeric_columns(df).orderBy("ordinal").collect()])


@query("categorical_columns", "SELECT l_returnflag, l_linestatus FROM lineitem")
def categorical_columns(spark, sf_dir):
    df = LINEITEM.frame(spark, sf_dir)
    return df.select(*[quoted(r["column_name"]) for r in numeric.categorical_columns(df).orderBy("ordinal").collect()])


@query(
    "complete_cases",
    f"SELECT event_id, user_id, event_type, value FROM {GAPS.sql} WHERE event_type IS NOT NULL AND value IS NOT NULL",
)
def complete_cases(spark, sf_dir):
    kept = missing.complete_cases(GAPS.frame(spark, sf_dir), ["event_type", "value"])
    return kept.select("event_id", "user_id", "event_type", "value")


@query(
    "missing_matrix",
    "SELECT false AS event_id, false AS ts, false AS user_id, event_type IS NULL AS event_type, value IS NULL AS value,"
    f" true AS nothing FROM {GAPS.sql} ORDER BY event_id LIMIT 50",
)
def missing_matrix(spark, sf_dir):
    return missing.missing_matrix(GAPS.profile(spark, sf_dir))


@query("preview_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_head(spark, sf_dir):
    return preview.preview_head(ORDERS.profile(spark, sf_dir))


@query("preview_tail", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def preview_tail(spark, sf_dir):
    return preview.preview_tail(ORDERS.profile(spark, sf_dir))


@query("preview_sample", "SELECT * FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 5")
def preview_sample(spark, sf_dir):
    return preview.preview_sample(ORDERS.profile(spark, sf_dir))


@query(
    "table_shape",
    "SELECT count(*) AS n_rows, 11 AS n_columns, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,"
    "l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS column_names FROM lineitem",
)
def table_shape(spark, sf_dir):
    return preview.table_shape(LINEITEM.frame(spark, sf_dir))


@query(
    "dtype_summary",
    "WITH n AS (SELECT count(*) AS n_rows FROM lineitem) SELECT data_type, columns, n_rows FROM n, (VALUES"
    " ('bigint', CAST(3 AS BIGINT)), ('int', 1), ('double', 4), ('string', 2), ('timestamp_ntz', 1)) AS v(data_type, columns)",
)
def dtype_summary(spark, sf_dir):
    df = LINEITEM.frame(spark, sf_dir)
    rows = preview.table_shape(df).select("n_rows")
    return preview.dtype_summary(df).withColumn("n_rows", F.lit(rows.first()[0]).cast("bigint"))


_SIZES = {"c_custkey": 8, "c_nationkey": 4, "c_acctbal": 8}
_BYTES = {
    c: f"count({c}) * {_SIZES[c]}" if c in _SIZES else f"CAST(sum(strlen({c})) AS BIGINT)" for c, _ in CUSTOMER_COLUMNS
}


@query(
    "logical_bytes",
    f"WITH b AS ({union(f'SELECT {chr(39)}{c}{chr(39)} AS column_name, {e} AS bytes FROM customer' for c, e in _BYTES.items())}),"
    " t AS (SELECT CAST(sum(bytes) AS BIGINT) AS total_bytes FROM b)"
    f" SELECT column_name, bytes, total_bytes, {r('total_bytes / 1048576.0')} AS total_mb FROM b, t",
)
def logical_bytes(spark, sf_dir):
    return preview.logical_bytes(CUSTOMER.frame(spark, sf_dir))


_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(
    "column_info",
    union(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, '{_TYPES[c]}' AS data_type, count({c}) AS non_null_count,"
        f" count(*) - count({c}) AS null_count, {pct(f'count(*) - count({c})', 'count(*)')} AS null_percentage,"
        f" {e} AS bytes FROM customer"
        for i, (c, e) in enumerate(_BYTES.items())
    ),
)
def column_info(spark, sf_dir):
    return preview.column_info(CUSTOMER.frame(spark, sf_dir))


_MISSING = (
    f"WITH src AS {GAPS.sql}, m AS ("
    + union(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) - count({c}) AS missing_count,"
        f" {pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage, count(*) AS n_rows FROM src"
        for i, (c, _) in enumerate(GAPS_COLUMNS)
    )
    + ")"
)


@query("missing_by_column", f"{_MISSING} SELECT ordinal, column_name, missing_count, missing_percentage FROM m")
def missing_by_column(spark, sf_dir):
    return missing.missing_by_column(GAPS.frame(spark, sf_dir))


@query(
    "missing_totals",
    f"{_MISSING} SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing_cells, CAST(sum(n_rows) AS BIGINT) AS total_cells,"
    " count(*) FILTER (WHERE missing_count > 0) AS columns_with_missing,"
    f" {pct('sum(missing_count)', 'sum(n_rows)')} AS overall_missing_percentage FROM m",
)
def missing_totals(spark, sf_dir):
    return missing.missing_totals(GAPS.frame(spark, sf_dir))


@query(
    "missing_flags",
    f"{_MISSING} SELECT column_name, missing_percentage = 100.0 AS fully_missing FROM m WHERE missing_count > 0",
)
def missing_flags(spark, sf_dir):
    return missing.missing_flags(GAPS.frame(spark, sf_dir))


@query(
    "missing_bars",
    f"{_MISSING} SELECT column_name, missing_count, missing_percentage FROM m WHERE missing_count > 0"
    " ORDER BY missing_percentage DESC, ordinal",
)
def missing_bars(spark, sf_dir):
    return missing.missing_bars(GAPS.frame(spark, sf_dir))


@query(
    "worst_missing_column",
    f"{_MISSING} SELECT column_name, missing_count, missing_percentage FROM m ORDER BY missing_percentage DESC, ordinal LIMIT 1",
)
def worst_missing_column(spark, sf_dir):
    return missing.worst_missing_column(GAPS.frame(spark, sf_dir))


@query(
    "invalid_values",
    f"WITH src AS {INFINITE.sql}, v AS (SELECT 'event_id' AS column_name, CAST(0 AS BIGINT) AS infinite_count UNION ALL"
    " SELECT 'value', count(*) FILTER (WHERE isinf(value)) FROM src)"
    " SELECT column_name, infinite_count, (SELECT CAST(sum(infinite_count) AS BIGINT) FROM v) AS infinite_total FROM v",
)
def invalid_values(spark, sf_dir):
    return numeric.invalid_values(INFINITE.frame(spark, sf_dir))


