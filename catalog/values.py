"""Distinct values, categories, duplicates and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    CUSTOMER,
    DOCUMENTS,
    GAPS,
    LABELS,
    MIXED,
    ORDERS,
    REPEATED,
    REPEATED_BY_ID,
    Source,
    query,
)
from catalog.sql import CUSTOMER as CUSTOMER_COLUMNS
from catalog.sql import GAPS as GAPS_COLUMNS
from catalog.sql import MIXED as MIXED_COLUMNS
from catalog.sql import ORDERS as ORDERS_COLUMNS
from catalog.sql import column_facts, pct, r, share, union
from plumbline.functions.rounding import rnd
from plumbline.operators import cardinality, charts, duplicates, text

_ORDERS = f"WITH {column_facts(ORDERS.sql, ORDERS_COLUMNS)}"
_CUSTOMER = f"WITH {column_facts(CUSTOMER.sql, CUSTOMER_COLUMNS)}"
_GAPS = f"WITH {column_facts(GAPS.sql, GAPS_COLUMNS)}"
_MIXED = f"WITH {column_facts(MIXED.sql, MIXED_COLUMNS)}"


@query(
    "distinct_profile",
    f"{_ORDERS} SELECT column_name, ndv AS unique_count, {r(share('ndv', 'n_rows'))} AS unique_ratio, ndv = n_rows AS is_unique FROM cols",
)
def distinct_profile(spark, sf_dir):
    return cardinality.distinct_profile(ORDERS.frame(spark, sf_dir))


@query(
    "distinct_profile_gaps",
    f"{_GAPS} SELECT column_name, ndv AS unique_count, {r(share('ndv', 'n_rows'))} AS unique_ratio, ndv = n_rows AS is_unique FROM cols",
)
def distinct_profile_gaps(spark, sf_dir):
    return cardinality.distinct_profile(GAPS.frame(spark, sf_dir))


@query("distinct_profile_approx")
def distinct_profile_approx(spark, sf_dir):
    return cardinality.distinct_profile(ORDERS.profile(spark, sf_dir, exact=False))


# Floating-point modes are compared as numbers under numeric_mode: the engines print large doubles differently.
CODED = Source("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
_CODED = [c for c in ORDERS_COLUMNS if c[0] != "o_totalprice"]


@query(
    "most_frequent",
    f"WITH {column_facts(CODED.sql, _CODED)} SELECT column_name, mode_text AS most_frequent_value, mode_n AS most_frequent_count,"
    f" {pct('mode_n', 'n_rows')} AS most_frequent_percentage FROM cols",
)
def most_frequent(spark, sf_dir):
    return cardinality.most_frequent(CODED.frame(spark, sf_dir))


TEXTS = Source("documents", "text", "lang")


@query(
    "most_frequent_text",
    union(
        f"(SELECT '{c}' AS column_name, {c} AS most_frequent_value, count(*) AS most_frequent_count,"
        f" {pct('count(*)', '(SELECT count(*) FROM documents)')} AS most_frequent_percentage FROM documents GROUP BY {c}"
        f" ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in ("text", "lang")
    ),
)
def most_frequent_text(spark, sf_dir):
    """Long texts are counted by digest, and the mode is looked up again in full."""
    return cardinality.most_frequent(TEXTS.frame(spark, sf_dir))


def _status(identifier: str) -> str:
    return (
        f"CASE WHEN ndv = n_rows OR {identifier} THEN 'Unique Identifier' WHEN {r(share('ndv', 'n_rows'))} > 0.5 THEN 'High Cardinality'"
        " WHEN ndv <= 1 THEN 'Zero Variance / Constant' WHEN ndv <= 10 THEN 'Low Cardinality' ELSE 'Moderate Cardinality' END"
    )


@query(
    "cardinality_status",
    f"{_GAPS} SELECT column_name, {_status('column_name IN (' + chr(39) + 'event_id' + chr(39) + ', ' + chr(39) + 'user_id' + chr(39) + ')')}"
    " AS cardinality_status FROM cols",
)
def cardinality_status(spark, sf_dir):
    return cardinality.unique_values(GAPS.frame(spark, sf_dir)).select("column_name", "cardinality_status")


_ORDER_TYPES = (
    "CASE column_name WHEN 'o_orderkey' THEN 'Identifier' WHEN 'o_custkey' THEN 'Numerical' WHEN 'o_orderstatus' THEN 'Target Candidate'"
    " WHEN 'o_orderdate' THEN 'Datetime' ELSE 'Categorical' END"
)


@query(
    "unique_values",
    f"WITH {column_facts(CODED.sql, _CODED)}, t AS (SELECT *, {_ORDER_TYPES} AS kind FROM cols) SELECT column_name, ndv AS unique_count,"
    f" {r(share('ndv', 'n_rows'))} AS unique_ratio, ndv = n_rows AS is_unique, mode_text AS most_frequent_value,"
    f" mode_n AS most_frequent_count, {pct('mode_n', 'n_rows')} AS most_frequent_percentage, kind AS semantic_type,"
    f" kind = 'Identifier' AS is_identifier, {_status('kind = ' + chr(39) + 'Identifier' + chr(39))} AS cardinality_status FROM t",
)
def unique_values(spark, sf_dir):
    return cardinality.unique_values(CODED.frame(spark, sf_dir))


_CATEGORICAL = (
    f"SELECT column_name, ndv AS unique_count, {r(share('ndv', 'n_rows'))} AS cardinality_ratio,"
    f" {r(share('ndv', 'n_rows'))} > 0.5 AS is_high_cardinality FROM cols WHERE family = 'string'"
)


@query("categorical_profile", f"{_CUSTOMER} {_CATEGORICAL}")
def categorical_profile(spark, sf_dir):
    return cardinality.categorical_profile(CUSTOMER.frame(spark, sf_dir))


@query(
    "high_cardinality_columns",
    f"{_CUSTOMER}, c AS ({_CATEGORICAL}) SELECT column_name, cardinality_ratio FROM c WHERE is_high_cardinality",
)
def high_cardinality_columns(spark, sf_dir):
    return cardinality.high_cardinality_columns(CUSTOMER.frame(spark, sf_dir))


@query("constant_columns", f"{_MIXED} SELECT column_name, ndv AS unique_count FROM cols WHERE ndv <= 1")
def constant_columns(spark, sf_dir):
    return cardinality.constant_columns(MIXED.frame(spark, sf_dir))


@query("constant_columns_empty", f"{_GAPS} SELECT column_name, ndv AS unique_count FROM cols WHERE ndv <= 1")
def constant_columns_empty(spark, sf_dir):
    return cardinality.constant_columns(GAPS.frame(spark, sf_dir))


def _top(table: str, columns: tuple[str, ...], top: int = 10) -> str:
    return union(
        f"(SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, {c} AS value,"
        f" count(*) AS count, {pct('count(*)', f'(SELECT count(*) FROM {table})')} AS percentage FROM {table} WHERE {c} IS NOT NULL"
        f" GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT {top})"
        for c in columns
    )


@query("top_categories", _top("customer", ("c_name", "c_mktsegment")))
def top_categories(spark, sf_dir):
    return cardinality.top_categories(CUSTOMER.frame(spark, sf_dir))


@query("top_categories_gaps", _top(GAPS.sql, ("event_type",)))
def top_categories_gaps(spark, sf_dir):
    return cardinality.top_categories(GAPS.frame(spark, sf_dir))


@query(
    "top_categories_text",
    "WITH g AS (SELECT text AS value, count(*) AS n FROM documents GROUP BY text),"
    " w AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM g)"
    f" SELECT 'text' AS column_name, CAST(rank AS INTEGER) AS rank, value, n AS count,"
    f" {pct('n', '(SELECT count(*) FROM documents)')} AS percentage FROM w WHERE rank <= 10",
)
def top_categories_text(spark, sf_dir):
    """Long texts: ties go to the smaller text."""
    return cardinality.top_categories(DOCUMENTS.frame(spark, sf_dir).select("text"))


_BIG = "o_orderkey + 1152921504606846976"


@query(
    "distinct_profile_large",
    f"SELECT 'big' AS column_name, count(DISTINCT {_BIG}) AS unique_count, {r('count(DISTINCT o_orderkey) / CAST(count(*) AS DOUBLE)')}"
    " AS unique_ratio, count(DISTINCT o_orderkey) = count(*) AS is_unique FROM orders",
)
def distinct_profile_large(spark, sf_dir):
    """Keys of 19 digits, read from text."""
    from plumbline.sources.readers import infer_types

    return cardinality.distinct_profile(infer_types(Source("orders", f"CAST({_BIG} AS STRING) AS big").frame(spark, sf_dir)))


@query(
    "frequency_tables",
    f"SELECT column_name, value, count FROM ({_top('orders', ('o_orderstatus', 'o_orderpriority'))})",
)
def frequency_tables(spark, sf_dir):
    """The maps as rows."""
    maps = cardinality.frequency_tables(ORDERS.frame(spark, sf_dir))
    return maps.select("column_name", F.explode("frequencies").alias("value", "count"))


@query(
    "pareto",
    "WITH g AS (SELECT c_name AS value, count(*) AS count FROM customer GROUP BY c_name) SELECT 'c_name' AS column_name, value, count,"
    f" {r('sum(count) OVER (ORDER BY count DESC, value ROWS UNBOUNDED PRECEDING) / CAST((SELECT sum(count) FROM g) AS DOUBLE) * 100.0')}"
    " AS cumulative_percentage FROM g",
)
def pareto(spark, sf_dir):
    return cardinality.pareto(CUSTOMER.frame(spark, sf_dir), "c_name")


@query(
    "pareto_status",
    "WITH g AS (SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1) SELECT 'o_orderpriority' AS column_name, value,"
    f" count, {r('sum(count) OVER (ORDER BY count DESC, value ROWS UNBOUNDED PRECEDING) / CAST((SELECT sum(count) FROM g) AS DOUBLE) * 100.0')}"
    " AS cumulative_percentage FROM g",
)
def pareto_status(spark, sf_dir):
    return cardinality.pareto(ORDERS.frame(spark, sf_dir), "o_orderpriority")


@query(
    "pareto_text",
    "WITH g AS (SELECT text AS value, count(*) AS count FROM documents GROUP BY text) SELECT 'text' AS column_name, value, count,"
    f" {r('sum(count) OVER (ORDER BY count DESC, value ROWS UNBOUNDED PRECEDING) / CAST((SELECT sum(count) FROM g) AS DOUBLE) * 100.0')}"
    " AS cumulative_percentage FROM g",
)
def pareto_text(spark, sf_dir):
    return cardinality.pareto(DOCUMENTS.frame(spark, sf_dir), "text")


def _classes(source: str, column: str) -> str:
    return (
        f"SELECT CAST({column} AS VARCHAR) AS class, count(*) AS count,"
        f" {pct('count(*)', f'(SELECT count({column}) FROM {source})')} AS percentage FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}"
    )


@query("class_distribution", _classes("orders", "o_orderstatus"))
def class_distribution(spark, sf_dir):
    return cardinality.class_distribution(ORDERS.frame(spark, sf_dir), "o_orderstatus")


@query("class_distribution_labels", _classes("labels", "quality"))
def class_distribution_labels(spark, sf_dir):
    return cardinality.class_distribution(LABELS.frame(spark, sf_dir), "quality")


@query("share_of_total", _classes(GAPS.sql, "event_type"))
def share_of_total(spark, sf_dir):
    return cardinality.class_distribution(GAPS.frame(spark, sf_dir), "event_type")


_TOP_STATUS = (
    "SELECT 'o_orderstatus' AS column_name, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS INTEGER) AS rank,"
    " o_orderstatus AS value, count(*) AS count FROM orders GROUP BY o_orderstatus ORDER BY count DESC, value"
)


@query("category_counts", f"{_TOP_STATUS} LIMIT 10")
def category_counts(spark, sf_dir):
    return charts.category_counts_chart(ORDERS.frame(spark, sf_dir))


@query(
    "category_shares",
    f"WITH t AS ({_TOP_STATUS} LIMIT 8) SELECT *, {pct('count', '(SELECT sum(count) FROM t)')} AS share FROM t",
)
def category_shares(spark, sf_dir):
    return charts.category_shares(ORDERS.frame(spark, sf_dir))


# ---- duplicates ----


def _duplicates(source: str, columns: str) -> str:
    return (
        f"WITH src AS {source}, d AS (SELECT (SELECT count(*) FROM src) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM src))"
        f" AS kept), e AS (SELECT n_rows, n_rows - kept AS duplicate_rows, {pct('n_rows - kept', 'n_rows')} AS duplicate_percentage FROM d)"
        " SELECT *, CASE WHEN duplicate_rows = 0 THEN 'none' WHEN duplicate_percentage > 30 THEN 'redundant' ELSE 'contextual' END"
        " AS assessment, duplicate_rows > 50 AS truncated FROM e"
    )


@query("duplicate_summary", _duplicates(REPEATED.sql, "user_id, event_type"))
def duplicate_summary(spark, sf_dir):
    return duplicates.duplicate_summary(REPEATED.frame(spark, sf_dir))


@query("duplicate_assessment", _duplicates(MIXED.sql, "visitor, event_type, bucket, price, k"))
def duplicate_assessment(spark, sf_dir):
    """Rows with missing values, which equal each other."""
    return duplicates.duplicate_summary(MIXED.frame(spark, sf_dir))


@query("duplicate_summary_text", _duplicates("(SELECT text FROM documents)", "text"))
def duplicate_summary_text(spark, sf_dir):
    return duplicates.duplicate_summary(DOCUMENTS.frame(spark, sf_dir).select("text"))


_COPIES = (
    "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS copy"
    " FROM events) WHERE copy > 1"
)


@query("duplicate_rows", _COPIES)
def duplicate_rows(spark, sf_dir):
    return duplicates.duplicate_rows(REPEATED_BY_ID.frame(spark, sf_dir), "event_id")


@query("duplicate_samples", f"{_COPIES} ORDER BY event_id LIMIT 20")
def duplicate_samples(spark, sf_dir):
    return duplicates.duplicate_samples(REPEATED_BY_ID.frame(spark, sf_dir), "event_id")


@query("duplicate_indices", f"SELECT event_id FROM ({_COPIES} ORDER BY event_id LIMIT 50)")
def duplicate_indices(spark, sf_dir):
    return duplicates.duplicate_samples(REPEATED_BY_ID.frame(spark, sf_dir), "event_id", 50).select("event_id")


_HOLED = (
    "user_id % 40 AS visitor", "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN CAST('NaN' AS DOUBLE) ELSE event_id % 5 + 0.5 END AS v",
)


@query("dedupe_rows_gaps", f"SELECT DISTINCT visitor, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT {', '.join(_HOLED)} FROM events)")
def dedupe_rows_gaps(spark, sf_dir):
    kept = duplicates.dedupe_rows(Source("events", *_HOLED).frame(spark, sf_dir))
    return kept.selectExpr("visitor", "CASE WHEN NOT isnan(v) THEN v END AS v")


@query("dedupe_rows", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe_rows(spark, sf_dir):
    return duplicates.dedupe_rows(REPEATED.frame(spark, sf_dir))


# ---- text ----

_WORDS = r"len(list_filter(string_split_regex({c}, '[\s\x{{85}}\p{{Z}}\x1c-\x1f]+'), lambda w: w <> ''))"


def _gate(table: str, columns: tuple[str, ...]) -> str:
    return union(
        f"SELECT '{c}' AS column_name, avg(length({c})) AS avg_length, min(length({c})) AS min_length, max(length({c})) AS max_length,"
        f" avg({_WORDS.format(c=c)}) AS avg_words FROM {table}"
        for c in columns
    )


_DOCUMENT_GATE = f"WITH g AS (SELECT *, NOT (avg_length < 20 AND avg_words < 3) AS is_text FROM ({_gate('documents', ('text', 'lang', 'source'))}))"


@query(
    "text_gate",
    f"{_DOCUMENT_GATE} SELECT column_name, {r('avg_length')} AS avg_length, min_length, max_length, {r('avg_words')} AS avg_words, is_text FROM g",
)
def text_gate(spark, sf_dir):
    gate = text.text_gate(DOCUMENTS.frame(spark, sf_dir))
    return gate.withColumns({c: rnd(c, 4) for c in ("avg_length", "avg_words")})


@query(
    "text_gate_customer",
    f"WITH g AS (SELECT *, NOT (avg_length < 20 AND avg_words < 3) AS is_text FROM ({_gate('customer', ('c_name', 'c_mktsegment'))}))"
    f" SELECT column_name, {r('avg_length')} AS avg_length, min_length, max_length, {r('avg_words')} AS avg_words, is_text FROM g",
)
def text_gate_customer(spark, sf_dir):
    gate = text.text_gate(CUSTOMER.frame(spark, sf_dir))
    return gate.withColumns({c: rnd(c, 4) for c in ("avg_length", "avg_words")})


@query(
    "text_lengths",
    f"{_DOCUMENT_GATE} SELECT column_name, {r('avg_length', 2)} AS avg_length, min_length, max_length FROM g WHERE is_text",
)
def text_lengths(spark, sf_dir):
    return text.text_lengths(DOCUMENTS.frame(spark, sf_dir))


_TOKENS = (
    r"WITH w AS (SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents),"
    " c AS (SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{3,}') GROUP BY word)"
)


@query("text_vocabulary", f"{_TOKENS} SELECT 'text' AS column_name, count(*) AS vocabulary_size FROM c")
def text_vocabulary(spark, sf_dir):
    return text.text_vocabulary(DOCUMENTS.frame(spark, sf_dir))


@query(
    "top_words",
    f"{_TOKENS} SELECT 'text' AS column_name, CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS rank, word, n AS count FROM c"
    " ORDER BY n DESC, word LIMIT 10",
)
def top_words(spark, sf_dir):
    return text.top_words(DOCUMENTS.frame(spark, sf_dir))
