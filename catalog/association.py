"""Semantics, targets and association between columns."""

from __future__ import annotations

from itertools import combinations

from catalog.registry import EVENTS, GAPS, LABELS, LINEITEM, MIXED, ORDERS, PART, PRICES, Source, query
from catalog.sql import EVENTS as EVENTS_COLUMNS
from catalog.sql import GAPS as GAPS_COLUMNS
from catalog.sql import LINEITEM as LINEITEM_COLUMNS
from catalog.sql import LINEITEM_NUMERIC, column_facts, r, union
from catalog.sql import ORDERS as ORDERS_COLUMNS
from plumbline.operators import association, semantics


def _types(source: Source, columns: list[tuple[str, str]], named: tuple[str, ...] = (), targets: tuple[str, ...] = ()) -> str:
    """The rules over counted facts. What the names say is given; what the values say is computed."""
    steps = "NULL"
    if source.order_by:
        checks = union(
            f"SELECT '{c}' AS column_name, bool_and(d = 1) AS steps FROM (SELECT {c} - lag({c}) OVER (ORDER BY {source.order_by}) AS d FROM src)"
            for c, family in columns
            if family in ("int", "float")
        )
        steps = f"(SELECT steps FROM ({checks}) AS k WHERE k.column_name = cols.column_name)"
    two = union(f"SELECT '{c}' AS column_name, min(CAST({c} AS VARCHAR)) AS low, max(CAST({c} AS VARCHAR)) AS high FROM src" for c, _ in columns)
    listed = {k: ", ".join(f"'{c}'" for c in v) or "''" for k, v in (("named", named), ("targets", targets))}
    rules = (
        ("COALESCE(steps, false) AND ndv > 5", "Identifier", "values rise by one from row to row"),
        (f"column_name IN ({listed['named']})", "Identifier", "name looks like an identifier"),
        ("n_rows > 5 AND ndv = n_rows AND family IN ('int', 'string')", "Identifier", "every row has its own value"),
        ("family = 'bool' OR (ndv = 2 AND low IN ('0', '1', 'true', 'false') AND high IN ('0', '1', 'true', 'false'))", "Boolean", "two truth values"),
        ("ndv = 2", "Binary", "two distinct values"),
        (f"column_name IN ({listed['targets']})", "Target Candidate", "name contains a target keyword"),
        ("family = 'datetime'", "Datetime", "date or timestamp type"),
        ("family = 'int' AND nulls = 0 AND ndv <= 5", "Ordinal", "integers with few distinct values"),
        ("family IN ('int', 'float')", "Numerical", "numeric measurement"),
        ("avg_len > 35", "Text", "long strings"),
        ("true", "Categorical", "discrete values"),
    )
    kind = "CASE " + " ".join(f"WHEN {when} THEN '{label}'" for when, label, _ in rules) + " END"
    why = "CASE " + " ".join(f"WHEN {when} THEN '{reason}'" for when, _, reason in rules) + " END"
    facts = column_facts(source.sql, columns, f"two AS ({two}), seen AS (SELECT cols.*, low, high, {steps} AS steps FROM cols JOIN two USING (column_name))")
    return f"WITH {facts} SELECT ordinal, column_name, {kind} AS semantic_type, {kind} = 'Identifier' AS ignored, {why} AS reason FROM seen"


@query("semantic_types", _types(ORDERS, ORDERS_COLUMNS, (), ("o_orderstatus", "o_totalprice")))
def semantic_types(spark, sf_dir):
    return semantics.semantic_types(ORDERS.profile(spark, sf_dir))


UNORDERED = Source("lineitem")


@query("semantic_types_lineitem", _types(UNORDERED, LINEITEM_COLUMNS, (), ("l_extendedprice",)))
def semantic_types_lineitem(spark, sf_dir):
    return semantics.semantic_types(LINEITEM.frame(spark, sf_dir))


@query("semantic_types_events", _types(EVENTS, EVENTS_COLUMNS, ("event_id", "user_id")))
def semantic_types_events(spark, sf_dir):
    return semantics.semantic_types(EVENTS.profile(spark, sf_dir))


@query("semantic_types_gaps", _types(GAPS, GAPS_COLUMNS, ("event_id", "user_id")))
def semantic_types_gaps(spark, sf_dir):
    return semantics.semantic_types(GAPS.profile(spark, sf_dir))


DOCUMENT_FACTS = Source(
    "documents", "doc_id", "text", "lang", "doc_id % 2 AS flag", "doc_id % 2 = 0 AS truth", "doc_id % 4 AS grade", "n_chars"
)
_DOCUMENT_COLUMNS = [
    ("doc_id", "int"), ("text", "string"), ("lang", "string"), ("flag", "int"), ("truth", "bool"), ("grade", "int"), ("n_chars", "int"),
]


@query("semantic_types_documents", _types(DOCUMENT_FACTS, _DOCUMENT_COLUMNS, ("doc_id",)))
def semantic_types_documents(spark, sf_dir):
    return semantics.semantic_types(DOCUMENT_FACTS.frame(spark, sf_dir))


@query("id_by_name", "SELECT 'event_id' AS column_name, count(event_id) AS n FROM events UNION ALL SELECT 'user_id', count(user_id) FROM events")
def id_by_name(spark, sf_dir):
    """Columns that are identifiers by their name, with their values counted."""
    p = EVENTS.profile(spark, sf_dir)
    named = semantics.name_flags(p).where("id_name")
    return named.join(p.counts, "ordinal").selectExpr("column_name", "non_null AS n")


STEPS = Source(
    "orders",
    "o_orderkey",
    "o_orderkey + 100 AS shifted",
    "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey / 2 AS BIGINT) END AS gapped",
    "-o_orderkey AS falling",
    "CASE WHEN o_orderkey = 7 THEN 8 WHEN o_orderkey = 8 THEN 7 ELSE o_orderkey END AS swapped",
    "o_custkey",
    order_by="o_orderkey",
)


def _steps(column: str) -> str:
    return (
        f"SELECT '{column}' AS column_name FROM (SELECT {column} - lag({column}) OVER (ORDER BY o_orderkey) AS d FROM {STEPS.sql}"
        f" WHERE {column} IS NOT NULL) HAVING bool_and(d = 1)"
    )


@query("id_sequential", union(_steps(c) for c in ("o_orderkey", "shifted", "gapped", "falling", "swapped", "o_custkey")))
def id_sequential(spark, sf_dir):
    found = semantics.sequential_columns(STEPS.profile(spark, sf_dir))
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query(
    "id_sequential_large",
    "SELECT 'big' AS column_name FROM (SELECT big - lag(big) OVER (ORDER BY o_orderkey) AS step FROM"
    " (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) + 1152921504606846976 AS big FROM orders)) HAVING min(step) = 1 AND max(step) = 1",
)
def id_sequential_large(spark, sf_dir):
    """Steps of one among keys that a double cannot tell apart."""
    steps = Source("orders", "o_orderkey", "o_orderkey + 1152921504606846976 AS big", order_by="o_orderkey")
    found = semantics.sequential_columns(steps.profile(spark, sf_dir))
    return spark.createDataFrame([(c,) for c in found if c == "big"], "column_name string")


@query("row_diff", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS value, CAST(o_custkey AS DOUBLE) - lag(o_custkey) OVER (ORDER BY o_orderkey) AS difference FROM orders")
def row_diff(spark, sf_dir):
    return semantics.row_diff(ORDERS.profile(spark, sf_dir), "o_custkey")


@query("exclude_identifiers", "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def exclude_identifiers(spark, sf_dir):
    return semantics.exclude_identifiers(ORDERS.profile(spark, sf_dir))


def _target(table: str, column: str, task: str, reason: str) -> str:
    return (
        f"SELECT '{column}' AS target_column, '{task}' AS task_type, '{reason}' AS reason FROM {table} GROUP BY ALL HAVING count(*) > 0"
    )


@query("detect_target", _target("orders", "o_orderstatus", "classification", "name contains a target keyword"))
def detect_target(spark, sf_dir):
    return semantics.detect_target(ORDERS.profile(spark, sf_dir))


@query("detect_target_lineitem", _target("lineitem", "l_extendedprice", "regression", "name contains a target keyword"))
def detect_target_lineitem(spark, sf_dir):
    return semantics.detect_target(LINEITEM.frame(spark, sf_dir))


@query("detect_target_labels", _target("labels", "quality", "classification", "two distinct values"))
def detect_target_labels(spark, sf_dir):
    return semantics.detect_target(LABELS.frame(spark, sf_dir))


@query("target_stats", f"SELECT 'o_totalprice' AS target_column, {r('avg(o_totalprice)')} AS mean, {r('stddev_samp(o_totalprice)')} AS std,"
       f" {r('min(o_totalprice)')} AS min, {r('max(o_totalprice)')} AS max FROM orders")  # fmt: skip
def target_stats(spark, sf_dir):
    return semantics.target_stats(ORDERS.frame(spark, sf_dir), "o_totalprice")


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


@query(
    "target_correlations",
    union(
        f"SELECT '{c}' AS column_name, {r(_corr(c, 'l_extendedprice'))} AS correlation FROM lineitem"
        for c, _ in LINEITEM_NUMERIC
        if c != "l_extendedprice"
    ),
)
def target_correlations(spark, sf_dir):
    return semantics.target_correlations(LINEITEM.frame(spark, sf_dir), "l_extendedprice")


# ---- correlation ----


def _matrix(source: str, columns: list[str]) -> str:
    return union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(_corr(a, b))} AS correlation FROM {source}" for a in columns for b in columns
    )


_LINEITEM_NAMES = [c for c, _ in LINEITEM_NUMERIC]


@query("pearson_matrix", _matrix("lineitem", _LINEITEM_NAMES))
def pearson_matrix(spark, sf_dir):
    return association.pearson_matrix(LINEITEM.frame(spark, sf_dir))


@query("pearson_matrix_gaps", _matrix(MIXED.sql, ["visitor", "bucket", "price", "k"]))
def pearson_matrix_gaps(spark, sf_dir):
    """Missing values on one side, and a constant column, whose correlations are undefined."""
    return association.pearson_matrix(MIXED.frame(spark, sf_dir))


WIDE = Source("lineitem", *_LINEITEM_NAMES, *[f"{c} * {c} AS {c}_sq" for c in _LINEITEM_NAMES], "CASE WHEN l_linenumber > 1 THEN l_tax END AS some_tax")
_WIDE_NAMES = [*_LINEITEM_NAMES, *[f"{c}_sq" for c in _LINEITEM_NAMES], "some_tax"]


@query("pearson_matrix_wide", _matrix(WIDE.sql, _WIDE_NAMES))
def pearson_matrix_wide(spark, sf_dir):
    """More columns than one generated aggregate can hold: partial matrix products."""
    return association.pearson_matrix(WIDE.frame(spark, sf_dir))


@query("correlation_heatmap", _matrix("part", ["p_partkey", "p_size", "p_retailprice"]))
def correlation_heatmap(spark, sf_dir):
    return association.correlation_heatmap(PART.frame(spark, sf_dir))


_PRICE_NAMES = ["l_quantity", "l_extendedprice", "net", "owed", "o", "n"]
_PRICE_PAIRS = union(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(_corr(a, b))} AS correlation, {_PRICE_NAMES.index(a)} AS i, {_PRICE_NAMES.index(b)}"
    f" AS j FROM src"
    for a, b in combinations(_PRICE_NAMES, 2)
)
_READ = (
    "CASE WHEN abs(correlation) >= 0.85 THEN 'very strong' WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.4"
    " THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction"
)
_BUCKETS = (
    f"WITH src AS {PRICES.sql}, p AS ({_PRICE_PAIRS}), b AS (SELECT column_a, column_b, correlation, i, j, CASE WHEN correlation >= 0.7"
    " THEN 'strong_positive' WHEN correlation <= -0.7 THEN 'strong_negative' WHEN abs(correlation) >= 0.4 THEN 'moderate'"
    f" WHEN abs(correlation) >= 0.2 THEN 'weak' END AS bucket, {_READ} FROM p)"
)


@query("correlation_buckets", f"{_BUCKETS} SELECT column_a, column_b, correlation, bucket, strength, direction FROM b WHERE bucket IS NOT NULL")
def correlation_buckets(spark, sf_dir):
    return association.correlation_buckets(PRICES.frame(spark, sf_dir))


@query(
    "correlation_reading",
    f"{_BUCKETS} SELECT column_a, column_b, correlation, strength, direction, printf('%s %s as %s rises (r = %.2f)', column_b,"
    " CASE WHEN correlation > 0 THEN 'rises' ELSE 'falls' END, column_a, correlation) AS interpretation FROM b",
)
def correlation_reading(spark, sf_dir):
    return association.correlation_reading(PRICES.frame(spark, sf_dir))


@query(
    "rank_pairs",
    f"{_BUCKETS}, s AS (SELECT *, bucket LIKE 'strong%' AS strong FROM b WHERE bucket IS NOT NULL) SELECT column_a, column_b, correlation,"
    " bucket, strength, direction, CAST(row_number() OVER (PARTITION BY bucket ORDER BY abs(correlation) DESC, correlation DESC, i, j)"
    " AS INTEGER) AS bucket_rank, CASE WHEN strong THEN CAST(row_number() OVER (PARTITION BY strong ORDER BY abs(correlation) DESC,"
    " correlation DESC, i, j) AS INTEGER) END AS strong_rank FROM s",
)
def rank_pairs(spark, sf_dir):
    return association.rank_pairs(PRICES.frame(spark, sf_dir))


def _label(score: str, cuts: tuple[float, ...]) -> str:
    names = ("Very Strong", "Strong", "Moderate", "Weak")
    return "CASE " + " ".join(f"WHEN abs({score}) >= {cut} THEN '{name}'" for name, cut in zip(names, cuts)) + " ELSE 'Very Weak' END"


_PEARSON_CUTS, _OTHER_CUTS = (0.85, 0.7, 0.4, 0.2), (0.5, 0.35, 0.2, 0.1)


@query(
    "pair_pearson",
    f"WITH src AS {MIXED.sql}, p AS ("
    + union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {_corr(a, b)} AS s FROM src"
        for a, b in combinations(["visitor", "bucket", "price", "k"], 2)
    )
    + f") SELECT column_a, column_b, n, {r('s')} AS score, {_label('s', _PEARSON_CUTS)} AS strength FROM p WHERE s IS NOT NULL",
)
def pair_pearson(spark, sf_dir):
    return association.pair_pearson(MIXED.frame(spark, sf_dir))


@query(
    "crosstab",
    "SELECT l_returnflag AS value_a, l_linestatus AS value_b, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def crosstab(spark, sf_dir):
    return association.crosstab(LINEITEM.frame(spark, sf_dir), "l_returnflag", "l_linestatus")


@query(
    "crosstab_gaps",
    f"SELECT event_type AS value_a, user_id AS value_b, count(*) AS n FROM {GAPS.sql} WHERE event_type IS NOT NULL GROUP BY 1, 2",
)
def crosstab_gaps(spark, sf_dir):
    return association.crosstab(GAPS.frame(spark, sf_dir), "event_type", "user_id")


def _dense_v(source: str, a: str, b: str) -> str:
    """Cramer's V from the full table of expected counts, empty cells included."""
    return (
        f"(WITH t AS (SELECT {a} AS a, {b} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),"
        " ra AS (SELECT a, count(*) AS n FROM t GROUP BY a), cb AS (SELECT b, count(*) AS n FROM t GROUP BY b),"
        " o AS (SELECT a, b, count(*) AS n FROM t GROUP BY a, b), tot AS (SELECT count(*) AS n FROM t),"
        " e AS (SELECT CAST(ra.n AS DOUBLE) * cb.n / tot.n AS expected, COALESCE(o.n, 0) AS seen FROM ra CROSS JOIN cb CROSS JOIN tot"
        " LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),"
        " x AS (SELECT sum((seen - expected) * (seen - expected) / expected) AS chi2 FROM e),"
        " d AS (SELECT least((SELECT count(*) FROM ra), (SELECT count(*) FROM cb)) - 1 AS smaller)"
        f" SELECT '{a}' AS column_a, '{b}' AS column_b, tot.n AS n, CASE WHEN smaller > 0 THEN least(1.0, sqrt(chi2 / (tot.n * smaller)))"
        " ELSE 0.0 END AS v FROM tot, x, d)"
    )


_V_LINEITEM = (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linenumber", "l_suppkey"))
_V_SELECT = f"SELECT column_a, column_b, n, {r('v')} AS score, {_label('v', _OTHER_CUTS)} AS strength FROM"


@query("cramers_v", f"{_V_SELECT} ({union('SELECT * FROM ' + _dense_v('lineitem', a, b) for a, b in _V_LINEITEM)})")
def cramers_v(spark, sf_dir):
    return association.cramers_v(LINEITEM.frame(spark, sf_dir), list(_V_LINEITEM))


_V_GAPS = (("event_type", "user_id"), ("bucketed", "event_type"))
BUCKETED = Source(
    "events",
    "user_id",
    "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type",
    "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'click' THEN 'a' WHEN value > 50 THEN 'b' ELSE 'c' END AS bucketed",
)


@query("cramers_v_gaps", f"{_V_SELECT} ({union('SELECT * FROM ' + _dense_v(BUCKETED.sql, a, b) for a, b in _V_GAPS)})")
def cramers_v_gaps(spark, sf_dir):
    return association.cramers_v(BUCKETED.frame(spark, sf_dir), list(_V_GAPS))


def _eta(source: str, category: str, number: str) -> str:
    return (
        f"(WITH t AS (SELECT {category} AS g, CAST({number} AS DOUBLE) AS x FROM {source} WHERE {category} IS NOT NULL AND {number} IS NOT NULL),"
        " m AS (SELECT avg(x) AS mean, count(*) AS n, count(DISTINCT x) AS nx, count(DISTINCT g) AS ng FROM t),"
        " b AS (SELECT sum(k * (gm - mean) * (gm - mean)) AS ssb FROM (SELECT g, count(*) AS k, avg(x) AS gm FROM t GROUP BY g), m),"
        " s AS (SELECT sum((x - mean) * (x - mean)) AS sst FROM t, m)"
        f" SELECT '{category}' AS category, '{number}' AS number, n, CASE WHEN nx > 1 AND ng > 1 AND sst > 0 THEN least(1.0, sqrt(ssb / sst))"
        " ELSE 0.0 END AS eta FROM m, b, s)"
    )


_ETA_SELECT = f"SELECT category, number, n, {r('eta')} AS score, {_label('eta', _OTHER_CUTS)} AS strength FROM"
_ETA_CATS, _ETA_NUMS = ["o_orderpriority", "o_orderstatus", "o_orderdate"], ["o_totalprice", "o_custkey"]


@query("correlation_ratio", f"{_ETA_SELECT} ({union('SELECT * FROM ' + _eta('orders', c, x) for c in _ETA_CATS for x in _ETA_NUMS)})")
def correlation_ratio(spark, sf_dir):
    return association.correlation_ratio(ORDERS.frame(spark, sf_dir), _ETA_CATS, _ETA_NUMS)


_ETA_GAPS = [("event_type", "value"), ("event_type", "user_id"), ("event_type", "nothing")]


@query("correlation_ratio_gaps", f"{_ETA_SELECT} ({union('SELECT * FROM ' + _eta(GAPS.sql, c, x) for c, x in _ETA_GAPS)})")
def correlation_ratio_gaps(spark, sf_dir):
    return association.correlation_ratio(GAPS.frame(spark, sf_dir), ["event_type"], ["value", "user_id", "nothing"])


@query(
    "association_strength",
    f"SELECT column_a, column_b, strength FROM ({_V_SELECT} {_dense_v('lineitem', 'l_shipdate', 'l_linestatus')})",
)
def association_strength(spark, sf_dir):
    found = association.cramers_v(LINEITEM.frame(spark, sf_dir), [("l_shipdate", "l_linestatus")])
    return found.select("column_a", "column_b", "strength")


_RELATED = ["user_id", "kind", "bucketed", "value", "double_value"]
RELATED = Source(
    "events",
    "user_id",
    "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS kind",
    "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'click' THEN 'a' WHEN value > 50 THEN 'b' ELSE 'c' END AS bucketed",
    "value",
    "value * 2 + event_id % 13 AS double_value",
)


def _relationships() -> str:
    once = [
        f"SELECT 'value' AS a, 'double_value' AS b, 'pearson' AS metric, corr(value, double_value) AS s FROM src",
        f"SELECT column_a, column_b, 'cramers_v', v FROM {_dense_v('src', 'kind', 'bucketed')}",
    ]
    once += [
        f"SELECT category, number, 'eta', eta FROM {_eta('src', c, x)}" for c in ("kind", "bucketed") for x in ("value", "double_value")
    ]
    strength = f"CASE WHEN metric = 'pearson' THEN {_label('s', _PEARSON_CUTS)} ELSE {_label('s', _OTHER_CUTS)} END"
    place = ", ".join(f"('{c}', {i})" for i, c in enumerate(_RELATED))
    return (
        f"WITH src AS {RELATED.sql}, once AS ({union(once)}), sides AS (SELECT a, b, metric, s, {strength} AS strength FROM once UNION ALL"
        f" SELECT b, a, metric, s, {strength} FROM once UNION ALL SELECT c, 'user_id', NULL, NULL, 'Identifier' FROM"
        " (VALUES ('kind'), ('bucketed'), ('value'), ('double_value')) AS v(c)),"
        f" placed AS (SELECT sides.*, i FROM sides JOIN (VALUES {place}) AS p(c, i) ON c = b)"
        f" SELECT a AS column_name, b AS feature, metric, {r('s')} AS score, strength, CAST(row_number() OVER (PARTITION BY a ORDER BY"
        f" abs({r('s')}) DESC NULLS LAST, i) AS INTEGER) AS rank FROM placed"
    )


@query("feature_relationships", _relationships())
def feature_relationships(spark, sf_dir):
    return association.feature_relationships(RELATED.frame(spark, sf_dir))


@query(
    "top_relations",
    f"SELECT column_name, CAST(place AS INTEGER) AS place, feature, metric, score, strength FROM (SELECT *, row_number() OVER (PARTITION BY"
    f" column_name ORDER BY rank) AS place FROM ({_relationships()}) WHERE strength IN ('Very Strong', 'Strong', 'Moderate')) WHERE place <= 2",
)
def top_relations(spark, sf_dir):
    return association.top_relations(RELATED.frame(spark, sf_dir))


