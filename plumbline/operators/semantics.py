"""What each column means: identifier, boolean, binary, target, datetime, ordinal, numerical, text or categorical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed import BOOLEAN_TOKENS, ID_NAME, TARGET_KEYWORDS
from plumbline.functions.rounding import rnd
from plumbline.functions.types import FLOAT, INT, STRING, quoted
from plumbline.operators.cardinality import class_distribution
from plumbline.plans.running import previous_value
from plumbline.plans.small import local, pinned
from plumbline.profile import Profile, as_profile

# Consecutive values checked together; a bucket holds at most this many rows.
SEQUENCE_BUCKET = 1_000_000


def name_flags(p: Profile) -> DataFrame:
    """What the column names alone say."""
    rows = []
    for c in p.columns:
        name = c.name.strip()
        rows.append((c.ordinal, bool(ID_NAME.search(name)), any(k in name.lower() for k in TARGET_KEYWORDS)))
    return local(p.spark, rows, "ordinal int, id_name boolean, target_name boolean")


def sequential_columns(table: DataFrame | Profile, bucket: int = SEQUENCE_BUCKET) -> list[str]:
    """Numeric columns that go up by exactly one from each non-missing value to the next in row order.

    Only a column of distinct values that fill ``max - min + 1`` steps can qualify, which the shared aggregates
    already tell. For those few, values are cut into buckets of equal width, which hold equally many rows because
    the values are dense. Within a bucket the row order must rise with the value, and so must the buckets' ends.
    No global sort or unpartitioned window over rows is needed.
    """
    p = as_profile(table)
    if not p.order_by:
        return []
    facts = p.counts.join(p.rule_counts.drop("column_name"), "ordinal").where(
        F.col("family").isin(INT, FLOAT)
        & (F.col("ndv") > 5)
        & (F.col("ndv") == F.col("non_null"))
        & F.when(F.col("family") == INT, _whole("max_text") - _whole("min_text") + 1 == F.col("ndv")).otherwise(
            F.col("max_num") - F.col("min_num") + 1 == F.col("ndv")
        )
    )
    return [
        r["column_name"]
        for r in facts.select("column_name", "min_num", "min_text").collect()
        if _rises_by_one(p, r["column_name"], r["min_num"], r["min_text"], bucket)
    ]


def _whole(name: str) -> Column:
    """An integer beyond what a double or a difference of 64-bit integers can hold."""
    return F.col(name).try_cast("decimal(38,0)")


def _rises_by_one(p: Profile, name: str, low: float, low_text: str, bucket: int) -> bool:
    info = p.column(name)
    if info.family == INT:
        x = (F.col(quoted(name)).cast("decimal(38,0)") - F.lit(low_text).cast("decimal(38,0)")).cast("bigint")
    else:
        x = info.number() - F.lit(low)
    key = F.struct(*[F.col(quoted(c)) for c in p.order_by])
    rows = p.df.select(x.alias("x"), key.alias("k")).where("x IS NOT NULL")
    if info.family == FLOAT and not rows.where("x <> floor(x)").isEmpty():
        return False  # steps are not whole, so the buckets would not be bounded
    inside = Window.partitionBy("b").orderBy("x")
    across = Window.orderBy("b")  # one row per million rows
    buckets = (
        rows.withColumn("b", F.floor(F.col("x") / bucket))
        .withColumn("before", F.lag("k").over(inside))
        .groupBy("b")
        .agg(
            F.bool_or(F.col("before") >= F.col("k")).alias("falls"),
            F.min("k").alias("first"),
            F.max("k").alias("last"),
        )
        .withColumn("falls", F.coalesce("falls", F.lit(False)) | F.coalesce(F.lag("last").over(across) >= F.col("first"), F.lit(False)))
    )
    return not buckets.agg(F.bool_or("falls")).first()[0]


def row_diff(table: DataFrame | Profile, column: str) -> DataFrame:
    """Difference of a numeric column from the row before, in row order; null for the first row."""
    p = as_profile(table)
    keys = [quoted(c) for c in p.order_by]
    rows = p.df.select(*keys, p.column(column).number().alias("value"))
    text = p.order_by[-1] if keys and p.column(p.order_by[-1]).family == STRING else None
    stepped = previous_value(rows, [F.asc(k) for k in keys], "value", "before", text=text)
    return stepped.select(*keys, "value", (F.col("value") - F.col("before")).alias("difference"))


def semantic_types(table: DataFrame | Profile) -> DataFrame:
    """Semantic type per column, whether analyses leave it out, and why. The first rule that holds decides."""
    p = as_profile(table)
    if "semantics" not in p.__dict__:
        p.__dict__["semantics"] = pinned(_classified(p))
    return p.__dict__["semantics"]


def _classified(p: Profile) -> DataFrame:
    facts = p.counts.join(p.rule_counts.drop("column_name"), "ordinal").join(name_flags(p), "ordinal")
    kind, ndv, family = F.col("kind"), F.col("ndv"), F.col("family")
    sequential = F.col("column_name").isin(sequential_columns(p))
    unique = (F.col("n_rows") > 5) & (ndv == F.col("n_rows")) & kind.isin("object", "int")
    low, high = F.col("min_text"), F.col("max_text")
    two_tokens = (
        F.when(family == INT, (low == "0") & (high == "1"))
        .when(family == FLOAT, (low == "0.0") & (high == "1.0"))
        .otherwise(low.isin(*BOOLEAN_TOKENS) & high.isin(*BOOLEAN_TOKENS))
    )
    boolean = (kind == "bool") | ((ndv == 2) & F.coalesce(two_tokens, F.lit(False)))
    rules = [
        (sequential, "Identifier", "values rise by one from row to row"),
        (F.col("id_name"), "Identifier", "name looks like an identifier"),
        (unique, "Identifier", "every row has its own value"),
        (boolean, "Boolean", "two truth values"),
        (ndv == 2, "Binary", "two distinct values"),
        (F.col("target_name"), "Target Candidate", "name contains a target keyword"),
        (family == "datetime", "Datetime", "date or timestamp type"),
        ((kind == "int") & (ndv <= 5), "Ordinal", "integers with few distinct values"),
        (kind.isin("int", "float"), "Numerical", "numeric measurement"),
        (F.col("avg_len") > 35, "Text", "long strings"),
        (F.lit(True), "Categorical", "discrete values"),
    ]
    semantic = reason = F
    for condition, label, why in rules:
        semantic, reason = semantic.when(condition, label), reason.when(condition, why)
    return facts.select(
        "ordinal",
        "column_name",
        semantic.alias("semantic_type"),
        (semantic == "Identifier").alias("ignored"),
        reason.alias("reason"),
    )


def ignored_columns(p: Profile) -> set[str]:
    """Names of the identifier columns."""
    return {r["column_name"] for r in semantic_types(p).where("ignored").collect()}


def exclude_identifiers(table: DataFrame | Profile) -> DataFrame:
    """The table without its identifier columns."""
    p = as_profile(table)
    return p.df.drop(*ignored_columns(p))


def detect_target(table: DataFrame | Profile) -> DataFrame:
    """The likely target column and its task; no row when there is none.

    Among the columns that are not identifiers: the first one named like a target, else the first with two values,
    else the last one if it has two to ten.
    """
    p = as_profile(table)
    facts = (
        semantic_types(p)
        .where("NOT ignored")
        .join(p.counts.select("ordinal", "kind"), "ordinal")
        .join(p.rule_counts.select("ordinal", "ndv"), "ordinal")
        .join(name_flags(p), "ordinal")
    )
    chosen = facts.agg(
        F.min(F.when(F.col("target_name"), F.col("ordinal"))).alias("by_name"),
        F.min(F.when(F.col("ndv") == 2, F.col("ordinal"))).alias("by_values"),
        F.when(F.max_by("ndv", "ordinal").between(2, 10), F.max("ordinal")).alias("by_place"),
    ).select(
        F.coalesce("by_name", "by_values", "by_place").alias("ordinal"),
        F.when(F.col("by_name").isNotNull(), "name contains a target keyword")
        .when(F.col("by_values").isNotNull(), "two distinct values")
        .otherwise("last column with few distinct values")
        .alias("reason"),
    )
    regression = F.col("kind").isin("int", "float") & (F.col("ndv") > 10)
    return facts.drop("reason").join(F.broadcast(chosen), "ordinal").select(
        F.col("column_name").alias("target_column"),
        F.when(regression, "regression").otherwise("classification").alias("task_type"),
        "reason",
    )


def target_stats(table: DataFrame | Profile, column: str) -> DataFrame:
    """Mean, standard deviation, minimum and maximum of a numeric target."""
    p = as_profile(table)
    return p.moments.where(F.col("column_name") == column).select(
        F.col("column_name").alias("target_column"),
        rnd("mean", 4).alias("mean"),
        rnd("std", 4).alias("std"),
        rnd("min_num", 4).alias("min"),
        rnd("max_num", 4).alias("max"),
    )


def target_correlations(table: DataFrame | Profile, column: str) -> DataFrame:
    """Pearson correlation of every other numeric column with a numeric target, where it is defined."""
    from plumbline.plans.pairs import pearson

    p = as_profile(table)
    pairs = [(c, p.column(column)) for c in p.numeric if c.name != column]
    return pearson(p, pairs).where("r IS NOT NULL").select(
        F.col("column_a").alias("column_name"), rnd("r", 4).alias("correlation")
    )


def target_analysis(table: DataFrame | Profile) -> dict[str, DataFrame]:
    """Detected target with its class distribution or statistics, and its correlations."""
    p = as_profile(table)
    out = {"target": detect_target(p)}
    found = out["target"].first()
    if found is None:
        return out
    name = found["target_column"]
    if found["task_type"] == "regression":
        out["target_stats"] = target_stats(p, name)
    else:
        out["class_distribution"] = class_distribution(p, name)
    if p.column(name).is_numeric:
        out["target_correlations"] = target_correlations(p, name)
    return out
