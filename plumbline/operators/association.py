"""How columns relate to one another."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed import MODERATE, OTHER_STRENGTH, PEARSON_STRENGTH, STRONG, WEAK
from plumbline.functions.rounding import rnd
from plumbline.operators.semantics import ignored_columns
from plumbline.plans import pairs as plan
from plumbline.plans.small import local, pinned
from plumbline.profile import Profile, as_profile


def _numeric(p: Profile, include_identifiers: bool):
    ignored = set() if include_identifiers else ignored_columns(p)
    return [c for c in p.numeric if c.name not in ignored]


def _pearson_pairs(p: Profile, include_identifiers: bool) -> DataFrame:
    """Unordered pairs with their unrounded r, at most once per profile."""
    cache = p.__dict__.setdefault("pearson_cache", {})
    if include_identifiers not in cache:
        columns = _numeric(p, include_identifiers)
        cache[include_identifiers] = plan.pearson(p, list(combinations(columns, 2)))
    return cache[include_identifiers]


def pearson_matrix(table: DataFrame | Profile, *, include_identifiers: bool = False) -> DataFrame:
    """Correlation of every ordered pair of numeric columns, the diagonal included; null where undefined.

    Pairs use the rows where both columns have a value. Identifier columns are left out, as is the whole result for
    fewer than two columns.
    """
    p = as_profile(table)
    columns = _numeric(p, include_identifiers)
    pairs = _pearson_pairs(p, include_identifiers).select("column_a", "column_b", "r")
    mirrored = pairs.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r")
    names = [c.name for c in columns] if len(columns) > 1 else []
    own = (
        p.counts.where(F.col("column_name").isin(names))
        .select(
            F.col("column_name").alias("column_a"),
            F.col("column_name").alias("column_b"),
            F.when((F.col("min_num") < F.col("max_num")) & (F.coalesce("infinite", F.lit(0)) == 0), 1.0).alias("r"),
        )
    )
    return (
        pairs.unionByName(mirrored)
        .unionByName(own)
        .select("column_a", "column_b", rnd("r", 4).alias("correlation"))
    )


def correlation_heatmap(table: DataFrame | Profile) -> DataFrame:
    """The correlation matrix with the identifier columns."""
    return pearson_matrix(table, include_identifiers=True)


def correlation_buckets(table: DataFrame | Profile) -> DataFrame:
    """Pairs whose rounded r is at least weak, in buckets, with the strength in words and the direction."""
    p = as_profile(table)
    found = _pearson_pairs(p, False).select("column_a", "column_b", rnd("r", 4).alias("correlation"))
    r = F.col("correlation")
    size = F.abs(r)
    bucket = (
        F.when(r >= STRONG, "strong_positive")
        .when(r <= -STRONG, "strong_negative")
        .when(size >= MODERATE, "moderate")
        .when(size >= WEAK, "weak")
    )
    return (
        found.withColumn("bucket", bucket)
        .where("bucket IS NOT NULL")
        .withColumn("strength", reading(r))
        .withColumn("direction", direction(r))
    )


def reading(r: Column) -> Column:
    """A correlation's strength in words."""
    size = F.abs(r)
    return (
        F.when(size >= 0.85, "very strong")
        .when(size >= STRONG, "strong")
        .when(size >= MODERATE, "moderate")
        .otherwise("weak")
    )


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")


def correlation_reading(table: DataFrame | Profile) -> DataFrame:
    """Strength, direction and a sentence for every defined pair."""
    found = _pearson_pairs(as_profile(table), False).where("r IS NOT NULL")
    r = rnd("r", 4)
    tendency = F.when(r > 0, "rises").otherwise("falls")
    return found.select(
        "column_a", "column_b", r.alias("correlation"), reading(r).alias("strength"), direction(r).alias("direction"),
        F.format_string("%s %s as %s rises (r = %.2f)", "column_b", tendency, "column_a", r).alias("interpretation"),
    )


def rank_pairs(table: DataFrame | Profile) -> DataFrame:
    """Bucketed pairs, strongest first within each bucket, and strong pairs ranked across both signs."""
    p = as_profile(table)
    ordinal = p.counts.select("ordinal", "column_name")
    found = (
        correlation_buckets(p)
        .join(ordinal.toDF("_a", "column_a"), "column_a")
        .join(ordinal.toDF("_b", "column_b"), "column_b")
    )
    # on ties: positives before negatives, then column order
    keys = [F.desc(F.abs("correlation")), F.desc("correlation"), "_a", "_b"]
    strong = F.col("bucket").startswith("strong")
    return found.select(
        "column_a", "column_b", "correlation", "bucket", "strength", "direction",
        F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)).alias("bucket_rank"),
        F.when(strong, F.row_number().over(Window.partitionBy(strong).orderBy(*keys))).alias("strong_rank"),
    )


def pair_pearson(table: DataFrame | Profile) -> DataFrame:
    """r of the pairs with more than two complete rows and two or more values on both sides."""
    p = as_profile(table)
    found = _pearson_pairs(p, False).where("n > 2 AND varies AND r IS NOT NULL")
    return found.select(
        "column_a", "column_b", "n", rnd("r", 4).alias("score"), strength(F.col("r"), PEARSON_STRENGTH).alias("strength")
    )


def strength(score: Column, cuts) -> Column:
    """Strength label of an unrounded score."""
    label = F
    for name, least in cuts:
        label = label.when(F.abs(score) >= least, name)
    return label.otherwise("Very Weak")


def crosstab(table: DataFrame | Profile, a: str, b: str) -> DataFrame:
    """Counts per pair of values; rows with a missing value on either side are left out."""
    p = as_profile(table)
    left, right = p.column(a).value(), p.column(b).value()
    return (
        p.df.select(left.alias("value_a"), right.alias("value_b"))
        .where("value_a IS NOT NULL AND value_b IS NOT NULL")
        .groupBy("value_a", "value_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cramers_v(table: DataFrame | Profile, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cramer's V of pairs of columns, read as categories."""
    p = as_profile(table)
    found = plan.cramers_v(p, [(p.column(a), p.column(b)) for a, b in pairs])
    return found.select(
        "column_a", "column_b", "n", rnd("v", 4).alias("score"), strength(F.col("v"), OTHER_STRENGTH).alias("strength")
    )


def correlation_ratio(table: DataFrame | Profile, categories: list[str], numbers: list[str]) -> DataFrame:
    """Eta (not squared) of each category column against each numeric column."""
    p = as_profile(table)
    found = plan.correlation_ratio(p, [p.column(c) for c in categories], [p.column(c) for c in numbers])
    return found.select(
        "category", "number", "n", rnd("eta", 4).alias("score"), strength(F.col("eta"), OTHER_STRENGTH).alias("strength")
    )


def feature_relationships(table: DataFrame | Profile) -> DataFrame:
    """Every column that is not an identifier against every other column.

    Numbers against numbers by Pearson, categories against categories by Cramer's V, and mixed pairs by eta. Each
    unordered pair is computed once and mirrored. Identifiers are listed without a score, after the others.
    """
    p = as_profile(table)
    if "relationships" not in p.__dict__:
        p.__dict__["relationships"] = pinned(_relationships(p))
    return p.__dict__["relationships"]


def _relationships(p: Profile) -> DataFrame:
    ignored = ignored_columns(p)
    used = [c for c in p.columns if c.name not in ignored]
    numbers = [c for c in used if plan.is_number(p, c)]
    others = [c for c in used if not plan.is_number(p, c)]

    linear = plan.pearson(p, list(combinations(numbers, 2))).where("n > 2 AND varies AND r IS NOT NULL")
    parts = [
        linear.select(
            "column_a", "column_b", F.lit("pearson").alias("metric"), F.col("r").alias("score"),
            strength(F.col("r"), PEARSON_STRENGTH).alias("strength"),
        )
    ]
    if len(others) > 1:
        v = plan.cramers_v(p, list(combinations(others, 2)))
        parts.append(
            v.select(
                "column_a", "column_b", F.lit("cramers_v").alias("metric"), F.col("v").alias("score"),
                strength(F.col("v"), OTHER_STRENGTH).alias("strength"),
            )
        )
    if others and numbers:
        eta = plan.correlation_ratio(p, others, numbers)
        everything = local(p.spark, 
            [(a.name, b.name) for a in others for b in numbers], "category string, number string"
        )
        # a pair without a complete row has no group to report, and scores zero
        eta = everything.join(eta, ["category", "number"], "left").withColumn("eta", F.coalesce("eta", F.lit(0.0)))
        parts.append(
            eta.select(
                F.col("category").alias("column_a"), F.col("number").alias("column_b"),
                F.lit("eta").alias("metric"), F.col("eta").alias("score"),
                strength(F.col("eta"), OTHER_STRENGTH).alias("strength"),
            )
        )
    once = parts[0]
    for part in parts[1:]:
        once = once.unionByName(part)
    once = pinned(once)
    mirror = once.select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "metric", "score", "strength"
    )
    both = once.unionByName(mirror)
    left_out = local(p.spark, 
        [(c.name, i) for c in used for i in sorted(ignored)], "column_a string, column_b string"
    ).select(
        "column_a", "column_b", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("score"),
        F.lit("Identifier").alias("strength"),
    )
    place = p.counts.select(F.col("column_name").alias("column_b"), F.col("ordinal").alias("_b"))
    order = Window.partitionBy("column_a").orderBy(F.abs(rnd("score", 4)).desc_nulls_last(), "_b")
    return (
        both.unionByName(left_out)
        .join(place, "column_b")
        .select(
            F.col("column_a").alias("column_name"), F.col("column_b").alias("feature"), "metric",
            rnd("score", 4).alias("score"), "strength", F.row_number().over(order).alias("rank"),
        )
    )


def top_relations(table: DataFrame | Profile, top: int = 2) -> DataFrame:
    """Per column, the strongest relations that are at least moderate."""
    found = feature_relationships(table).where(F.col("strength").isin("Very Strong", "Strong", "Moderate"))
    w = Window.partitionBy("column_name").orderBy("rank")
    return (
        found.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= top)
        .select("column_name", "place", "feature", "metric", "score", "strength")
    )
