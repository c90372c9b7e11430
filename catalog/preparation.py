"""Preparation steps over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import EVENTS, GAPS, LINEITEM, MIXED, ORDERS, PART, PRICES, Source, query
from catalog.sql import r
from plumbline.functions.rounding import rnd
from plumbline.operators import prepare
from plumbline.plans.lookup import lookup


@query("drop_identifiers", "SELECT ts, event_type, value, props FROM events")
def drop_identifiers(spark, sf_dir):
    return prepare.drop_identifiers(EVENTS.profile(spark, sf_dir))


CONSTANTS = Source("lineitem", "l_orderkey", "l_linenumber", "1 AS k", "CAST(NULL AS DOUBLE) AS nothing", "l_returnflag")


@query("drop_constants", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def drop_constants(spark, sf_dir):
    return prepare.drop_constants(CONSTANTS.frame(spark, sf_dir))


@query(
    "impute_median",
    f"WITH g AS {GAPS.sql} SELECT event_id, ts, user_id, event_type, {r('COALESCE(value, (SELECT quantile_cont(value, 0.5) FROM g))')} AS value,"
    " nothing FROM g",
)
def impute_median(spark, sf_dir):
    return prepare.impute_median(GAPS.frame(spark, sf_dir)).withColumn("value", rnd("value", 4))


@query(
    "impute_mode",
    f"WITH g AS {GAPS.sql} SELECT event_id, COALESCE(event_type, (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1"
    " ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM g",
)
def impute_mode(spark, sf_dir):
    return prepare.impute_mode(GAPS.frame(spark, sf_dir).select("event_id", "event_type"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\"" for v in _PRIORITIES)
    + " FROM orders",
)
def one_hot(spark, sf_dir):
    return prepare.one_hot(ORDERS.frame(spark, sf_dir).select("o_orderkey", "o_orderpriority"), "o_orderpriority")


_USERS = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END"


@query(
    "one_hot_sparse",
    f"WITH src AS (SELECT event_id, {_USERS} AS u FROM events), codes AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS place"
    " FROM src WHERE u IS NOT NULL GROUP BY u) SELECT event_id, (SELECT count(*) FROM codes) AS size, place,"
    " CAST(place IS NOT NULL AS DOUBLE) AS ones FROM src LEFT JOIN codes USING (u)",
)
def one_hot_sparse(spark, sf_dir):
    """One place for each user, without a limit on their number."""
    df = EVENTS.frame(spark, sf_dir).selectExpr("event_id", f"{_USERS} AS u")
    v = F.col("u_one_hot")
    ones = F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x)
    return prepare.one_hot_sparse(df, "u").select(
        "event_id", v["size"].alias("size"), F.get(v["indices"], F.lit(0)).alias("place"), ones.alias("ones")
    )


@query(
    "frequency_encode",
    f"SELECT o_orderkey, o_custkey, {r('count(*) OVER (PARTITION BY o_custkey) / CAST(count(*) OVER () AS DOUBLE)', 8)} AS o_custkey_freq FROM orders",
)
def frequency_encode(spark, sf_dir):
    encoded = prepare.frequency_encode(ORDERS.frame(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_custkey")
    return encoded.withColumn("o_custkey_freq", rnd("o_custkey_freq", 8))


@query(
    "frequency_encode_hot",
    f"SELECT event_id, event_type, {r('count(*) OVER (PARTITION BY event_type) / 8.0')} AS n FROM events",
)
def frequency_encode_hot(spark, sf_dir):
    """The plan for many values, some of them hot: no more than those are broadcast."""
    df = EVENTS.frame(spark, sf_dir).select("event_id", "event_type")
    facts = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("eighth", F.col("n") / 8.0)
    return lookup(df, ["event_type"], facts, broadcast_values=2, hot_share=5).withColumnRenamed("eighth", "n")


# Whole prices, whose sums are exact in any order of addition.
WHOLE = Source("orders", "o_orderkey", "o_custkey", "CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) AS price")


@query("target_encode", f"SELECT o_orderkey, avg(price) OVER (PARTITION BY o_custkey) AS o_custkey_target FROM {WHOLE.sql}")
def target_encode(spark, sf_dir):
    encoded = prepare.target_encode(WHOLE.frame(spark, sf_dir), "o_custkey", "price")
    return encoded.select("o_orderkey", "o_custkey_target")


@query(
    "target_encode_folds",
    f"WITH f AS (SELECT o_orderkey, o_custkey, price, o_orderkey % 5 AS fold FROM {WHOLE.sql}), s AS (SELECT o_custkey, fold,"
    " sum(price) AS s, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT o_custkey, sum(s) AS s, sum(n) AS n FROM s GROUP BY ALL)"
    " SELECT o_orderkey, CASE WHEN t.n > s.n THEN (t.s - s.s) / (t.n - s.n) ELSE (SELECT avg(price) FROM f) END"
    " AS o_custkey_target FROM f JOIN s USING (o_custkey, fold) JOIN t USING (o_custkey)",
)
def target_encode_folds(spark, sf_dir):
    encoded = prepare.target_encode(WHOLE.frame(spark, sf_dir), "o_custkey", "price", F.expr("o_orderkey % 5"))
    return encoded.select("o_orderkey", "o_custkey_target")


@query("log1p_skewed", f"SELECT event_id, {r('ln(1 + value)', 6)} AS value FROM events")
def log1p_skewed(spark, sf_dir):
    logged = prepare.log1p_skewed(EVENTS.frame(spark, sf_dir).select("event_id", "value"))
    return logged.withColumn("value", rnd("value", 6))


_Z = "({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"


@query(
    "standard_scale",
    f"SELECT l_orderkey, l_linenumber, {r(_Z.format(c='l_quantity'), 6)} AS l_quantity, {r(_Z.format(c='l_extendedprice'), 6)} AS l_extendedprice"
    " FROM lineitem",
)
def standard_scale(spark, sf_dir):
    df = LINEITEM.frame(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaled = prepare.standard_scale(df, ["l_quantity", "l_extendedprice"])
    return scaled.withColumns({c: rnd(c, 6) for c in ("l_quantity", "l_extendedprice")})


@query(
    "date_parts",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,"
    " CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS o_orderdate_dayofweek, dayofweek(o_orderdate) IN (0, 6) AS o_orderdate_is_weekend FROM orders",
)
def date_parts(spark, sf_dir):
    parts = prepare.date_parts(ORDERS.frame(spark, sf_dir), "o_orderdate")
    return parts.select("o_orderkey", *[c for c in parts.columns if c.startswith("o_orderdate_")])


@query(
    "pair_ratio",
    f"WITH p AS {PRICES.sql} SELECT o, n, {r('l_extendedprice / net', 6)} AS l_extendedprice_net_ratio, {r('l_extendedprice / owed', 6)}"
    f" AS l_extendedprice_owed_ratio, {r('net / owed', 6)} AS net_owed_ratio FROM p",
)
def pair_ratio(spark, sf_dir):
    added = prepare.pair_ratio(PRICES.frame(spark, sf_dir))
    return added.select("o", "n", *[rnd(c, 6).alias(c) for c in added.columns if c.endswith("_ratio")])


@query(
    "bin_age",
    "SELECT p_partkey, p_size, CASE WHEN p_size < 13 THEN 'Child' WHEN p_size < 30 THEN 'Young Adult' WHEN p_size < 60 THEN 'Adult'"
    " ELSE 'Senior' END AS p_size_group FROM part",
)
def bin_age(spark, sf_dir):
    return prepare.bin_age(PART.frame(spark, sf_dir).select("p_partkey", "p_size"), "p_size")


@query(
    "bin_bmi",
    f"SELECT visitor, bucket, CASE WHEN bucket < 18.5 THEN 'Underweight' WHEN bucket < 25 THEN 'Normal' WHEN bucket < 30 THEN 'Overweight'"
    f" WHEN bucket IS NOT NULL THEN 'Obese' END AS bucket_category FROM {MIXED.sql}",
)
def bin_bmi(spark, sf_dir):
    return prepare.bin_bmi(MIXED.frame(spark, sf_dir).select("visitor", "bucket"), "bucket")
