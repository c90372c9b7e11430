"""Registering queries, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


class Source:
    """A table or a projection of one, written once for both engines."""

    def __init__(self, table: str, *columns: str, order_by: str | list[str] | None = None):
        self.table, self.columns, self.order_by = table, columns, order_by

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return df.selectExpr(*self.columns) if self.columns else df

    def profile(self, spark: SparkSession, sf_dir: str, **options):
        from plumbline.profile import Profile

        return Profile(self.frame(spark, sf_dir), order_by=self.order_by, **options)

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.columns) or '*'} FROM {self.table})"


LINEITEM = Source("lineitem", order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
ORDERS = Source("orders", order_by="o_orderkey")
CUSTOMER = Source("customer", order_by="c_custkey")
PART = Source("part", order_by="p_partkey")
EVENTS = Source("events", order_by="event_id")
DOCUMENTS = Source("documents", order_by="doc_id")
LABELS = Source("labels", order_by="doc_id")

# The tables hold no missing values, duplicates, infinities or constants, so these put some in.
GAPS = Source(
    "events",
    "event_id",
    "ts",
    "user_id",
    "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value",
    "CAST(NULL AS DOUBLE) AS nothing",
    order_by="event_id",
)
INFINITE = Source(
    "events",
    "event_id",
    "ts",
    "CASE WHEN event_id % 1000 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 1000 = 1 THEN CAST('-Infinity' AS DOUBLE)"
    " ELSE value END AS value",
    order_by="event_id",
)
REPEATED = Source("events", "user_id", "event_type")
REPEATED_BY_ID = Source("events", "event_id", "user_id", "event_type", order_by="event_id")
# Missing values, duplicates, a constant, a skewed column and a strongly correlated pair.
MIXED = Source(
    "events",
    "user_id AS visitor",
    "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(floor(value / 5) AS BIGINT) AS DOUBLE) END AS bucket",
    "CAST(CAST(floor(value / 5) AS BIGINT) * 2 + 1 AS DOUBLE) AS price",
    "1 AS k",
)
# Strong pairs of both signs.
PRICES = Source(
    "lineitem",
    "l_quantity",
    "l_extendedprice",
    "l_extendedprice * (1 - l_discount) AS net",
    "-l_extendedprice * (1 + l_tax) AS owed",
    "l_returnflag",
    "l_orderkey AS o",
    "l_linenumber AS n",
    order_by=["o", "n", "l_extendedprice", "net"],
)
