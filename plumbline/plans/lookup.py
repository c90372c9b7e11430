"""Adding per-value facts to every row of a table, however the values are distributed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import quoted

# Most values, and bytes of their keys, that are broadcast.
BROADCAST_VALUES = 100_000
BROADCAST_BYTES = 16 << 20
# A value in more than 1/HOT_SHARE of the rows is hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 10_000


def lookup(df: DataFrame, keys: list[str], facts: DataFrame, broadcast_values: int = BROADCAST_VALUES,
           hot_share: int = HOT_SHARE) -> DataFrame:
    """Left join of ``df`` with ``facts``, which has one row per key and a column ``n``, the rows with that key.

    A small ``facts`` is broadcast. Otherwise only the hot keys are, whose number is bounded by what "hot" means, and
    the other rows are shuffled, where no key then has more than 1/``hot_share`` of the rows.
    """
    size = F.sum(sum((F.coalesce(F.octet_length(F.col(quoted(k)).cast("string")), F.lit(0)) for k in keys), F.lit(0)))
    found = facts.limit(broadcast_values + 1).agg(F.count(F.lit(1)).alias("values"), size.alias("bytes")).first()
    if found["values"] <= broadcast_values and (found["bytes"] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(facts), keys, "left").drop("n")
    known = reduce(lambda a, b: a & b, (F.col(quoted(k)).isNotNull() for k in keys))
    without_key = df.where(~known)  # no key, no facts: kept out of the shuffle, where they would meet in one task
    df, nothing = df.where(known), [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name not in (*keys, "n")]
    total = facts.agg(F.sum("n")).first()[0]
    hot = F.broadcast(facts.where(F.col("n") > total / hot_share))
    cold = facts.where(F.col("n") <= total / hot_share)
    hot_rows = df.join(hot, keys, "inner")
    other_rows = df.join(hot.select(*keys), keys, "left_anti").join(cold, keys, "left")
    return hot_rows.unionByName(other_rows).drop("n").unionByName(without_key.select("*", *nothing))
