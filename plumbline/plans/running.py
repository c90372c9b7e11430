"""Running totals over a globally sorted frame, without sorting it in one task."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.types import quoted

# Up to this many rows, and bytes of texts to sort by, a plain window in one task is the cheaper plan; the result is the same.
WINDOW_ROWS, WINDOW_BYTES = 200_000, 256 << 20
# Bins of texts (ACROSS * ACROSS), and texts that they are cut by.
ACROSS, SAMPLES = 32, 8_192


def ensure_checkpoint_dir(spark) -> None:
    """Use the session's ``spark.checkpoint.dir``; executors must share it, so none is made up where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared)


def _binned(df: DataFrame, text: str, rows: int, name: str) -> DataFrame:
    """Add ``name``: the number of the bin of ``text``, which rises with the text.

    Range partitions by whole texts would send a sample of texts to the driver. Here about ``SAMPLES`` of the ``rows`` texts, picked by
    their hash, are sorted in a task, and each cut between bins is shortened to what tells it from the text before it. Only
    the cuts reach the driver. Bins decide where a row is sorted, so results do not depend on them.
    """
    key = F.col(quoted(text))

    def cut(before, text):  # inside, so that executors need not have this module
        return text[: len(os.path.commonprefix([before, text])) + 1]

    one_in = max(1, rows // SAMPLES)
    sample = df.select(key.alias("t")).where(key.isNotNull() & (F.pmod(F.xxhash64(key), F.lit(one_in)) == 0))
    w = Window.orderBy("t")
    tiles = sample.select("t", F.lag("t").over(w).alias("before"), F.ntile(ACROSS * ACROSS).over(w).alias("tile"))
    first = tiles.withColumn("old", F.lag("tile").over(w)).where("old <> tile")
    cuts = sorted({r["cut"] for r in first.select(F.udf(cut, "string")("before", "t").alias("cut")).collect()})
    if not cuts:
        return df.withColumn(name, F.lit(0))
    parts = [cuts[i : i + ACROSS] for i in range(0, len(cuts), ACROSS)]
    ladder = df.sparkSession.createDataFrame([([p[0] for p in parts[1:]], parts)], "_heads array<string>, _parts array<array<string>>")

    def upto(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= key))

    number = F.col("_head") * ACROSS + upto(F.get("_parts", F.col("_head")))
    placed = df.crossJoin(F.broadcast(ladder)).withColumn("_head", upto(F.col("_heads"))).withColumn(name, number)
    return placed.drop("_heads", "_parts", "_head")


def _ranged(df: DataFrame, order: list[Column], window_rows: int, text: str | None) -> DataFrame | None:
    """``df`` in range partitions by ``order``, numbered as ``_part``, and checkpointed; None if it is small.

    The number must be the same for all that reads it, so the partitioned frame is checkpointed.
    """
    if text is None:
        if df.limit(window_rows + 1).count() <= window_rows:
            return None
        ensure_checkpoint_dir(df.sparkSession)
        dealt = df.repartitionByRange(*order)
    else:
        size = F.coalesce(F.sum(F.octet_length(F.col(quoted(text)))), F.lit(0))
        found = df.agg(F.count(F.lit(1)).alias("rows"), size.alias("bytes")).first()
        if found["rows"] <= window_rows and found["bytes"] <= WINDOW_BYTES:
            return None
        ensure_checkpoint_dir(df.sparkSession)
        dealt = _binned(df, text, found["rows"], "_bin").repartitionByRange(*order[:-1], F.asc("_bin")).drop("_bin")
    return dealt.withColumn("_part", F.spark_partition_id()).checkpoint()


def running_total(
    df: DataFrame, order: list[Column], value: str, name: str, window_rows: int = WINDOW_ROWS, *, text: str | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to this one in ``order`` (which must be total).

    A large frame is range-partitioned on the order. Each partition's total is summed first; the totals (one row per
    partition) are accumulated and joined back as offsets to running sums within the partitions. ``text`` names the column
    that the last of ``order`` sorts by, ascending, if it holds texts of any length.
    """
    ranged = _ranged(df, order, window_rows, text)
    if ranged is None:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(value).over(w))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.sum(value).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.sum(value).over(within) + F.col("_offset"))
        .drop("_part", "_offset")
    )


def previous_value(
    df: DataFrame, order: list[Column], value: str, name: str, window_rows: int = WINDOW_ROWS, *, text: str | None = None
) -> DataFrame:
    """Add ``name``: ``value`` of the row before this one in ``order`` (which must be total); ``text`` as for ``running_total``."""
    ranged = _ranged(df, order, window_rows, text)
    if ranged is None:
        return df.withColumn(name, F.lag(value).over(Window.orderBy(*order)))
    part = Window.partitionBy("_part")
    within = part.orderBy(*order)
    numbered = (
        ranged.withColumn(name, F.lag(value).over(within))
        .withColumn("_row", F.row_number().over(within))
        .withColumn("_rows", F.count(F.lit(1)).over(part))
    )
    # the last row of each partition, handed to the first row of the next one that is not empty
    last = numbered.where("_row = _rows")
    handed = last.select("_part", F.lag(value).over(Window.orderBy("_part")).alias("_handed"))
    return (
        numbered.join(F.broadcast(handed), "_part")
        .withColumn(name, F.when(F.col("_row") == 1, F.col("_handed")).otherwise(F.col(name)))
        .drop("_part", "_row", "_rows", "_handed")
    )

