"""Connected components by distributed union-find: forests in the tasks, then alternating large and small stars.

Each step is a grouped minimum (added up map-side) and a join of two stored tables, whose hot keys Spark splits. Nothing but
the answer whether more is to do reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the sets of ``i[k]`` and ``j[k]`` for all k; ``labels`` holds each element's smallest member, before and after."""
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node of its component among these links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    labels = np.arange(len(nodes))
    merge(labels, at[: len(a)], at[len(a) :])
    own = labels != np.arange(len(nodes))
    return nodes[own], nodes[labels[own]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node of ``links`` (two bigint columns, not null)."""
    u, v = links.columns
    now = stored(links.select(F.col(u).alias("u"), F.col(v).alias("v")).mapInArrow(_forests, "u bigint, v bigint").distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m")))
        # Large star: each larger neighbour hangs on the least of the neighbourhood.
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: each smaller neighbour, and the node itself, hang on the least neighbour.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        smaller = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(smaller.unionByName(least.withColumnRenamed("m", "v")).distinct())
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether each node hangs on one node at most, and no node on one that itself hangs."""
    ends = links.select("u", F.lit(1).alias("hangs")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("hangs")))
    each = ends.groupBy("u").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least"))
    return each.where("n > 1 OR (n = 1 AND least = 0)").isEmpty()
