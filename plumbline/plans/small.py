"""Frames whose size is bounded by the number of columns, held as local relations.

Only for frames with at most a few rows per *column* (or per pair of columns) of the profiled table, never for frames
that grow with its rows or distinct values. Spark folds and broadcasts local relations without starting tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
}


def pinned(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows."""
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def local(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A frame of the given rows; ``ddl`` names int, bigint, double, string and boolean columns."""
    schema = T.StructType.fromDDL(ddl)
    arrays = [pa.array([r[i] for r in rows], _ARROW[f.dataType.simpleString()]) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema=schema)
