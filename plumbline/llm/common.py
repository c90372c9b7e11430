"""Helpers shared by the operators: columns picked by name, Arrow tasks, table paths, the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows, and about how many bytes of them, that a task turns into Python objects at a time.
AT_ONCE, BYTES_AT_ONCE = 500, 32 << 20

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(spec: str | StructType) -> StructType:
    return StructType.fromDDL(spec) if isinstance(spec, str) else spec


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict], dict]],
    out: str,
    rows_at_once: int = AT_ONCE,
    bytes_at_once: int = BYTES_AT_ONCE,
) -> DataFrame:
    """Run ``make()`` once per task and its result on the rows, ``rows_at_once`` at a time, fewer where they are long.

    The function gets the rows' columns as lists by name and returns lists by the names of ``out``.
    """
    arrow = to_arrow_schema(schema_of(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, min(rows_at_once, bytes_at_once * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = step({n: part.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def stored(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, written to the folder of ``spark.checkpoint.dir`` that all executors share."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def span_digest(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas, in the order they have."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_report(found: DataFrame, kinds: list[str], key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        key,
        *[number(k) for k in kinds],
        F.sha2(span_digest(base), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"),
    )
