"""Reading tables: formats, missing-value tokens, type inference, row order."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.fixed import MISSING_TOKENS
from plumbline.functions.types import quoted

CORRUPT = "_corrupt_record"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
_TRUTH = ("True", "False", "TRUE", "FALSE", "true", "false")


class EmptyTableError(ValueError):
    """The table has no rows or no columns."""


class MalformedTableError(ValueError):
    """The file has lines that do not fit the header, or bytes that are no text."""


class UnsupportedFormatError(ValueError):
    """No reader for this file extension."""


def format_of(path: str) -> str:
    """Reader for a path by its extension."""
    extension = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if extension not in READERS:
        raise UnsupportedFormatError(f"cannot read '{path}': use one of {', '.join(sorted(READERS))}")
    return extension


def read_table(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Read a table; CSV gets missing-value tokens and inferred types."""
    name = format or format_of(path)
    if name not in READERS:
        raise UnsupportedFormatError(f"unknown format '{name}': use one of {', '.join(sorted(READERS))}")
    return READERS[name](spark, path)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, row_index: str | None = None) -> DataFrame:
    """A CSV file with a header: text with missing tokens as null, then typed by what each whole column holds.

    The file is parsed once to check it, once to find the types, and again by whatever reads the result. ``row_index`` names a
    column to add with the row order.
    """
    text = read_csv_text(spark, path, multi_line)
    assert_well_formed(text)
    if row_index:
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
        text = text.select("*", place.alias(row_index))
    return infer_types(null_tokens(text.drop(CORRUPT)))


def assert_well_formed(text: DataFrame) -> None:
    """An error with the number of bad lines if any has more cells than the header, or bytes that cannot be decoded.

    Missing cells at the end of a line are missing values.
    """
    names = [f.name for f in text.schema if f.name != CORRUPT]
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    # A mark behind the line stands right behind its last cell, also where that is empty.
    parsed = F.from_csv(F.concat(F.col(CORRUPT), F.lit(",\u0001")), cells.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"'})
    fits = F.array_contains(F.array(*[parsed[f"c{i}"] for i in range(len(names) + 1)]), "\u0001")
    extra = F.col(CORRUPT).isNotNull() & ~F.coalesce(fits, F.lit(False))
    broken = F.lit(False)
    for n in names:
        broken = broken | F.coalesce(F.contains(F.col(quoted(n)), F.lit("\ufffd")), F.lit(False))
    found = text.agg(F.count_if(extra).alias("extra"), F.count_if(broken).alias("broken")).first()
    if found["extra"]:
        raise MalformedTableError(f"{found['extra']} lines have more cells than the header")
    if found["broken"]:
        raise MalformedTableError(f"{found['broken']} lines hold bytes that are not UTF-8")


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All cells as text. A line with too many or too few cells is kept, and also shown in ``_corrupt_record``.

    With ``multi_line`` quoted cells may hold line breaks, and one task reads each file; without it large files are split.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in _header(spark, path)] + [T.StructField(CORRUPT, T.StringType())])
    return spark.read.csv(
        path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=multi_line, escape='"'
    )


def _header(spark: SparkSession, path: str) -> list[str]:
    """The column names; a name that comes again gets a number, as in ``a``, ``a.1``."""
    shown = spark.read.csv(path, header=True, inferSchema=False, escape='"').columns
    if not shown:
        raise EmptyTableError(f"'{path}' has no header")
    raw = spark.read.csv(path, header=False, inferSchema=False, escape='"').first()
    names: list[str] = []
    for own, name in zip(raw, shown, strict=True):
        if own is None or raw.count(own) == 1:
            names.append(name)
            continue
        number = names.count(own)
        while own in names and (number == 0 or f"{own}.{number}" in names):
            number += 1
        names.append(f"{own}.{number}" if own in names else own)
    # Names that differ in capitals only cannot be told apart, and keep the numbers that Spark gives.
    return names if len({n.lower() for n in names}) == len(names) else shown


def corrupt_rows(text: DataFrame) -> DataFrame:
    """How many lines of a text frame did not fit the header."""
    return text.agg(F.count(CORRUPT).alias("corrupt_rows"), F.count(F.lit(1)).alias("n_rows"))


def null_tokens(df: DataFrame, tokens: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """String cells that hold a missing-value token become null."""
    return df.select(
        *[
            F.when(~F.col(quoted(f.name)).isin(*tokens), F.col(quoted(f.name))).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(quoted(f.name))
            for f in df.schema
        ]
    )


def _evidence(c: Column) -> dict[str, Column]:
    return {
        "n": F.count(c),
        "integer": F.count_if(c.rlike(_INTEGER) & F.trim(c).try_cast("bigint").isNotNull()),
        "digits": F.count_if(c.rlike(_INTEGER)),
        "number": F.count_if(c.rlike(_NUMBER)),
        "truth": F.count_if(c.isin(*_TRUTH)),
    }


def type_evidence(df: DataFrame) -> DataFrame:
    """Per string column: how many values read as integer, number and truth value, and the type that fits all.

    A column without values becomes double; whole numbers beyond 64 bits stay text. One scan decides from every row, not from a sample.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    aggs, rows = [], []
    for i, name in enumerate(texts):
        found = _evidence(F.col(quoted(name)))
        aggs += [e.alias(f"c{i}_{k}") for k, e in found.items()]
        rows.append(F.struct(F.lit(name).alias("column_name"), *[F.col(f"c{i}_{k}").alias(k) for k in found]))
    fits = (
        F.when(F.col("n") == 0, "double")
        .when(F.col("integer") == F.col("n"), "bigint")
        .when(F.col("digits") == F.col("n"), "string")
        .when(F.col("number") == F.col("n"), "double")
        .when(F.col("truth") == F.col("n"), "boolean")
        .otherwise("string")
    )
    return df.agg(*aggs).select(F.inline(F.array(*rows))).withColumn("inferred_type", fits).drop("digits")


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each string column to the narrowest type that all of its values fit."""
    if not any(isinstance(f.dataType, T.StringType) for f in df.schema):
        return df
    chosen = {r["column_name"]: r["inferred_type"] for r in type_evidence(df).collect()}
    return df.select(
        *[
            F.trim(F.col(quoted(f.name))).try_cast(chosen[f.name]).alias(f.name)
            if chosen.get(f.name, "string") != "string"
            else F.col(quoted(f.name))
            for f in df.schema
        ]
    )


def assert_nonempty(df: DataFrame) -> DataFrame:
    """The table itself, or an error if it has no columns or no rows."""
    if not df.columns:
        raise EmptyTableError("the table has no columns")
    if df.isEmpty():
        raise EmptyTableError("the table has no rows")
    return df


def with_row_index(spark: SparkSession, path: str, name: str = "row_idx") -> DataFrame:
    """A Parquet or CSV table with its row order: the file, and the row's place in it. Costs no shuffle."""
    if format_of(path) == "csv":
        return read_csv(spark, path, row_index=name)
    df = spark.read.parquet(path)
    return df.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(name))


READERS = {
    "csv": read_csv,
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path: spark.read.json(path),
    "orc": lambda spark, path: spark.read.orc(path),
}
