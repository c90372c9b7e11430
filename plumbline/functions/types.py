"""How a Spark field is treated by the profiler.

``family`` depends on the declared type only. ``kind`` adds what a dataframe library that stores nulls as NaN would
make of the column: an integer column with nulls counts as float there, and a boolean column with nulls as object.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, FLOAT, BOOL, STRING, DATETIME, OTHER = "int", "float", "bool", "string", "datetime", "other"

# Strings longer than this enter a shuffle as their SHA-256 digest instead of in full.
DIGEST_OVER = 64


@dataclass(frozen=True)
class ColumnInfo:
    """One input column: its position, name, declared type and family."""

    ordinal: int
    name: str
    data_type: T.DataType
    family: str

    @property
    def is_numeric(self) -> bool:
        return self.family in (INT, FLOAT)

    @property
    def is_categorical(self) -> bool:
        return self.family in (STRING, BOOL)

    def value(self) -> Column:
        """The column with NaN read as missing."""
        c = F.col(quoted(self.name))
        if isinstance(self.data_type, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), c)
        return c

    def number(self) -> Column:
        """The column as a double, NaN read as missing. Booleans become 0 and 1."""
        if self.family == BOOL:
            return self.value().cast("int").cast("double")
        return self.value().cast("double")

    @property
    def number_sql(self) -> str:
        """``number()`` as SQL text."""
        c = quoted(self.name)
        if isinstance(self.data_type, (T.FloatType, T.DoubleType)):
            return f"if(isnan({c}), NULL, double({c}))"
        return f"double(int({c}))" if self.family == BOOL else f"double({c})"

    def fixed_bytes(self) -> int | None:
        """Bytes per non-null value, or None for types of varying length."""
        sizes = {
            T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
            T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
        }
        if isinstance(self.data_type, T.DecimalType):
            return 8 if self.data_type.precision <= 18 else 16
        return sizes.get(type(self.data_type))


def quoted(name: str) -> str:
    """A column name safe for ``F.col`` even with dots in it."""
    return "`" + name.replace("`", "``") + "`"


def family_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return INT
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def columns_of(df: DataFrame, names: list[str] | None = None) -> list[ColumnInfo]:
    wanted = None if names is None else set(names)
    return [
        ColumnInfo(i, f.name, f.dataType, family_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
        if wanted is None or f.name in wanted
    ]


def kind_of(family: Column, null_count: Column) -> Column:
    """``int``, ``float``, ``bool``, ``object`` or ``datetime`` for a column with this many nulls."""
    return (
        F.when((family == INT) & (null_count > 0), FLOAT)
        .when(family.isin(INT, FLOAT, DATETIME), family)
        .when((family == BOOL) & (null_count == 0), BOOL)
        .otherwise("object")
    )


def bounded_text(c: Column) -> Column:
    """A grouping key for a string: the string itself, or its digest when it is long."""
    return F.when(F.length(c) > DIGEST_OVER, F.sha2(c, 256)).otherwise(c)


def grouping_key(info: ColumnInfo) -> Column:
    """A bounded-size key that is equal exactly when two values are equal; null for a missing value."""
    c = info.value()
    if info.family == STRING:
        return bounded_text(c)
    if info.family == OTHER:
        return F.when(c.isNotNull(), F.sha2(F.to_json(F.struct(c.alias("v"))), 256))
    return c


def epoch_micros(info: ColumnInfo) -> Column:
    """A date or timestamp as microseconds since the epoch."""
    return F.unix_micros(F.col(quoted(info.name)).cast("timestamp"))
