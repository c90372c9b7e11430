"""Writing result frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.types import quoted


def _json_safe(field: T.StructField) -> Column:
    c = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c).alias(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.date_format(c, "yyyy-MM-dd").alias(field.name)
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, dates and timestamps as ISO text."""
    return df.select(*[_json_safe(f) for f in df.schema])


def write_report(sections: dict[str, DataFrame], path: str, format: str = "json") -> list[str]:
    """Write each section of a report to its own folder under ``path``."""
    written = []
    for name, df in sections.items():
        target = f"{path.rstrip('/')}/{name}"
        json_safe(df).write.mode("overwrite").format(format).save(target)
        written.append(target)
    return written
