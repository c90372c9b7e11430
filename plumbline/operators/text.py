"""Free-text columns: lengths, vocabulary and common words. Whole texts are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rounding import rnd
from plumbline.functions.types import STRING, ColumnInfo
from plumbline.plans.small import local
from plumbline.profile import Profile, as_profile


# A column is no text when its mean length and mean number of words are both below these.
SHORT, FEW = 20, 3
# A word: three or more ASCII letters with no other word character beside them.
WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"
# A piece between white space, separators and separator control characters.
PIECE = r"[^\s\x1c-\x1f\x85\p{Z}]+"


def words(text: Column) -> Column:
    """The words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of pieces between white space."""
    return F.regexp_count(text, F.lit(PIECE))


def _strings(p: Profile) -> list[ColumnInfo]:
    """String columns with any value."""
    return [c for c in p.columns if c.family == STRING and p.count_rows[c.name]["non_null"]]


def _mean_words(p: Profile, columns: list[ColumnInfo]) -> dict[str, float]:
    if not columns:
        return {}
    row = p.df.agg(*[F.avg(word_count(c.value())).alias(f"w{c.ordinal}") for c in columns]).first()
    return {c.name: row[f"w{c.ordinal}"] for c in columns}


def _is_text(avg_length: float, avg_words: float) -> bool:
    return not (avg_length < SHORT and avg_words < FEW)


def text_gate(table: DataFrame | Profile) -> DataFrame:
    """Per string column: mean length, mean words, and whether it counts as text (not both short and few)."""
    p = as_profile(table)
    strings = _strings(p)
    n_words, rows = _mean_words(p, strings), []
    for c in strings:
        facts = p.count_rows[c.name]
        length, mean = facts["avg_len"], n_words[c.name]
        rows.append((c.name, length, facts["min_len"], facts["max_len"], mean, _is_text(length, mean)))
    schema = "column_name string, avg_length double, min_length bigint, max_length bigint, avg_words double, is_text boolean"
    return local(p.spark, rows, schema)


def _text_columns(p: Profile) -> list[str]:
    """Names of the text columns. Words are counted only where the mean length does not decide already."""
    if "text_columns" not in p.__dict__:
        lengths = {c.name: p.count_rows[c.name]["avg_len"] for c in _strings(p)}
        n_words = _mean_words(p, [p.column(n) for n, length in lengths.items() if length < SHORT])
        p.__dict__["text_columns"] = [n for n, length in lengths.items() if _is_text(length, n_words.get(n, 0.0))]
    return p.__dict__["text_columns"]


def text_lengths(table: DataFrame | Profile) -> DataFrame:
    """Mean, shortest and longest length in characters of each text column."""
    p = as_profile(table)
    return p.counts.where(F.col("column_name").isin(_text_columns(p))).select(
        "column_name", rnd("avg_len", 2).alias("avg_length"), F.col("min_len").alias("min_length"), F.col("max_len").alias("max_length")
    )


def word_counts(table: DataFrame | Profile) -> DataFrame:
    """``(column_name, word, n)``. Counts are added up before the shuffle, so common words are not hot keys."""
    p = as_profile(table)
    parts = [
        p.df.select(F.lit(c).alias("column_name"), F.explode(words(p.column(c).value())).alias("word"))
        for c in _text_columns(p)
    ]
    if not parts:
        return local(p.spark, [], "column_name string, word string, n bigint")
    long = reduce(DataFrame.unionByName, parts)
    return long.groupBy("column_name", "word").agg(F.count(F.lit(1)).alias("n"))


def text_vocabulary(table: DataFrame | Profile) -> DataFrame:
    """Different words per text column."""
    p = as_profile(table)
    counted = word_counts(p).groupBy("column_name").agg(F.count(F.lit(1)).alias("vocabulary_size"))
    texts = local(p.spark, [(c,) for c in _text_columns(p)], "column_name string")
    return texts.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("vocabulary_size", F.lit(0)).alias("vocabulary_size")
    )


def top_words(table: DataFrame | Profile, top: int = 10) -> DataFrame:
    """The most frequent words per text column; the smaller word on ties."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "word")
    ranked = word_counts(table).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top).select("column_name", "rank", "word", F.col("n").alias("count"))
