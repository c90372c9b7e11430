"""The corpus pipeline: each stage applies an operator to what the stage before kept. The last gives the token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, lines, simhash, toxicity
from plumbline.llm.common import stored, table
from plumbline.llm.queries import RADIUS, REJECT, SHINGLE, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``REJECT``; labels of the held-out third are not learnt from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(toxicity.may_learn()))
    return toxicity.keep_clean(docs, model, threshold=REJECT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that are near copies of an earlier one; ``n_chars`` follows the text."""
    return with_length(lines.keep_first_lines(docs))


def with_length(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=SHINGLE, radius=RADIUS)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded``, the bytes that the ids stand for."""
    ranks, pattern = tokenizer()
    return bpe.decode(bpe.encode(docs, ranks, pattern), ranks)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_leaked),
    ("byte_bpe", to_tokens),
]

#: SQL cannot express shingle signatures, fingerprints or merges by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
