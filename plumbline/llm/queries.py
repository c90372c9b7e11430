"""The operators applied to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, fingerprint, infill, language, lines, ngram_join, pii, repeats, runs, secrets, simhash, toxicity
from plumbline.llm.common import span_report, table

#: Shingle length in words and most differing bits of near copies; words of a repeated passage; least score of a rejected text.
SHINGLE, RADIUS, WINDOW, REJECT = 3, 3, 35, 0.7
VOCABULARY = "byte_bpe_50k.tiktoken"


def tokenizer(name: str = VOCABULARY) -> tuple[str, str]:
    """The rank file and the pattern of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.KINDS)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.learn(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(toxicity.may_learn()))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(~toxicity.may_learn(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence"
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.likeness_report(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"), words=SHINGLE, radius=RADIUS)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), window=WINDOW)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(infill.restored("output", "form"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256")
    )


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (words joined by a space), a tenth of the texts periodic from some word on."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    hashed = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", words.alias("words"), hashed.alias("h")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.expr("try_mod(h div 10, n)").cast("int"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)").cast("int"))
    whole = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), F.expr("CAST((n - a) div p + 1 AS int)")))
    periodic = F.concat(F.expr("slice(words, 1, a)"), F.slice(whole, F.lit(1), F.expr("n - a")))
    planted = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), periodic).otherwise(F.col("words"))
    return rows.select("doc_id", F.array_join(planted, " ").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines_, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS s,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), draws AS (
    SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
           ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4
    FROM units
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM draws
), parts AS (
    SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS x FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
                        ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_language_id, op3_toxicity, op4_pii, op5_fingerprints, op6_simhash_dedup, op7_substring_dedup, op8_bpe,
        op9_line_dedup, op10_decontamination, op11_ngram_join, op12_fill_in_middle, op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = {"op12_fill_in_middle": OP12_SQL}
