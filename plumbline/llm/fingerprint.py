"""SimHash fingerprints in DataFrame operations only, and their search by permuted block tables.

The terms of a text are its pairs of adjacent words (its only word, if it has one), in lower case. Each occurrence votes on the
64 bits of its hash with the weight of its length in characters, at most ``HEAVIEST``, since long terms tell more. A bit is set
if the votes for it outweigh those against it. The votes of two bits are summed in the halves of one integer, and a text's sums are
added up in the task that splits it, so that a row per text is shuffled, not a row per word.

Null and empty texts, and texts without a word, have fingerprint zero. Texts of any length add up row by row. Repeated rows give
repeated results. Only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, HALF = 64, 32
HEAVIEST = 24
LANES = (1 << HALF) | 1
LOW = (1 << HALF) - 1
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Documents of a stretch of the key order, and the most stretches.
STRETCH, STRETCHES = 400, 4_000


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``print`` of the texts of ``rows``; rows alike in ``keys`` must have one text and give one row."""
    at = F.col("_at")
    words = rows.select(*keys, F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD, " ")), " ").alias("_words"))
    each = words.select(*keys, "_words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_words") - 2, F.lit(0)))).alias("_at"))
    first, second = F.get("_words", at), F.get("_words", at + 1)
    length = F.length(first) + F.coalesce(F.length(second), F.lit(0))
    hashed = each.select(
        *keys, F.xxhash64(first, second).alias("_h"), F.least(length, F.lit(HEAVIEST)).cast("long").alias("_w")
    )
    lane = [F.sum(F.shiftright("_h", i).bitwiseAND(F.lit(LANES)) * F.col("_w")).alias(f"_s{i}") for i in range(HALF)]
    sums = hashed.groupBy(*keys).agg(F.sum("_w").alias("_all"), *lane)
    bits = None
    for i in range(HALF):
        for votes_for, bit in ((F.col(f"_s{i}").bitwiseAND(F.lit(LOW)), i), (F.shiftright(f"_s{i}", HALF), i + HALF)):
            one = F.when(votes_for * 2 > F.col("_all"), F.lit((1 << bit) - (1 << 64) * (bit == 63))).otherwise(F.lit(0))
            bits = one if bits is None else bits.bitwiseOR(one)
    return sums.select(*keys, bits.alias("print"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``print`` (bigint, the bits as two's complement) of every row."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_a"), F.hash(text).alias("_b"))
    same = ["_id", "_a", "_b"]
    # Equal rows add up to twice the votes, which set the same bits; their number is kept.
    prints = votes(rows, same, "_text").alias("p")
    counted = rows.groupBy(*same).agg(F.count("*").alias("_n")).alias("c")
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in same]
    joined = prints.join(counted, on[0] & on[1] & on[2])
    return joined.select(F.col("p._id").alias(key), "print", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(key, "print")


def as_text(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), BITS // 4, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_tables(radius: int, blocks: int) -> list[int]:
    """Masks of the tables: all choices of ``blocks - radius`` of the blocks, one of which any near pair must share."""
    cuts = [sum(1 << b for b in range(BITS * i // blocks, BITS * (i + 1) // blocks)) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(cuts, blocks - radius)]


def within(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Pairs (``query``, ``print``, ``distance``) of different fingerprints at most ``radius`` bits apart, found in every block table.

    Both inputs have a column ``print``; each distinct value counts once, so copies add no pairs.
    """
    masks = [m - (1 << 64) * (m >> 63) for m in block_tables(radius, blocks)]

    def entries(df: DataFrame, name: str) -> DataFrame:
        tables = [F.xxhash64(F.lit(i), F.col(name).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
        return df.select(F.col("print").alias(name)).where(f"{name} IS NOT NULL").distinct().select(name, F.explode(F.array(*tables)).alias("_table"))

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("print")))
    found = entries(queries, "query").join(entries(prints, "print"), "_table").where((distance <= radius) & (F.col("query") != F.col("print")))
    return found.select("query", "print", distance.alias("distance")).distinct()


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row beside its edited text: ``_stretch`` and ``_n`` (its place), ``_id``, ``_text``, ``_edited``, ``_guest``.

    The last half of a text gives way to as many code points of the next one's beginning, in descending order of ``key`` (rows
    of one key by text, null keys last, the first row after the last). The order is cut into stretches of about ``STRETCH`` rows;
    each stretch also holds the first row of the one after it as a guest. The driver gets the bounds of the stretches only.
    """
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    total = docs.count()
    parts = max(1, min(STRETCHES, total // STRETCH))
    bounds = sorted(set(rows.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        cut = Bucketizer(splits=splits, inputCol="_double", outputCol="_bucket", handleInvalid="keep")
        # Stretches are numbered from the largest keys down; null keys come last.
        placed = cut.transform(rows.withColumn("_double", F.col("_id").cast("double"))).withColumn(
            "_stretch", F.when(F.col("_id").isNull(), F.lit(len(splits))).otherwise(len(splits) - 2 - F.col("_bucket")).cast("int")
        ).drop("_double", "_bucket")
    else:
        placed = rows.withColumn("_stretch", F.when(F.col("_id").isNull(), 1).otherwise(0))
    tops = {r["_stretch"]: r["top"] for r in placed.groupBy("_stretch").agg(F.max("_id").alias("top")).collect()}
    order = sorted(tops)
    spark = docs.sparkSession
    visits = spark.createDataFrame(
        [(s, tops[s], order[i - 1]) for i, s in enumerate(order)], "_stretch int, _top bigint, _visits int"
    )
    first = Window.partitionBy("_stretch").orderBy("_text")
    guests = (
        placed.join(F.broadcast(visits), "_stretch").where(F.col("_id").eqNullSafe(F.col("_top")))
        .withColumn("_n", F.row_number().over(first)).where("_n = 1")
        .select("_id", "_text", F.col("_visits").alias("_stretch"), F.lit(True).alias("_guest"))
    )
    line = Window.partitionBy("_stretch").orderBy("_guest", F.desc_nulls_last("_id"), "_text")
    both = placed.withColumn("_guest", F.lit(False)).unionByName(guests)
    paired = both.select("*", F.row_number().over(line).alias("_n"), F.lead("_text").over(line).alias("_next"))
    length = F.length("_text")
    gone = F.floor(length / 2).cast("int")
    joined = F.concat(F.substring("_text", F.lit(1), length - gone), F.substring("_next", F.lit(1), gone))
    return paired.select("_stretch", "_n", "_id", "_guest", "_text", F.when(~F.col("_guest"), joined).alias("_edited"))


def likeness_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to each other and to the next text's."""
    form = F.struct
    forms = edited(docs, key, text).select(
        "_stretch", "_n", "_id", "_guest",
        F.explode(F.array(
            form(F.lit(0).alias("kind"), F.col("_text").alias("text"), F.lit("").alias("sha")),
            form(F.lit(1).alias("kind"), F.col("_edited").alias("text"), F.sha2(F.col("_edited"), 256).alias("sha")),
        )).alias("f"),
    ).select("_stretch", "_n", "_id", "_guest", "f.kind", "f.text", "f.sha", F.length("f.text").alias("_chars")).where("text IS NOT NULL")
    prints = votes(forms, ["_stretch", "_n", "_id", "_guest", "kind", "sha", "_chars"], "text")
    place = Window.partitionBy("_stretch").orderBy("_n", "kind")
    # A row's two forms lie side by side, the next row's text after them.
    beside = prints.select(
        "*", F.lead("print").over(place).alias("_edited"), F.lead("sha").over(place).alias("_sha"), F.lead("print", 2).over(place).alias("_next")
    ).where("kind = 0 AND NOT _guest")
    return beside.select(
        F.col("_id").alias(key),
        F.col("_chars").cast("long").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("print"), F.col("_next")).alias("near_next"),
    )
