"""Documents that hold benchmark passages, by spaced seeds, in DataFrame operations only.

A mask says which tokens of a stretch are hashed and which are ignored, so a seed still hits where an ignored token was
replaced. Seeds of the benchmark meet seeds of the documents in a join; each hit lays the passage along the document, and
counts equal tokens: an overlap is reported where ``SHARE`` of some ``OVERLAP`` adjacent tokens (of all, in a shorter
passage) are equal. Passages shorter than the longest mask are hashed whole and reported where all their tokens are equal.

Tokens are runs of letters and digits in lower case. Null and empty texts and passages never match; texts are searched whole;
repeated rows give repeated results and repeated passages add none; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import unused

#: Tokens that count are marked 1. Together they hit every stretch of 15 tokens with up to 3 replaced ones, and every shorter
#: passage of 9 tokens or more with up to a fifth of them replaced, but for a few of 10: where there are any, one mask more finds those.
MASKS = ["11111", "1101101", "110010011", "10101011"]
MASK_FOR_TEN = "1100111"
OVERLAP, SHARE = 15, 0.8
#: Most bytes of seeds and passages that are sent to every task, and bytes reckoned for a seed; beyond it they are joined by shuffle.
SENT, SEED_BYTES = 64 << 20, 100
#: Places of a text whose hits are held at once: so many, or this share of a longer text.
PLACES, STRETCHES = 256, 64
NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """The tokens of a text; a text without any has one empty token."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), " ")


def seed(words: str, at: Column, mask: str, number: int) -> Column:
    """Hash of the tokens that ``mask`` marks from ``at`` on; null beyond the end."""
    picked = [F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when(picked[-1].isNotNull(), F.xxhash64(F.lit(number), *picked))


def whole(words: str, at: Column, length: int) -> Column:
    last = F.get(words, at + (length - 1))
    return F.when(last.isNotNull(), F.xxhash64(F.lit(-length), *[F.get(words, at + i) for i in range(length)]))


def seeded(rows: DataFrame, words: str, masks: list[str], short: list[int]) -> DataFrame:
    """A row for each seed: all columns of ``rows``, ``_at``, ``_seed`` and ``_mask``, its number."""
    at, last = F.col("_at"), F.size(words) - 1
    hashes = [seed(words, at, m, i) for i, m in enumerate(masks)] + [whole(words, at, n) for n in short]
    # Generated code holds what it makes of a row until that row is done. Spark runs transform() outside of it, a row at a time,
    # so only the hits of a stretch are held, not those of a whole text.
    long = F.greatest(F.lit(PLACES), F.expr(f"size({words}) div {STRETCHES}").cast("int"))
    cut = rows.select("*", long.alias("_long"))
    stretches = F.sequence(F.lit(0), F.expr(f"(size({words}) - 1) div _long").cast("int"))
    cut = cut.select("*", F.explode(F.transform(stretches, lambda k: k * F.col("_long"))).alias("_first"))
    placed = cut.select("*", F.explode(F.sequence("_first", F.least(F.col("_first") + F.col("_long") - 1, last))).alias("_at"))
    return placed.select("*", F.posexplode(F.array(*hashes)).alias("_mask", "_seed")).where("_seed IS NOT NULL").drop("_long", "_first")


def preceding(masks: list[str], short: list[int]) -> list[Column]:
    """``_span`` of a passage's seed, and ``_before``, the hash of as many tokens from one place before it; null at the first."""
    span = F.get(F.array(*[F.lit(n) for n in [*map(len, masks), *short]]), F.col("_mask"))
    return [span.alias("_span"), F.when(F.col("_at") > 0, F.xxhash64(F.slice("_passage", F.col("_at"), span))).alias("_before")]


def leads(words: str) -> Column:
    """Whether a hit is the first of its run: where all tokens of the place before are equal, that place's hit lays the passage alike."""
    before = F.when(F.col("_at") > 0, F.xxhash64(F.slice(words, F.col("_at"), F.col("_span"))))
    return F.col("_before").isNull() | before.isNull() | (before != F.col("_before"))


def laid(hits: DataFrame) -> DataFrame:
    """Each hit with ``_part`` of the text, along which the passage is laid from ``_skip`` on, in place of the text's ``_words``.

    The rows of one text are many, so they leave its words before they are joined to the passages.
    """
    begin = F.col("_at") - F.col("_item_at")
    skip = F.greatest(-begin, F.lit(0))
    common = F.least(F.col("_length"), F.size("_words") - begin) - skip
    return hits.select(
        "_id", "_hash", "_number", begin.alias("_begin"), skip.alias("_skip"), F.slice("_words", begin + skip + 1, common).alias("_part")
    )


def verified(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """``_equal`` and ``_compared`` tokens of each laid passage that holds a long enough overlap.

    Hits are verified where they are found, and only then made distinct, so a phrase that many texts share costs no shuffle.
    """
    beside = laid(hits).join(passages, "_number").withColumn("_width", F.least(F.lit(OVERLAP), F.size("_passage")))
    own = F.slice("_passage", F.col("_skip") + 1, F.size("_part"))
    same = beside.withColumn("_same", F.zip_with("_part", own, lambda x, y: (x == y).cast("int")))
    equal, compared, width = F.size(F.filter("_same", lambda x: x == 1)), F.size("_same"), F.col("_width")
    best = F.exists(
        F.sequence(F.lit(1), F.greatest(compared - width + 1, F.lit(1))),
        lambda i: F.aggregate(F.slice("_same", i, width), F.lit(0), lambda a, x: a + x) >= SHARE * width,
    )
    enough = F.when(width < max(map(len, MASKS)), equal == width).otherwise(
        (compared >= width) & ((equal >= SHARE * compared) | ((equal >= SHARE * width) & best))
    )
    kept = same.where(enough).select("_id", "_hash", "_item", "_number", "_begin", equal.alias("_equal"), compared.alias("_compared"))
    # An item, and a null one, may have several passages: each is laid on its own.
    return kept.distinct().withColumn("_begin", F.greatest("_begin", F.lit(0)))


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``key``, ``item`` and, of the best overlap, ``n_equal`` and ``n_compared`` tokens and ``start`` (a token number)."""
    found = hits(docs, benchmark, key, text, item, item_text)
    rank = F.struct(F.col("_equal").alias("e"), (-F.col("_compared")).alias("c"), (-F.col("_begin")).alias("b"))
    best = found.groupBy("_id", "_hash", "_item").agg(F.max(rank).alias("m"))
    copies = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"))
    on = best["_id"].eqNullSafe(copies["_id"]) & (best["_hash"] == copies["_hash"])
    return copies.join(best, on).select(
        copies["_id"].alias(key), F.col("_item").alias(item), F.col("m.e").alias("n_equal"), (-F.col("m.c")).alias("n_compared"),
        (-F.col("m.b")).alias("start"),
    )


def hits(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """Verified hits: ``_id``, ``_hash`` of the text, ``_item``, ``_equal``, ``_compared``, ``_begin``."""
    read = benchmark.select(F.col(item).alias("_item"), tokens(F.col(item_text)).alias("_passage")).distinct().where("_passage[0] <> ''")
    passages = read.withColumn("_number", F.xxhash64("_item", "_passage"))
    least, size = max(map(len, MASKS)), F.size("_passage")
    lengths = {r[0] for r in passages.where(size <= least + 1).select(size).distinct().collect()}
    short = sorted(n for n in lengths if n < least)
    masks = [*MASKS, *[MASK_FOR_TEN for n in lengths if n == 10]]
    # A whole-passage seed counts for passages of that length only; other seeds of short passages would do no harm.
    item_at = F.col("_at").alias("_item_at")
    seeds = seeded(passages, "_passage", masks, short).select("_seed", "_number", item_at, size.alias("_length"), *preceding(masks, short))
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), tokens(F.col(text)).alias("_words"))
    weight = size * (SEED_BYTES * (len(masks) + len(short)) + 16) + F.octet_length(F.array_join("_passage", ""))
    if (passages.agg(F.sum(weight.cast("long"))).first()[0] or 0) <= SENT:
        met = seeded(rows, "_words", masks, short).drop("_mask").join(F.broadcast(seeds), "_seed").where(leads("_words"))
        return verified(met, F.broadcast(passages)).select("_id", "_hash", "_item", "_equal", "_compared", "_begin")
    places = seeded(rows, "_words", masks, short).select("_id", "_hash", "_at", "_seed")
    met = places.join(seeds, "_seed")
    met = met.select("_id", "_hash", "_number", "_length", (F.col("_at") - F.col("_item_at")).alias("_shift")).distinct().alias("m")
    texts = rows.dropDuplicates(["_id", "_hash"]).alias("t")
    on = F.col("m._id").eqNullSafe(F.col("t._id")) & (F.col("m._hash") == F.col("t._hash"))
    found = met.join(texts, on).select("m._id", "m._hash", "_number", "_length", "_words", F.col("_shift").alias("_at"), F.lit(0).alias("_item_at"))
    return verified(found, passages).select("_id", "_hash", "_item", "_equal", "_compared", "_begin")


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns."""
    bad_id, bad_hash, hashed = unused(docs, "_id", "_hash", "_of")
    bad = hits(docs, benchmark, key, text, item, item_text).select("_id", "_hash").distinct().toDF(bad_id, bad_hash)
    rows = docs.withColumn(hashed, F.xxhash64(text))
    return rows.join(bad, rows[key].eqNullSafe(bad[bad_id]) & (rows[hashed] == bad[bad_hash]), "left_anti").drop(hashed)
