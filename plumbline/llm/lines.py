"""Lines that are near copies of each other, anywhere in the corpus: MinHash, exact Jaccard, union-find.

A line's signature is the least values of its character shingles under ``BANDS * ROWS`` hash functions; lines that agree on all rows
of a band share a bucket. In every bucket each line is compared with one of them, the exact Jaccard similarity of the shingle
sets deciding. Then buckets whose lines still lie in different components are compared line by line across components, large ones
in blocks, so that no similar pair that shares a bucket stays apart. Components come from a distributed union-find over these links and
the copies; the first line of each by document key, text hash and line number stays.

Lines end at line feeds. Blank lines are not compared and stay. Null and empty texts have no lines to lose; a null text stays null.
Lines shorter than a shingle are one shingle. Rows alike in key and text cannot be told apart and lose the same lines. Line ids
are 64-bit hashes of the whole line. Of the input only the named columns are read, except by ``keep_first_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows, stored, unused
from plumbline.llm.components import components

#: Characters of a shingle, least similarity, and a banding that finds 99.9 % of pairs at that similarity. One replaced
#: character touches up to 8 shingles, so that a line needs 79 characters to stay at 0.8 wherever it is.
SHINGLE, SIMILAR, BANDS, ROWS = 8, 0.8, 10, 3
#: Characters whose signatures are made at a time; lines of a block in a large
#: bucket; bits that stand for a line's shingles; lines whose bits are made at a time.
CHARS, BLOCK, BITMAP, AT_ONCE = 1 << 20, 400, 2_048, 1_024
#: Words of a bitmap that are compared first, and pairs of lines that are compared by bitmaps at a time.
HEAD, PAIRS = 8, 1 << 14
#: Characters of lines whose shingle sets a task remembers; it forgets them all when there are more.
KEPT = 1 << 20
#: Ids that a task remembers as signed; it forgets them all when there are more, and signs such a line once more.
REMEMBERED = 1 << 18

_random = np.random.default_rng(9)
SHINGLE_FACTORS = _random.integers(1, 1 << 32, SHINGLE, np.uint32) | np.uint32(1)
FACTORS = _random.integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
KEY_FACTORS = _random.integers(1, 1 << 63, ROWS + 1, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every shingle of the lines, which are not empty, and where each line's begin."""
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    sizes = np.array([len(x) for x in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = np.zeros(len(codes) - SHINGLE + 1, np.uint32)
    for i, factor in enumerate(SHINGLE_FACTORS):
        hashes += codes[i : i + len(hashes)] * factor
    # Shingles that reach into the next line are left out.
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    for i in range(1, SHINGLE):
        inside[ends - i] = False
    return mixed(hashes[inside[: len(hashes)]]), np.cumsum(sizes - SHINGLE + 1) - (sizes - SHINGLE + 1)


def band_keys(lines: list[str]) -> np.ndarray:
    """A row of band keys for each line."""
    hashes, starts = shingle_hashes(lines)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64) * KEY_FACTORS[ROWS]
        for row in range(ROWS):
            least = np.minimum.reduceat(hashes * FACTORS[band * ROWS + row], starts)
            key = (key ^ least) * KEY_FACTORS[row]
            key ^= key >> np.uint64(31)
        keys[:, band] = key
    return keys.view(np.int64)


def bitmaps(lines: list[str]) -> list[bytes]:
    """For each line ``BITMAP`` bits, those set that some shingle's hash names."""
    hashes, starts = shingle_hashes(lines)
    counts = np.diff(np.append(starts, len(hashes)))
    bits = np.zeros((len(lines), BITMAP), bool)
    bits[np.repeat(np.arange(len(lines)), counts), hashes % np.uint32(BITMAP)] = True
    return [row.tobytes() for row in np.packbits(bits, axis=1)]


def may_be(apart: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> np.ndarray:
    """False only if lines of those lengths, whose bitmaps differ in ``apart`` bits, are surely not similar.

    Each bit in which the bitmaps differ stands for a shingle of one line alone, and similar lines have few of those: the
    symmetric difference is at most (1 - s) / (1 + s) of the sets' sizes together, which the lengths bound.
    """
    most = np.maximum(1, lengths - SHINGLE + 1) + np.maximum(1, others - SHINGLE + 1)
    return apart * (1 + SIMILAR) <= (1 - SIMILAR) * most + 1e-9


def stacked(bits: list[bytes]) -> np.ndarray:
    """A row of 64-bit words for each bitmap."""
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), BITMAP // 64)


def apart_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of ``stacked`` differ."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def may_be_similar(a: str, b: str, bits_a: bytes, bits_b: bytes) -> bool:
    """``may_be`` for one pair of lines."""
    apart = apart_in(stacked([bits_a]), stacked([bits_b]))
    return bool(may_be(apart, np.array([len(a)]), np.array([len(b)]))[0])


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: set[str], b: set[str]) -> bool:
    """Whether the exact Jaccard similarity reaches ``SIMILAR``."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    common = len(a & b)
    return common >= SIMILAR * (len(a) + len(b) - common)


def numbered_shingles(line: str) -> np.ndarray | None:
    """The shingles as sorted 64-bit numbers, one for each string of ``SHINGLE`` = 8 Latin-1 characters; None if they don't fit."""
    try:
        data = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(data) < SHINGLE:
        return None
    numbers = np.sort(np.ndarray(len(data) - SHINGLE + 1, np.uint64, data, strides=(1,)))
    return np.concatenate((numbers[:1], numbers[1:][numbers[1:] != numbers[:-1]]))


class ShingleSets:
    """Compares lines by their exact shingle sets, as numbers where both lines have them, which are made once for lines met again."""

    def __init__(self):
        self.numbers: dict[str, np.ndarray | None] = {}
        self.size = 0

    def of(self, line: str) -> np.ndarray | None:
        if line not in self.numbers:
            if self.size > KEPT:
                self.numbers.clear()
                self.size = 0
            self.numbers[line] = numbered_shingles(line)
            self.size += len(line)
        return self.numbers[line]

    def similar(self, a: str, b: str) -> bool:
        x, y = self.of(a), self.of(b)
        if x is None or y is None:
            return similar(shingles(a), shingles(b))
        if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
            return False
        both = np.sort(np.concatenate((x, y)))
        common = np.count_nonzero(both[1:] == both[:-1])
        return common >= SIMILAR * (len(x) + len(y) - common)


def line_id(line: str) -> int:
    import xxhash

    value = xxhash.xxh3_64_intdigest(line.encode())
    return value - (value >> 63 << 64)


def _occurrences(rows: DataFrame) -> DataFrame:
    """A row for each line that is not blank: ``id``, ``_id``, ``_hash``, ``line``, and ``keys`` once for each id that a task remembers."""
    kind = rows.schema["_id"].dataType.simpleString()

    def make():
        signed: set[int] = set()

        def step(batch: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("id", "_id", "_hash", "line")}
            keys: list = []
            new: dict[int, str] = {}
            at: dict[int, int] = {}
            size = 0

            def sign() -> None:
                nonlocal size
                if new:
                    for i, row in zip(new, band_keys(list(new.values())).tolist(), strict=True):
                        keys[at[i]] = row
                new.clear()
                size = 0

            for key, same, text in zip(batch["_id"], batch["_hash"], batch["_text"], strict=True):
                for n, line in enumerate(text.split("\n") if text else ()):
                    if not line or line.isspace():
                        continue
                    i = line_id(line)
                    if i not in signed:
                        signed.add(i)
                        at[i], new[i] = len(keys), line
                        size += len(line)
                    for c, v in zip(out.values(), (i, key, same, n), strict=True):
                        c.append(v)
                    keys.append(None)
                    if size >= CHARS:
                        sign()
            sign()
            if len(signed) > REMEMBERED:
                signed.clear()
            return out | {"keys": keys}

        return step

    return map_rows(rows, make, f"id bigint, _id {kind}, _hash bigint, line int, keys array<bigint>")


def _buckets(keyed: DataFrame) -> DataFrame:
    """From rows (key, id): ``key``, ``id`` and the bucket's first id, for every other id of a bucket.

    Most keys have one id. The rows are shuffled once, for the keys with several ids and for their members.
    """
    # With the filters that the join asks for on both sides, they share one exchange.
    dealt = keyed.where("key IS NOT NULL AND id IS NOT NULL").repartition("key")
    shared = dealt.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    return dealt.join(shared.drop("last").hint("shuffle_hash"), "key").where("id <> first").dropDuplicates(["key", "id"])


def _fetched(rows: DataFrame, occurrences: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``text`` and ``bits`` of the lines ``ids``."""
    once = occurrences.where("keys IS NOT NULL").join(ids, "id", "left_semi").dropDuplicates(["id"])
    wanted = once.groupBy("_id", "_hash").agg(F.collect_list(F.struct("id", "line")).alias("wanted"))
    right = wanted.select(F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash"), "wanted")
    texts = rows.join(right, rows["_id"].eqNullSafe(right["_rid"]) & (rows["_hash"] == right["_rhash"])).select("_text", "wanted")

    def make():
        def step(batch: dict) -> dict:
            got: dict[int, str] = {}
            for text, asked in zip(batch["_text"], batch["wanted"], strict=True):
                split = text.split("\n")
                got |= {w["id"]: split[w["line"]] for w in asked}
            found = list(got.values())
            bits: list[bytes] = []
            for at in range(0, len(found), AT_ONCE):
                bits += bitmaps(found[at : at + AT_ONCE])
            return {"id": list(got), "text": found, "bits": bits}

        return step

    # Rows alike in key and text answer more than once.
    return map_rows(texts, make, "id bigint, text string, bits binary").dropDuplicates(["id"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("id").alias("u"), F.col("text").alias("a"), F.col("bits").alias("c"))
    b = texts.select(F.col("id").alias("v"), F.col("text").alias("b"), F.col("bits").alias("d"))

    def make():
        sets = ShingleSets()

        def step(batch: dict) -> dict:
            a, b = batch["a"], batch["b"]
            lengths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
            may = may_be(apart_in(stacked(batch["c"]), stacked(batch["d"])), *lengths)
            kept = [i for i in np.flatnonzero(may).tolist() if sets.similar(a[i], b[i])]
            return {"u": [batch["u"][i] for i in kept], "v": [batch["v"][i] for i in kept]}

        return step

    return map_rows(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b", "c", "d"), make, "u bigint, v bigint")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components among the rows (key, i, j, id, part, block, text, bits) of each (key, i, j), side by side."""
    held: list[tuple] = []
    now = None
    sets = ShingleSets()

    def found() -> list[tuple[int, int]]:
        i, j = now[1:]
        ids, part, block, texts, bitmaps_ = zip(*held, strict=True)
        numbers: dict[int, int] = {}
        label = np.array([numbers.setdefault(x, len(numbers)) for x in part])
        if len(numbers) == 1:
            return []
        blocks, bits = np.array(block), stacked(bitmaps_)
        head = np.ascontiguousarray(bits[:, :HEAD])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        out, n = [], len(held)
        step = max(1, PAIRS // n)
        for at in range(0, n - 1, step):
            mine = np.arange(at, min(at + step, n - 1))
            open_ = (mine[:, None] < np.arange(n)) & (label[mine][:, None] != label)
            if i != j:
                open_ &= blocks[mine][:, None] != blocks
            a, b = np.nonzero(open_)
            a += at
            # Too many differing bits in the first words already rule most lines out.
            for words in (head, bits):
                may = may_be(apart_in(words[a], words[b]), lengths[a], lengths[b])
                a, b = a[may], b[may]
            for m, k in zip(a.tolist(), b.tolist()):
                if label[k] != label[m] and sets.similar(texts[m], texts[k]):
                    out.append((ids[m], ids[k]))
                    label[label == label[k]] = label[m]
        return out

    def table(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"]
        )

    for batch in batches:
        links: list[tuple[int, int]] = []
        for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, i, j) != now:
                links += found() if held else []
                held.clear()
                now = (key, i, j)
            held.append(tuple(row))
        yield table(links)
    if held:
        yield table(found())


def _residual(buckets: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links that the comparison with each bucket's first line missed."""
    members = buckets.select("key", "id").unionByName(buckets.select("key", F.col("first").alias("id")).distinct())
    named = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("part")
    )
    named = stored(named)
    facts = [F.count("*").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("all")]
    open_ = named.groupBy("key").agg(*facts, F.min("id").alias("least")).where("size > 2 AND lo <> hi")
    # Bands often hold the same lines together; such a bucket is searched once.
    open_ = open_.groupBy("size", "all", "least").agg(F.min("key").alias("key"))
    open_ = stored(open_.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    if open_.isEmpty():
        return None
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = named.join(open_, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "part", "block"
    )
    dealt = rows.join(texts, "id").select("key", "i", "j", "id", "part", "block", "text", "bits").repartition("key", "i", "j")
    return dealt.sortWithinPartitions("key", "i", "j").mapInArrow(_across, "u bigint, v bigint")


def removed_lines(docs: DataFrame) -> DataFrame:
    """``_id``, ``_hash`` and ``gone``, the numbers of the lines to remove, for ``docs`` (``_id``, ``_hash``, ``_text``)."""
    occurrences = stored(_occurrences(docs))
    keyed = occurrences.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "id")
    buckets = stored(_buckets(keyed))
    pairs = stored(buckets.select(F.col("id").alias("u"), F.col("first").alias("v")).distinct())
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    texts = stored(_fetched(docs, occurrences, ids))
    links = stored(_verified(pairs, texts))
    parts = components(links)
    more = _residual(buckets, parts, texts)
    if more is not None:
        parts = components(parts.where("node <> component").toDF("u", "v").unionByName(more))
    # Only lines that come twice or have links can go.
    twice = occurrences.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    open_ = stored(
        twice.join(parts.withColumnRenamed("node", "id"), "id", "full").select("id", F.coalesce("component", "id").alias("part"))
    )
    placed = stored(occurrences.select("id", "_id", "_hash", "line").join(open_, "id").select("part", "_id", "_hash", "line"))
    place = F.struct(F.col("_id").isNull().alias("no_key"), "_id", "_hash", "line")
    first = stored(placed.groupBy("part").agg(F.min(place).alias("first")))
    gone = placed.join(first, "part").where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("_id", "_hash").agg(F.collect_set("line").alias("gone"))


def _marked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with the numbers of the lines to remove, and the name of that column."""
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    gone_id, gone_hash, numbers, hashed = unused(docs, "_id", "_hash", "_gone", "_of")
    gone = removed_lines(rows).toDF(gone_id, gone_hash, numbers)
    own = docs.withColumn(hashed, F.xxhash64(text))
    at = own[key].eqNullSafe(gone[gone_id]) & (own[hashed] == gone[gone_hash])
    return own.join(gone, at, "left").drop(hashed, gone_id, gone_hash), numbers


def _left(text: str, numbers: str) -> Column:
    """The text without the lines of those numbers, in time proportional to its lines."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), numbers)
    # The lines are split once, as the one element of the outer array.
    kept = F.transform(F.array(F.split(text, "\n")), lambda own: F.transform(stay, lambda i: F.get(own, i)))
    return F.when(F.col(numbers).isNull(), F.col(text)).otherwise(F.array_join(kept[0], "\n"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_lines``, ``n_removed`` and ``kept`` (the other lines) of every row."""
    marked, numbers = _marked(docs.select(key, text), key, text)
    own = F.coalesce(F.col(text), F.lit(""))
    return marked.select(
        key,
        F.when(own == "", F.lit(0)).otherwise(F.size(F.split(own, "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(_left(text, numbers), F.lit("")).alias("kept"),
    )


def keep_first_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every column, the texts without the lines to remove. Rows stay, even those that lose all lines."""
    marked, numbers = _marked(docs, key, text)
    return marked.withColumn(text, _left(text, numbers)).drop(numbers)
