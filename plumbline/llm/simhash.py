"""Near copies by SimHash, found with a hierarchical index over fingerprints in Gray order.

Two fingerprints that differ in at most ``radius`` of 64 bits agree in at least one of ``radius + 1`` blocks of bits, so each
distinct fingerprint goes to one group per block. In a group the fingerprints are sorted by Gray rank, which puts those with
shared bit patterns side by side; runs of them share a node that holds the bits on which all agree, runs of nodes a node
above. A search sums up the differences on the way down, each node adding those bits only that its parent left open, and
drops a whole node once the sum passes the radius. Groups beyond ``GROUP`` are divided again by blocks of the other bits, so no
link is lost and no task holds a large group. Each task passes on a forest of the links it found, not the links.

Null and empty texts have fingerprint zero and are linked like any other; repeated rows and ids are returned as often as they
come; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows, stored, unused
from plumbline.llm.components import components, merge

BITS = 64
#: Most fingerprints of a group that is searched as it is, and how often a larger one is divided.
GROUP, DIVISIONS = 50_000, 3
#: Children of a node; fingerprints searched at a time; rows that a task gathers before it builds indexes.
FAN, AT_ONCE, GATHERED = 8, 4_096, 100_000
#: Shingles hashed at a time, which bounds memory on very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """Majority bits of the XXH64 values (seed 42) of a text's shingles, ASCII letters in lower case."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    whole, size = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - size + 1]
    ends = ends[size - 1 :]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        parts = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(whole[s:e], 42) for s, e in parts], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` and ``fingerprint`` (bigint, the bits as two's complement) of every row."""

    def make():
        return lambda batch: {key: batch[key], "fingerprint": [fingerprint(x, words) for x in batch[text]]}

    return map_rows(docs.select(key, text), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Trees over many groups at once; the rows of a group are adjacent and in Gray order."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        self.prints = prints
        all_, any_, group, last = prints, prints, groups, np.arange(len(prints))
        self.levels = [(np.full(len(prints), np.uint64(2**64 - 1)), prints, last, None)]
        while True:
            new = np.concatenate([[True], group[1:] != group[:-1]])
            first = np.flatnonzero(new)
            within = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            starts = np.flatnonzero(within % FAN == 0)
            if len(starts) == len(group):
                break
            all_, any_ = np.bitwise_and.reduceat(all_, starts), np.bitwise_or.reduceat(any_, starts)
            group, last = group[starts], last[np.append(starts[1:], len(last)) - 1]
            self.levels.append((~(all_ ^ any_), all_, last, np.append(starts, len(within))))
        self.roots = np.searchsorted(last, np.arange(len(prints)))

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query (a row number) and a later row of its group that differ in at most ``radius`` bits."""
        node = self.roots[queries]
        fixed, pattern, last, _ = self.levels[-1]
        diff = np.bitwise_count((self.prints[queries] ^ pattern[node]) & fixed[node]).astype(np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            fixed, pattern, last, begin = self.levels[depth]
            open_ = (diff <= radius) & (last[node] > queries)
            queries, node, diff = queries[open_], node[open_], diff[open_]
            if depth == 0 or not len(node):
                break
            counts = begin[node + 1] - begin[node]
            parent = np.repeat(np.arange(len(node)), counts)
            child = np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[node][parent]
            below, patterns = self.levels[depth - 1][:2]
            left = below[child] & ~fixed[node][parent]  # what the parent has not compared yet
            queries = queries[parent]
            diff = diff[parent] + np.bitwise_count((self.prints[queries] ^ patterns[child]) & left)
            node = child
        return queries, node


def group_links(groups: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within the groups."""
    order = np.lexsort((gray_rank(prints), groups))
    groups, prints = groups[order], prints[order]
    index, labels = GrayIndex(prints, groups), np.arange(len(prints))
    for at in range(0, len(prints), AT_ONCE):
        merge(labels, *index.near(np.arange(at, min(at + AT_ONCE, len(prints))), radius))
    own = np.flatnonzero(labels != np.arange(len(prints)))
    return prints[own], prints[labels[own]]


def _searched(radius: int):
    """Links of each group of a partition that is sorted by group."""

    def emit(groups: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        u, v = group_links(groups, prints.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= GATHERED:
                groups, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = np.searchsorted(groups, groups[-1])  # the last group may go on in the next batch
                if whole:
                    yield emit(groups[:whole], prints[:whole])
                held, rows = [(groups[whole:], prints[whole:])], len(groups) - whole
        if rows:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def _picked(value: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Forests of the links between distinct fingerprints (column ``fingerprint``) in groups that share a block of bits."""
    value, parts = F.col("fingerprint"), radius + 1
    cuts = [(block, [b for b in range(BITS) if b not in block]) for block in _blocks(list(range(BITS)), parts)]
    rows = prints.select(
        value, F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.xxhash64(F.lit(i), _picked(value, block)).alias("grp"))
                                   for i, (block, _) in enumerate(cuts)])).alias("g")
    ).select("fingerprint", "g.cut", "g.grp")
    found = None
    for division in range(DIVISIONS + 1):
        hot = None
        if division < DIVISIONS:
            hot = stored(rows.groupBy("grp").count().where(F.col("count") > GROUP).select("grp"))
            if hot.isEmpty():
                hot = None
        small = rows.join(hot, "grp", "left_anti") if hot is not None else rows
        got = (
            small.repartition("grp").sortWithinPartitions("grp").select("grp", "fingerprint")
            .mapInArrow(_searched(radius), "u bigint, v bigint")
        )
        found = got if found is None else found.unionByName(got)
        if hot is None:
            break
        # Of each block's other bits, one of as many blocks again must agree.
        deeper, choices = [], []
        for i, (_, rest) in enumerate(cuts):
            for block in _blocks(rest, parts):
                choices.append((i, len(deeper), block))
                deeper.append((block, [b for b in rest if b not in block]))
        keys = F.array(
            *[F.when(F.col("cut") == i, F.struct(F.lit(n).alias("cut"), F.xxhash64("grp", F.lit(n), _picked(value, block)).alias("grp")))
              for i, n, block in choices]
        )
        rows = (
            rows.join(hot, "grp", "left_semi").select("fingerprint", F.explode(keys).alias("g")).where("g IS NOT NULL")
            .select("fingerprint", "g.cut", "g.grp")
        )
        cuts = deeper
    return found


def _clustered(docs: DataFrame, key: str, text: str, words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows (``_id``, ``_same``, a hash of the text, ``fingerprint``) and the component of each fingerprint."""
    read = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_same"), F.col(text).alias("_text"))

    def make():
        return lambda b: {"_id": b["_id"], "_same": b["_same"], "fingerprint": [fingerprint(x, words) for x in b["_text"]]}

    rows = stored(map_rows(read, make, f"_id {read.schema['_id'].dataType.simpleString()}, _same bigint, fingerprint bigint"))
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("_id").alias("_least")))
    parts = stored(components(links(distinct.select("fingerprint"), radius)))
    linked = stored(parts.join(distinct, parts["node"] == distinct["fingerprint"]).select("node", "component", "_least"))
    least = stored(linked.groupBy("component").agg(F.min("_least").alias("_linked")))
    member = linked.join(least, "component").select(F.col("node").alias("fingerprint"), "component", "_linked")
    named = distinct.join(member, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("_part"), F.coalesce("_linked", "_least").alias("component_id")
    )
    return rows, stored(named)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest key reachable by links."""
    rows, named = _clustered(docs, key, text, words, radius)
    return rows.join(named, "fingerprint").select(
        F.col("_id").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the smallest key, of equal keys one by a hash of the text.

    Of rows alike in key and text one is kept. A component whose keys are all null keeps one row.
    """
    rows, named = _clustered(docs, key, text, words, radius)
    first = rows.join(named, "fingerprint").where(F.col("_id").eqNullSafe(F.col("component_id")))
    hashed, number, chosen_id, chosen_hash = unused(docs, "_hash", "_n", "_id", "_same")
    chosen = first.groupBy("_part", "_id").agg(F.min("_same").alias("_same")).select("_id", "_same").distinct().toDF(chosen_id, chosen_hash)
    same = Window.partitionBy(key, hashed).orderBy(text)
    one = docs.withColumn(hashed, F.xxhash64(text)).withColumn(number, F.row_number().over(same)).where(F.col(number) == 1)
    at = one[key].eqNullSafe(chosen[chosen_id]) & (one[hashed] == chosen[chosen_hash])
    return one.join(chosen, at, "left_semi").drop(hashed, number)
