"""Passages that repeat anywhere in the corpus, by sorting suffixes that share a prefix, cut to a window; no suffix tree is built.

Not every suffix is needed to find all repeated windows of ``window`` words. Each window has an anchor: of its runs of ``PREFIX``
words the one with the smallest hash, the first of equals. Equal windows have equal anchors at equal places, so only suffixes that
begin at anchors are sorted into groups, by the anchor's words as their prefix; a window is compared in its anchor's group alone.
An anchor and the words of all windows it stands for make a leaf. Equal leaves are one leaf with a count, told by hashes of
together 128 bits. A group with one leaf needs no tree: its windows repeat if the count is two or more. Of groups with several
leaves, the words of one copy of each leaf are fetched and sorted from each place where a window may begin; an inner node of
the tree that is ``window`` words deep or deeper, that is a run of sorted suffixes which agree that far, is a repeat. A group too large
for a tree gets longer prefixes: whole windows, counted as rows.

Null and empty texts, and texts shorter than a window, lose nothing. Copies, also rows alike in key and text, repeat each other.
Texts are taken whole. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows, stored

#: Words of the shared prefix, and the bits in which a place is packed: word number of the anchor, windows before it, windows.
PREFIX, PLACE = 8, 6
#: Most leaves of a group that becomes one tree.
GROUP = 20_000
#: Distinct words whose hashes a task keeps.
CACHED = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` adjacent values."""
    size, now = 1, x
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` adjacent values."""
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + len(out)]) * ODD
        out ^= out >> np.uint64(29)
    return out


def anchors(words: list[bytes], hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Prefix hash, word number, first window and last window of each anchor."""
    runs = run_hashes(hashes, PREFIX)
    number_bits = np.uint64(27)
    number = np.arange(len(runs), dtype=np.uint64)
    if len(runs) >= 1 << 27:
        raise ValueError("a text has more than 134 million words")
    best = sliding_min((runs >> number_bits << number_bits) | number, window - PREFIX + 1)
    chosen = (best & np.uint64((1 << 27) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    at = chosen[first]
    return runs[at], at, first, np.append(first[1:], len(chosen)) - 1


def pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (at << 2 * PLACE) | ((at - first) << PLACE) | (last - first)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 2 * PLACE
    first = at - (place >> PLACE & (1 << PLACE) - 1)
    return at, first, first + (place & (1 << PLACE) - 1)


def _leaves(docs: DataFrame, window: int) -> DataFrame:
    """A row for each anchor: ``h`` and ``d`` (hashes of prefix and leaf), ``_id``, ``_hash``, ``place``."""
    kind = docs.schema["_id"].dataType.simpleString()

    def make():
        import xxhash

        known = WordHashes()

        def step(batch: dict) -> dict:
            h, d, ids, same, places = [], [], [], [], []
            for key, text_hash, text in zip(batch["_id"], batch["_hash"], batch["_text"], strict=True):
                words = (text or "").encode().split()
                if len(words) < window:
                    continue
                hashes = np.array([known[w] for w in words], np.uint64)
                prefix, at, first, last = anchors(words, hashes, window)
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                spans = zip(starts[first].tolist(), ends[last + window - 1].tolist(), (at - first).tolist(), strict=True)
                d += [xxhash.xxh3_64_intdigest(joined[s:e], before) for s, e, before in spans]
                h.append(prefix)
                places.append(pack(at, first, last))
                ids += [key] * len(at)
                same += [text_hash] * len(at)
            return {
                "h": np.concatenate(h).view(np.int64) if h else [],
                "d": np.array(d, np.uint64).view(np.int64),
                "_id": ids,
                "_hash": same,
                "place": np.concatenate(places) if places else [],
            }

        return step

    return map_rows(docs, make, f"h bigint, d bigint, _id {kind}, _hash bigint, place bigint")


def tree_repeats(leaves: list[tuple[bytes, int, int]], counts: list[int], window: int) -> list[int]:
    """For each leaf of a group, bits of its windows that occur twice or more.

    A leaf is its words, the windows before its anchor and the windows it has. The suffixes from each place before the anchor are
    sorted; runs that agree on ``window`` words are the tree's nodes of that depth.
    """
    split = [words.split(b" ") for words, _, _ in leaves]
    suffixes: dict[int, list[tuple[list[bytes], int]]] = {}
    for n, (_, before, last) in enumerate(leaves):
        for i in range(last + 1):
            suffixes.setdefault(before - i, []).append((split[n][i : i + window], n))
    masks = [0] * len(leaves)
    for back, entries in suffixes.items():
        entries.sort()
        at = 0
        while at < len(entries):
            end = at + 1
            while end < len(entries) and entries[end][0] == entries[at][0]:
                end += 1
            if end - at > 1 or counts[entries[at][1]] > 1:
                for _, n in entries[at:end]:
                    masks[n] |= 1 << (leaves[n][1] - back)
            at = end
    return masks


def _trees(window: int):
    """Trees of the groups of a partition sorted by ``h``; gives the place and window bits of leaves that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def emit() -> list[list] | None:
            leaves = [(r["words"], (r["place"] >> PLACE) & (1 << PLACE) - 1, r["place"] & (1 << PLACE) - 1) for r in held]
            masks = tree_repeats(leaves, [r["n"] for r in held], window)
            rows = [(r["_id"], r["_hash"], r["place"], m) for r, m in zip(held, masks, strict=True) if m and r["n"] == 1]
            return [list(x) for x in zip(*rows, strict=True)] if rows else None

        for batch in batches:
            names, out = batch.schema.names, [[], [], [], []]
            kind = batch.schema.field("_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, row, strict=True))
                if held and held[0]["h"] != row["h"]:
                    for have, new in zip(out, emit() or [[], [], [], []], strict=True):
                        have += new
                    held.clear()
                held.append(row)
            yield _ranges(out, kind)
        if held:
            yield _ranges(emit() or [[], [], [], []], kind)

    return run


def _ranges(columns: list[list], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_id", "_hash", "place", "mask"]
    )


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """``_id``, ``_hash``, ``place`` and ``mask`` (bits of the anchor's windows that repeat) for ``docs`` (``_id``, ``_hash``, ``_text``)."""
    kind = docs.schema["_id"].dataType.simpleString()
    leaves = stored(_leaves(docs, window))
    # An anchor whose prefix occurs once repeats nothing; where all leaves of a prefix are one, they all repeat.
    status = stored(
        leaves.groupBy("h").agg(F.count("*").alias("rows"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        .where("rows > 1").select("h", (F.col("lo") == F.col("hi")).alias("alike"))
    )
    met = stored(leaves.join(status, "h"))
    several = met.where("NOT alike")
    counts = stored(several.groupBy("h", "d").agg(F.count("*").alias("n")))
    # A prefix may have very many leaves, so their number is summed map-side and joined, not counted over a window.
    leaves_of = stored(counts.groupBy("h").agg(F.count("*").alias("g")))
    told = stored(several.join(counts, ["h", "d"]).join(leaves_of, "h"))
    all_bits = F.expr(f"shiftleft(2L, CAST(place & {(1 << PLACE) - 1} AS INT)) - 1L")
    whole = met.where("alike").select("_id", "_hash", "place").unionByName(told.where("n > 1").select("_id", "_hash", "place"))
    whole = whole.withColumn("mask", all_bits)
    one = Window.partitionBy("h", "d").orderBy("_id", "_hash", "place")
    asked = told.withColumn("_k", F.row_number().over(one)).where("_k = 1").select("h", "n", "g", "_id", "_hash", "place")
    requests = asked.groupBy("_id", "_hash").agg(F.collect_list(F.struct("h", "n", "g", "place")).alias("asked"))
    texts = _joined(docs, requests)

    def make():
        def step(batch: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("h", "n", "g", "_id", "_hash", "place", "words")}
            for key, same, text, wanted in zip(batch["_id"], batch["_hash"], batch["_text"], batch["asked"], strict=True):
                words = text.encode().split()
                for r in wanted:
                    _, first, last = unpack(r["place"])
                    values = (r["h"], r["n"], r["g"], key, same, r["place"], b" ".join(words[first : last + window]))
                    for c, v in zip(out, values, strict=True):
                        out[c].append(v)
            return out

        return step

    fetched = map_rows(texts, make, f"h bigint, n bigint, g bigint, _id {kind}, _hash bigint, place bigint, words binary")
    fetched = stored(fetched)
    trees = (
        fetched.where(F.col("g") <= GROUP).select("h", "n", "_id", "_hash", "place", "words")
        .repartition("h").sortWithinPartitions("h").mapInArrow(_trees(window), f"_id {kind}, _hash bigint, place bigint, mask bigint")
    )
    return whole.unionByName(trees).unionByName(_deep(fetched.where(F.col("g") > GROUP), window, kind))


def _joined(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """The texts that requests are for. Rows alike in key and text answer twice, which changes no tree: their leaves count twice."""
    right = requests.select(F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash"), "asked")
    at = docs["_id"].eqNullSafe(right["_rid"]) & (docs["_hash"] == right["_rhash"])
    return docs.join(right, at).select("_id", "_hash", "_text", "asked")


def _deep(leaves: DataFrame, window: int, kind: str) -> DataFrame:
    """As ``_trees`` for groups of any size: each window is a prefix of its own."""

    def make():
        import xxhash

        def step(batch: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("h", "back", "w", "n", "_id", "_hash", "place", "bit")}
            for h, n, key, same, place, joined in zip(*(batch[c] for c in ("h", "n", "_id", "_hash", "place", "words")), strict=True):
                words, (at, first, last) = joined.split(b" "), unpack(place)
                for i in range(last - first + 1):
                    digest = xxhash.xxh3_64_intdigest(b" ".join(words[i : i + window]))
                    values = (h, int(at - first) - i, digest - (digest >> 63 << 64), n, key, same, place, 1 << i)
                    for c, v in zip(out, values, strict=True):
                        out[c].append(v)
            return out

        return step

    rows = map_rows(
        leaves.select("h", "n", "_id", "_hash", "place", "words"), make,
        f"h bigint, back int, w bigint, n bigint, _id {kind}, _hash bigint, place bigint, bit bigint",
    )
    key = ["h", "back", "w"]
    often = rows.groupBy(*key).agg(F.sum("n").alias("total")).where("total > 1").select(*key)
    found = rows.join(often, key).where("n = 1")
    return found.groupBy("_id", "_hash", "place").agg(F.sum("bit").alias("mask"))


def covered(n: int, places: list[int], masks: list[int], window: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a window that the masks mark."""
    edge = np.zeros(n + 1, np.int64)
    for place, mask in zip(places, masks, strict=True):
        _, first, last = unpack(place)
        for i in range(last - first + 1):
            if mask >> i & 1:
                edge[first + i] += 1
                edge[first + i + window] -= 1
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept`` (the other words, joined by one space) of every row.

    A word goes if a window over it also starts anywhere else, in the same text or another. Windows may be 16 to 60 words long.
    """
    if not PREFIX + 8 <= window <= 60:
        raise ValueError("window must be from 16 to 60 words")
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = repeated_windows(rows, window)
    marked = found.groupBy("_id", "_hash").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))
    right = marked.select(F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash"), "marks")
    both = rows.join(right, rows["_id"].eqNullSafe(right["_rid"]) & (rows["_hash"] == right["_rhash"]), "left").select("_id", "_text", "marks")

    def make():
        def step(batch: dict) -> dict:
            total, removed, kept = [], [], []
            for x, marks in zip(batch["_text"], batch["marks"], strict=True):
                words = (x or "").encode().split()
                total.append(len(words))
                if marks:
                    gone = covered(len(words), [m["place"] for m in marks], [m["mask"] for m in marks], window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            return {key: batch["_id"], "n_words": total, "n_removed": removed, "kept": kept}

        return step

    return map_rows(both, make, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string")
