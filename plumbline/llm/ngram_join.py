"""Documents whose sets of word shingles are similar, by partitions of the universe of shingles and the pigeonhole principle.

Sets of similar sizes form a band. A hash deals all shingles to the band's segments; what a set has in one segment is hashed to a
key. Linked sets differ in at most ``most_apart`` shingles, each of which spoils one segment, so that of any units worth more than that
at least one is shared: a segment alike in both is worth one, and one of the first ``deletions(band)`` segments, alike but for one shingle
(found by the keys of what is left without each of them), two. A set goes to its own band and, as the larger of a pair, to those
below that hold linked sizes.

1. Keys go packed to tasks by their value, those that many sets of a batch have only once, so that no key weighs on one task. Only keys
   that two sets share come out, and of those only the sets that share enough of their units to be linked at all.
2. Each set is compared with the first set of most of its keys; a union-find joins what is linked. Keys whose sets are all joined have
   nothing more to tell and cost nothing.
3. Of its other shared units each set looks into the cheapest, by the number of sets, until those left out are too few to hide a link;
   most sets need none. In those keys sets of different components are compared, large keys in blocks.

Every link rests on the exact sizes of intersection and union. Shingles and sets are told apart by 64-bit hashes.

Words are lower-cased in A-Z. A document with fewer words than a shingle is one shingle; without words (null and empty texts) it is
linked with nothing and stays alone. Rows with equal texts are one set; a null key never becomes a component's number while another
is there. Repeated rows come out as often as they come in, an empty table gives an empty one, and of the input only the named columns
are read. Keys are integers. Texts of any length are taken whole; a task's memory is in proportion to the longest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import map_rows, schema_of, stored
from plumbline.llm.components import components

#: Words of a shingle; similarity in hundredths.
SHINGLE, SIMILAR = 5, 80
#: Growth of a band's sizes; most segments of a set for which one-deletion keys are made (a key's unit is a byte).
GROWTH, MOST_DELETIONS = 1.5, 127
#: Bytes of text whose sets are made at a time; shingles whose keys a task packs together; characters of text per task that gathers keys.
BYTES, PACKED, CHARS = 4 << 20, 1 << 18, 10_000_000
#: Most sets of a key that are paired off; sets, and shingles, of a block in a larger one; least bits that stand for a set.
PAIRED, BLOCK, BLOCK_SHINGLES, BITMAP = 64, 2_048, 1 << 20, 2_048
#: Bytes hashed at a time, and from which length words are hashed one by one.
STRETCH, LONG = 1 << 18, 256

_random = np.random.default_rng(11)
WORD_FACTORS = _random.integers(1, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)
SHORT, CONTENT, SEGMENT, BAND, SET = (_random.integers(1, 1 << 63, 5, np.uint64) | np.uint64(1)).tolist()
FLAG = 128
BASE = int(_random.integers(1, 1 << 63)) | 1
BYTES_AS = _random.integers(0, 1 << 64, 256, np.uint64)
BYTES_AS[65:91] = BYTES_AS[97:123]
WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = np.isin(np.arange(256), list(WHITE))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= SIMILAR * (a + b - common)


def most_apart(sizes: int) -> int:
    """Most shingles that only one of two linked sets has, whose sizes add up to ``sizes``."""
    return (100 - SIMILAR) * sizes // (100 + SIMILAR)


def largest_linked(size: int) -> int:
    return 100 * size // SIMILAR


def band_ends(size: int) -> list[int]:
    """The largest size of each band, up to that which holds ``size``."""
    ends = [1]
    while ends[-1] < size:
        ends.append(max(ends[-1] + 1, int((ends[-1] + 1) * GROWTH)))
    return ends


def segments(end: int) -> int:
    """Segments of the band whose largest size is ``end``: a few more than the shingles by which linked sets can differ."""
    apart = most_apart(end + largest_linked(end))
    return apart + 2 + apart // 16


def deletions(end: int) -> int:
    return min(MOST_DELETIONS, 1 + segments(end) // 64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, one after the other, and the number of each text's words.

    Hashes are sums of a random number for each byte, alike for a letter and its capital, times powers of an odd number; so running
    sums over all bytes, divided by the power where a word begins, give those of all words at once. Words over ``LONG`` bytes, among
    which such sums can be made to agree, are hashed one by one.
    """
    import xxhash

    encoded = [(t or "").encode() for t in texts]
    joined = b" ".join([*encoded, b""])
    ends = np.cumsum([len(t) + 1 for t in encoded])
    found, begins = [], []
    at = 0
    while at < len(joined):
        # Up to white space, so that no word is cut.
        to = min(len(joined), at + STRETCH)
        if to < len(joined):
            to = next((i + 1 for i in range(to - 1, at, -1) if joined[i] in WHITE), None) or next(
                i + 1 for i in range(to, len(joined)) if joined[i] in WHITE
            )
        data = np.frombuffer(joined, np.uint8, to - at, at)
        white = IS_WHITE[data]
        change = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            change = np.concatenate([[0], change])
        begin, end = change[::2], change[1::2]
        powers, inverse = _powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES_AS[data] * powers, out=sums[1:])
        own = mixed((sums[end] - sums[begin]) * inverse[begin])
        for k in np.flatnonzero(end - begin > LONG).tolist():
            own[k] = xxhash.xxh3_64_intdigest(joined[at + begin[k] : at + end[k]].lower())
        found.append(own)
        begins.append(begin + at)
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    before = np.searchsorted(np.concatenate(begins), ends)
    return np.concatenate(found), np.diff(before, prepend=0)


_known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``BASE`` and of its inverse modulo 2^64."""
    if len(_known[0]) < n:
        for k, factor in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(max(n, STRETCH), factor, np.uint64)
            factors[0] = 1
            _known[k] = np.cumprod(factors)
    return _known[0][:n], _known[1][:n]


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's shingles, rising within a text, and the sizes of the sets."""
    words, counts = word_hashes(texts)
    begins = np.cumsum(counts) - counts
    whole = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        whole += words[i : i + len(whole)] * WORD_FACTORS[i]
    whole = mixed(whole)
    parts = []
    for begin, n in zip(begins.tolist(), counts.tolist(), strict=True):
        if n >= SHINGLE:
            part = whole[begin : begin + n - SHINGLE + 1]
            part.sort()
        elif n:
            # The length keeps it apart from whole shingles.
            total = (words[begin : begin + n] * WORD_FACTORS[:n]).sum(keepdims=True)
            part = mixed(total + np.uint64(SHORT * n & (1 << 64) - 1))
        else:
            part = words[:0]
        parts.append(part)
    sizes = np.array([len(x) for x in parts], np.int64)
    values = np.concatenate([*parts, words[:0]])
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    first = np.cumsum(sizes) - sizes
    new[first[sizes > 0]] = True
    return values[new], np.diff(np.concatenate([[0], np.cumsum(new)])[np.cumsum(sizes)], prepend=0)


def digests_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(SET)))])
    ends = np.cumsum(sizes)
    return mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * np.uint64(SHORT)).view(np.int64)


def keys_of(values: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """By band: set numbers, band, keys and units (0: a segment as it is; from 1 on: the segment's one-deletion keys, and itself)."""
    number = np.repeat(np.arange(len(sizes)), sizes)
    content = mixed(values ^ np.uint64(CONTENT))
    begin = 1
    for band, end in enumerate(band_ends(int(sizes.max(initial=1)))):
        # Also the larger ones that can be linked with a set of the band.
        use = np.flatnonzero((sizes >= begin) & (sizes <= largest_linked(end)))
        begin = end + 1
        if not len(use) or not most_apart(end + largest_linked(end)):
            continue
        m, c = segments(end), deletions(end)
        place = np.full(len(sizes), -1)
        place[use] = np.arange(len(use))
        own = np.flatnonzero(place[number] >= 0)
        segment = ((values[own] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        at = place[number[own]] * m + segment
        whole = np.zeros(len(use) * m, np.uint64)
        np.add.at(whole, at, content[own])
        less = np.flatnonzero(segment < c)
        left = whole[at[less]] - content[own[less]]
        segment = np.concatenate([np.tile(np.arange(m), len(use)), segment[less]])
        salt = np.uint64(band * BAND & (1 << 64) - 1)
        keys = mixed(np.concatenate([whole, left]) + segment.astype(np.uint64) * np.uint64(SEGMENT) + salt)
        units = np.where(segment < c, segment + 1, 0).astype(np.uint8)
        yield np.concatenate([np.repeat(use, m), number[own[less]]]), band, keys, units


_PACKS = "keys binary, digests binary, sizes binary, bands binary, units binary, firsts binary"


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """From ``_id``, ``_hash``, ``_text`` the same without text but with the set's ``digest`` and ``size`` (null if empty), and rows of
    packed keys. ``part`` says to which task a row goes; ``local`` marks packs that need no other task's keys."""
    kind = rows.schema["_id"].dataType.simpleString()
    plan = f"part int, _id {kind}, _hash bigint, digest bigint, size bigint, local boolean, {_PACKS}"

    def make() -> Callable[[dict], dict]:
        def step(batch: dict) -> dict:
            out: dict[str, list] = {n.split()[0]: [] for n in plan.split(", ")}

            def put(part: int, local: bool, columns: dict[str, np.ndarray]) -> None:
                row = {"part": part, "local": local} | {c: x.tobytes() for c, x in columns.items()}
                for c, values in out.items():
                    values.append(row.get(c))

            def pack(columns: dict[str, np.ndarray]) -> None:
                order = np.argsort(columns["keys"], kind="stable")
                keys = columns["keys"][order]
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                group = np.cumsum(first) - 1
                several = np.bincount(group)[group] > 1
                own_first = columns["digests"][order][np.flatnonzero(first)[group]]
                columns = {c: x[order] for c, x in columns.items()}
                others = {c: x[~first] for c, x in columns.items()} | {"firsts": own_first[~first]}
                if len(others["keys"]):
                    put(int(keys[0] >> np.uint64(33)) % parts, True, others)
                columns["units"] = columns["units"] | (FLAG * several).astype(np.uint8)
                columns = {c: x[first] for c, x in columns.items()}
                to = (columns["keys"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                # Rows of one set side by side, which compress.
                by_set = np.lexsort((columns["digests"], to))
                ends = np.searchsorted(to[by_set], np.arange(parts + 1, dtype=np.uint64))
                for part in range(parts):
                    if ends[part] < ends[part + 1]:
                        put(part, False, {c: x[by_set[ends[part] : ends[part + 1]]] for c, x in columns.items()})

            values, sizes = shingle_sets(batch["_text"])
            digests = digests_of(values, sizes)
            for key, same, digest, size in zip(batch["_id"], batch["_hash"], digests.tolist(), sizes.tolist(), strict=True):
                row = {"part": 0 if same is None else same % parts, "_id": key, "_hash": same, "size": size}
                row["digest"] = digest if size else None
                for c, column in out.items():
                    column.append(row.get(c))
            # Sets that come again in the batch have their keys once.
            once = np.zeros(len(sizes), bool)
            once[np.unique(digests, return_index=True)[1]] = True
            once &= sizes > 0
            values, digests, sizes = values[np.repeat(once, sizes)], digests[once], sizes[once]
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(sizes):
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + PACKED, "right")))
                found = list(keys_of(values[done : ends[end - 1]], sizes[begin:end]))
                if found:
                    number = np.concatenate([f[0] for f in found]) + begin
                    pack({
                        "keys": np.concatenate([f[2] for f in found]), "digests": digests[number], "sizes": sizes[number].astype(np.int32),
                        "bands": np.concatenate([np.full(len(f[0]), f[1], np.uint8) for f in found]),
                        "units": np.concatenate([f[3] for f in found]),
                    })
                begin = end
            return out

        return step

    return map_rows(rows, make, plan, rows_at_once=1 << 14, bytes_at_once=BYTES)


def _shared(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents as they come, and unpacked the keys that more than one set has, with the first of those sets."""
    types = {"keys": np.uint64, "digests": np.int64, "sizes": np.int32, "bands": np.uint8, "units": np.uint8, "firsts": np.int64}
    held: dict[str, list] = {c: [] for c in types if c != "firsts"}

    def table(columns: dict[str, np.ndarray], firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(firsts), 1 << 16):
            part = {c: x[at : at + (1 << 16)] for c, x in columns.items()}
            n = len(part["keys"])
            made = {
                "key": part["keys"].view(np.int64), "digest": part["digests"], "size": part["sizes"].astype(np.int64),
                "band": part["bands"].astype(np.int8), "unit": (part["units"] & ~np.uint8(FLAG)).astype(np.int8), "first": firsts[at : at + n],
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema
            )

    for batch in batches:
        whole = pa.Table.from_batches([batch])
        documents = whole.filter(whole["keys"].is_null())
        made = [documents[f.name] if f.name in documents.column_names else pa.nulls(len(documents), f.type) for f in schema]
        yield from pa.table(made, schema=schema).combine_chunks().to_batches()
        for row in whole.filter(whole["keys"].is_valid()).select(["local", *types]).to_pylist():
            columns = {c: np.frombuffer(row[c], t) for c, t in types.items() if row[c] is not None}
            if row["local"]:
                yield from table(columns, columns.pop("firsts"))
            else:
                for c, x in held.items():
                    x.append(columns[c])
    if not held["keys"]:
        return
    columns = {c: np.concatenate(x) for c, x in held.items()}
    held.clear()
    order = np.lexsort((columns["digests"], columns["keys"]))
    columns = {c: x[order] for c, x in columns.items()}
    keys, digests = columns["keys"], columns["digests"]
    new_key, new = np.ones(len(keys), bool), np.ones(len(keys), bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new[1:] = new_key[1:] | (digests[1:] != digests[:-1])
    group = np.cumsum(new_key) - 1
    shared = (np.bincount(group, new)[group] > 1) | (np.bincount(group, columns["units"] >= FLAG)[group] > 0)
    firsts = digests[np.flatnonzero(new_key)[group]]
    use = new & shared
    yield from table({c: x[use] for c, x in columns.items()}, firsts[use])


def bands(spark, most: int) -> DataFrame:
    """``band``, ``end``, and the worth of all ``units`` of a set in it."""
    rows = [(b, e, segments(e) + deletions(e)) for b, e in enumerate(band_ends(most))]
    return F.broadcast(spark.createDataFrame(rows, "band byte, end bigint, units bigint"))


def _most_apart(sizes: Column) -> Column:
    return F.floor((100 - SIMILAR) * sizes / (100 + SIMILAR))


def _that_may_link(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The keys of sets that share so many units of a band that they can be linked with a set in it."""
    worth = F.sum(F.when(F.col("unit") > 0, 2).otherwise(1))  # too much where several keys of a unit are shared, which is safe
    sets = keys.groupBy("digest", "band").agg(F.first("size").alias("size"), worth.alias("worth")).join(known, "band")
    partner = F.when(F.col("size") <= F.col("end"), F.floor(100 * F.col("size") / SIMILAR)).otherwise(F.col("end"))
    may = sets.where(F.col("units") - F.col("worth") <= _most_apart(F.col("size") + partner)).select("digest", "band")
    return keys.join(may, ["digest", "band"])


def _sets(rows: DataFrame, documents: DataFrame, digests: DataFrame) -> DataFrame:
    """``digest``, ``shingles`` and ``bits`` of the sets ``digests``."""
    place = F.struct(F.col("_id").isNull().alias("no_key"), "_id", "_hash")
    at = documents.join(digests, "digest").groupBy("digest").agg(F.min(place).alias("at"))
    at = at.select(F.col("at._id").alias("_rid"), F.col("at._hash").alias("_rhash")).distinct()
    texts = rows.join(at, rows["_id"].eqNullSafe(at["_rid"]) & (rows["_hash"] == at["_rhash"])).select("_text")

    def make():
        def step(batch: dict) -> dict:
            values, sizes = shingle_sets(batch["_text"])
            sets = np.split(values, np.cumsum(sizes)[:-1])
            digests = digests_of(values, sizes).tolist()
            return {"digest": digests, "shingles": [x.tobytes() for x in sets], "bits": [bitmap(x).tobytes() for x in sets]}

        return step

    # Rows alike in key and text answer more than once.
    return map_rows(texts, make, "digest bigint, shingles binary, bits binary").dropDuplicates(["digest"])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits that some shingle names, four times as many as shingles or more, as 64-bit words."""
    width = max(BITMAP, 4 << max(0, len(shingles) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def may_be_linked(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> bool:
    """False only if the sets surely are not linked: each bit in which the bitmaps differ stands for a shingle of one set alone."""
    if min(size_a, size_b) * 100 < SIMILAR * max(size_a, size_b):
        return False
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) <= most_apart(size_a + size_b)


def are_linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < SIMILAR * max(len(a), len(b)):
        return False
    return linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs ``u``, ``v`` those that are linked; bitmaps rule most others out before whole sets are shuffled."""

    def checked(pairs: DataFrame, column: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
        a = sets.select(F.col("digest").alias("u"), F.col(column).alias("a"), F.octet_length("shingles").alias("m"))
        b = sets.select(F.col("digest").alias("v"), F.col(column).alias("b"), F.octet_length("shingles").alias("n"))
        near = F.least("m", "n") * 100 >= SIMILAR * F.greatest("m", "n")
        return map_rows(pairs.join(a, "u").join(b, "v").where(near), make, "u bigint, v bigint")

    def by(test: Callable[[np.ndarray, np.ndarray, int, int], bool]) -> Callable[[], Callable[[dict], dict]]:
        def step(batch: dict) -> dict:
            each = zip(*(batch[c] for c in ("u", "v", "a", "b", "m", "n")), strict=True)
            kept = [(u, v) for u, v, x, y, m, n in each if test(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), m // 8, n // 8)]
            return {"u": [k[0] for k in kept], "v": [k[1] for k in kept]}

        return lambda: step

    likely = checked(pairs, "bits", by(may_be_linked))
    return checked(likely, "shingles", by(lambda x, y, m, n: are_linked(x, y)))


def _looked_into(keys: DataFrame, known: DataFrame) -> DataFrame:
    """``key`` and ``digest`` for the keys into which a set must look: its cheapest units, as many as the pigeonhole asks for."""
    keys = keys.withColumn("which", F.when(F.col("unit") > 0, F.col("unit")).otherwise(F.col("key")))
    keys = keys.withColumn("worth", F.when(F.col("unit") > 0, 2).otherwise(1))
    units = keys.groupBy("digest", "band", "which", "worth").agg(F.first("size").alias("size"), F.sum(F.col("members") - 1).alias("cost"))
    own = Window.partitionBy("digest", "band")
    rising = own.orderBy(F.col("cost") / F.col("worth"), "worth", "which").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        units.join(known, "band")
        .withColumn("shared", F.sum("worth").over(own))
        .withColumn("before", F.coalesce(F.sum("worth").over(rising), F.lit(0)))
        .withColumn("need", _most_apart(F.least("size", "end") + F.col("size")) + 1 - (F.col("units") - F.col("shared")))
        .where("before < need")
    )
    same = ["digest", "band", "which", "worth"]
    return keys.select(*same, "key").join(chosen.select(*same), same).select("digest", "key").distinct()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components among the rows (key, i, j, digest, part, block, shingles, bits) of each (key, i, j), side by side."""
    held: list[tuple] = []
    now = None

    def found() -> list[tuple[int, int]]:
        i, j = now[1:]
        digests, parts, blocks = (np.array(x) for x in list(zip(*held, strict=True))[:3])
        sets = [np.frombuffer(x[3], np.uint64) for x in held]
        sizes = np.array([len(s) for s in sets])
        bits = [np.frombuffer(x[4], np.uint64) for x in held]
        width = min(len(x) for x in bits)
        bits = np.stack([folded(x, width) for x in bits])
        out, joined = [], {p: p for p in set(parts.tolist())}
        for a in range(len(held) - 1):
            b = np.arange(a + 1, len(held))
            b = b[(parts[b] != parts[a]) & ((blocks[b] != blocks[a]) if i != j else True)]
            b = b[np.minimum(sizes[b], sizes[a]) * 100 >= SIMILAR * np.maximum(sizes[b], sizes[a])]
            apart = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1, dtype=np.int64)
            for k in b[apart * (100 + SIMILAR) <= (100 - SIMILAR) * (sizes[b] + sizes[a])].tolist():
                p, q = joined[int(parts[a])], joined[int(parts[k])]
                if p != q and are_linked(sets[a], sets[k]):
                    out.append((int(digests[a]), int(digests[k])))
                    joined.update({x: p for x, y in joined.items() if y == q})
        return out

    def table(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

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


def _residual(keys: DataFrame, parts: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links between components, or None if no key has sets of two."""
    named = keys.join(parts.withColumnRenamed("node", "digest"), "digest", "left").withColumn("part", F.coalesce("component", "digest"))
    named = stored(named.select("key", "digest", "band", "unit", "size", "part"))
    each = named.groupBy("key").agg(F.count("*").alias("members"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    open_ = stored(named.join(each.where("lo <> hi").select("key", "members"), "key"))
    looked = stored(_looked_into(open_, known))
    if looked.isEmpty():
        return None
    members = stored(open_.join(looked.select("key").distinct(), "key").select("key", "digest", "part", "members", "size").distinct())
    looks = members.join(looked, ["key", "digest"]).where(F.col("members") <= PAIRED)
    others = members.select("key", F.col("digest").alias("v"), F.col("part").alias("q"))
    pairs = looks.join(others, "key").where("part <> q").select(F.least("digest", "v").alias("u"), F.greatest("digest", "v").alias("v"))
    links = _verified(stored(pairs.distinct()), sets)
    large = members.where(F.col("members") > PAIRED)
    if large.isEmpty():
        return links
    # Units often hold the same sets; such a key is searched once.
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    facts = [blocks, F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("all"), F.min("digest").alias("least")]
    once = large.groupBy("key").agg(*facts).groupBy("blocks", "n", "all", "least").agg(F.min("key").alias("key")).select("key", "blocks")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    rows = large.join(once, "key").withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "part", "block")
    dealt = rows.join(sets, "digest").select("key", "i", "j", "digest", "part", "block", "shingles", "bits").repartition("key", "i", "j")
    return links.unionByName(dealt.sortWithinPartitions("key", "i", "j").mapInArrow(_across, "u bigint, v bigint"))


def linked_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """For ``rows`` (``_id``, ``_hash``, ``_text``) the documents (``_id``, ``_hash``, ``digest``, ``size``), and for the sets that
    have links ``node`` (the digest) and ``component``."""
    spark = rows.sparkSession
    chars, longest = rows.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0)), F.coalesce(F.max(F.length("_text")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS))
    kind = rows.schema["_id"].dataType.simpleString()
    plan = f"_id {kind}, _hash bigint, digest bigint, size bigint, key bigint, band byte, unit byte, first bigint"
    arrow = _arrow(plan)
    packed = _packed(rows, parts).repartitionById(parts, F.col("part"))
    told = stored(packed.mapInArrow(lambda batches: _shared(batches, arrow), plan))
    documents = told.where("key IS NULL").select("_id", "_hash", "digest", "size")
    known = bands(spark, longest // 2 + 2)
    keys = told.where("key IS NOT NULL").select("key", "digest", "size", "band", "unit", "first")
    keys = stored(_that_may_link(keys, known))
    if keys.isEmpty():
        return documents, None
    firsts = keys.where("digest <> first").groupBy("digest", "first").agg(F.count("*").alias("n"))
    pairs = stored(firsts.groupBy(F.col("digest").alias("u")).agg(F.max_by("first", F.struct("n", "first")).alias("v")))

    ends = keys.select("digest").unionByName(pairs.select(F.col("v").alias("digest"))).distinct()
    sets = stored(_sets(rows, documents, ends))
    # Written first: the forests of the union-find would run a second Python worker beside each of these.
    found = components(stored(_verified(pairs, sets)))
    more = _residual(keys.drop("first"), found, known, sets)
    if more is None:
        return documents, found
    return documents, components(found.where("node <> component").toDF("u", "v").unionByName(stored(more)))


def _arrow(plan: str) -> pa.Schema:
    return to_arrow_schema(schema_of(plan))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links, of every row."""
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    documents, parts = linked_sets(rows)
    part = F.col("digest")
    if parts is not None:
        documents = documents.join(parts.withColumnRenamed("node", "digest"), "digest", "left")
        part = F.coalesce("component", "digest")
    placed = stored(documents.select("_id", "size", part.alias("part")))
    least = placed.where("part IS NOT NULL").groupBy("part").agg(F.min("_id").alias("least"))
    whole = placed.join(least, "part", "left")
    own = F.when(F.col("part").isNull(), F.col("_id")).otherwise(F.col("least"))
    return whole.select(F.col("_id").alias(key), F.col("size").alias("n_shingles"), own.alias("component_id"))
