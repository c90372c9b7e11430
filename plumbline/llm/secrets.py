"""Secrets in texts: fixed patterns, and strings that a compressor primed for their surroundings finds new.

A candidate is an unbroken string of letters, digits and ``+/_-=`` after a sensitive word: of two or more kinds of character
(lower case, upper case, digits), or with ``ONE_KIND`` letters of one kind in a row. It adds some bytes to the zstandard size of
the text before it, with dictionaries of code, of identifiers and of the corpus's own words loaded. Random strings of the same
length, with the same kind of character at each place, are put in its stead; the candidate is reported if it adds ``NOVELTY`` of
what these add on average. So the limit follows the alphabet and the length, and whether the compressor happens to code single
characters there or not weighs on both sides alike. All is compressed in lower case, so a known word stays known however it is
written. Prose, code words and repetitions of the surroundings add next to nothing. Long candidates are judged in pieces, and
reported if one of them is new. Candidates that overlap a span of the fixed patterns are not reported again. Text after a
candidate does not count, or a key that a text states twice would be hidden both times.

The corpus's words are strings that follow three different words or more, counted over every whole text in Spark; a key repeated
by copies does not. The dictionary holds ``LEARNT`` characters of those that follow most words.

Null and empty texts have no spans, an empty table gives none; texts are searched whole and in time proportional to their
length; repeated rows give repeated results; only the named columns are read. Spans are in code points, ``end`` exclusive, by
start and then by kind.
"""

from __future__ import annotations

import random
import re
import string as letters
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPANS, map_rows

KINDS = ["assign", "access", "hex"]
ORDER = {k: i for i, k in enumerate([*KINDS, "novel"])}

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Words after which a string may be a secret, and how far after the word it may begin.
CUE = re.compile(
    r"password|passwd|passphrase|pwd|secret|token|api[_ -]?key|private[_ -]?key|credential|bearer|authorization|signing[_ -]?key",
    re.ASCII | re.IGNORECASE,
)
REACH, LEAST = 40, 10
STRING = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Code points of text before a candidate that are compressed with it.
AROUND = 400
#: Least part of what random strings add that a candidate must add, and how many of these are tried.
NOVELTY, REFERENCES = 0.75, 5
#: The level of the compressor; one that looks for matches of three bytes, also in the dictionaries.
LEVEL = 19
#: How many characters of a candidate are judged together, for that and for their kinds.
WEIGHED = 256
#: Letters of one kind in a row that make a string without a second kind a candidate.
ONE_KIND = 16
KIND = re.compile(rf"[a-z]{{{ONE_KIND},}}|[A-Z]{{{ONE_KIND},}}")
ALPHABETS = (letters.ascii_lowercase, letters.ascii_uppercase, letters.digits)
#: Different words before a string that make it one of the corpus, and most characters of the dictionary that these make.
CONTEXTS, LEARNT = 3, 100_000
#: Characters of a string of the corpus, at least.
SHORTEST = 6
WORD = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Pairs of a string and the word before it that a task gathers before it hands them on.
GATHERED = 1 << 19

CODE_DICTIONARY = (
    "import from return class function static public private protected void const let var def self this null None true false "
    "if else elif for while switch case break continue try except catch finally throw raise with async await yield lambda new "
    "string integer boolean double float object array list dict map set print console.log System.out.println #include <stdio.h> "
    "SELECT FROM WHERE INSERT INTO VALUES UPDATE SET DELETE export default require module.exports package interface implements "
    'http:// https:// www. .com .org .net localhost 127.0.0.1 0123456789 {"": ""} = ": " != == => -> && || () {} [];\n'
)
IDENTIFIER_DICTIONARY = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key client_id client_secret user_name "
    "username user_id account email address authorization bearer credential credentials session cookie config settings database "
    "connection host port server endpoint request response header content type application json charset utf-8 environment "
    "variable example placeholder changeme your_password_here your_token_here insert_key_here undefined development production "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ qwertyuiop asdfghjkl zxcvbnm 1234567890 xxxxxxxx ******** ........\n"
)


class Novelty:
    """What a string adds to the compressed size of the text before it, as a part of what random strings of its kinds add."""

    def __init__(self, dictionary: str):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False
        ).compress
        # A text that repeats itself, with a sensitive word each time, is judged once for each piece that differs.
        self.share = lru_cache(maxsize=1 << 12)(self._share)

    def _share(self, before: str, candidate: str) -> float:
        around = before.lower().encode(errors="replace")
        alone = len(self.compress(around))

        def added(string: str) -> int:
            return len(self.compress(around + string.lower().encode())) - alone

        expected = sum(added(r) for r in random_strings(candidate)) / REFERENCES
        return added(candidate) / expected if expected > 0 else 0.0


def random_strings(like: str) -> list[str]:
    """Strings with the same kind of character at each place, the same ones whenever ``like`` is the same."""
    draw = random.Random(like)
    kinds = [next((a for a in ALPHABETS if c in a), c) for c in like]
    return ["".join(draw.choice(k) for k in kinds) for _ in range(REFERENCES)]


def keylike(string: str) -> bool:
    """Whether a string has two kinds of character, or enough letters of one kind in a row."""
    return sum(bool(re.search(p, string)) for p in ("[a-z]", "[A-Z]", "[0-9]")) >= 2 or bool(KIND.search(string))


class Spans:
    """Which of some spans overlap a given one; found by bisection, since a long text may hold very many."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def after(self, at: int) -> int:
        """Number of the first span that ends after ``at``."""
        return bisect_right(self.ends, at)

    def overlap(self, start: int, end: int) -> bool:
        n = self.after(start)
        return n < len(self.starts) and self.starts[n] < end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[str, int, int]]:
    """Strings near a sensitive word that look like keys and that the surroundings do not foretell."""
    cues = [m.end() for m in CUE.finditer(text)]
    if not cues:
        return []
    last: dict[int, int] = {}

    def new(start: int, end: int) -> bool:
        string = text[start:end]
        return keylike(string) and novelty.share(text[max(0, start - AROUND) : start], string) >= NOVELTY

    def last_new(n: int) -> int:
        """Where the last new piece after the first of a string begins, or -1; judged once however many cues stand in the string."""
        if n not in last:
            begins = range(strings.starts[n] + WEIGHED, strings.ends[n] - LEAST + 1, WEIGHED)
            ends = [*begins[1:], strings.ends[n]]
            last[n] = next((b for b, e in zip(reversed(begins), reversed(ends)) if new(b, e)), -1)
        return last[n]

    strings, spans = Spans([m.span() for m in STRING.finditer(text)]), Spans([(s, e) for _, s, e in taken])
    found, seen = [], set()
    for cue in cues:
        for n in range(strings.after(cue), len(strings.starts)):
            start, end = max(strings.starts[n], cue), strings.ends[n]
            if start > cue + REACH:
                break
            if end - start < LEAST or start in seen or spans.overlap(start, end):
                continue
            seen.add(start)
            # A rest that is too short for a candidate is judged with the piece before it.
            one = end - start < WEIGHED + LEAST
            if new(start, end if one else start + WEIGHED) or (not one and last_new(n) > start):
                found.append(("novel", start, end))
    return found


def word_pairs(text: str) -> set[tuple[str, str]]:
    """The different pairs of neighbouring words of which the second may hold a string."""
    words = text.split()
    return {pair for pair in zip(words, words[1:]) if len(pair[1]) >= SHORTEST}


def common_strings(pieces: list[str]) -> str:
    """Strings that follow ``CONTEXTS`` different words in the pieces, those of most contexts last, where matches are cheapest."""
    before: dict[str, set[str]] = defaultdict(set)
    for piece in pieces:
        for last, word in word_pairs(piece):
            for string in WORD.findall(word):
                before[string].add(last)
    known = sorted((w for w in before if len(before[w]) >= CONTEXTS), key=lambda w: (-len(before[w]), w))
    taken, size = [], 0
    for w in known:
        size += len(w) + 1
        if size > LEARNT:
            break
        taken.append(w)
    return " ".join(reversed(taken)) + " "


class Hashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of a task's texts with hashes of the different words before each, ``GATHERED`` pairs at a time."""
    before: dict[str, set[int]] = defaultdict(set)
    hashes, size = Hashes(), 0

    def table() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, before.values())], dtype=np.int32)
        words = np.fromiter(chain.from_iterable(before.values()), np.uint64, ends[-1]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(words))
        return pa.RecordBatch.from_arrays([pa.array(list(before), pa.string()), lists], names=["string", "before"])

    for batch in batches:
        for x in batch.column(0):
            pairs = word_pairs(x.as_py())
            for last, word in pairs:
                for string in WORD.findall(word):
                    before[string].add(hashes[last])
            size += len(pairs)
            if size >= GATHERED:
                yield table()
                before.clear()
                hashes.clear()
                size = 0
    yield table()


def corpus_dictionary(docs: DataFrame, text: str = "text") -> str:
    """The corpus's own words, as ``common_strings`` of all whole texts; words before a string are told apart by 64-bit hashes.

    Every text is read once. At most ``LEARNT`` characters reach the driver.
    """
    gathered = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(_contexts, "string string, before array<bigint>")
    # A string's rows meet in one task, each with the words of many texts; there the pairs are made distinct and counted.
    pairs = gathered.repartition("string").select("string", F.explode("before").alias("before")).distinct()
    known = pairs.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CONTEXTS)
    order = [F.desc("n"), F.asc("string")]
    # No more strings than these have room in the dictionary, so one task can add up their lengths.
    best = known.orderBy(*order).limit(LEARNT // (SHORTEST + 1))
    size = F.sum(F.length("string") + 1).over(Window.orderBy(*order))
    taken = [r["string"] for r in best.withColumn("size", size).where(F.col("size") <= LEARNT).orderBy(*order).collect()]
    return " ".join(reversed(taken)) + " " if taken else ""


def find_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    code: str = CODE_DICTIONARY,
    identifiers: str = IDENTIFIER_DICTIONARY,
    corpus: str | None = None,
) -> DataFrame:
    """``key`` and ``spans`` of every text; ``base`` marks those of the fixed patterns.

    ``corpus`` holds known strings of the corpus; without it they are learnt from ``docs``.
    """
    known = (corpus_dictionary(docs, text) if corpus is None else corpus) + identifiers + code

    def make():
        novelty = Novelty(known)

        def of(x: str | None) -> list[dict]:
            if not x:
                return []
            base = base_spans(x)
            spans = [(*s, True) for s in base] + [(*s, False) for s in novel_spans(x, base, novelty)]
            spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
            return [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans]

        return lambda batch: {key: batch[key], "spans": [of(x) for x in batch[text]]}

    return map_rows(docs.select(key, text), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPANS}")
