"""Fill-in-middle: a text's units are cut at two places, and the middle moves behind the rest.

Every code point gets a class that says whether a word, a line or the text ends with it; a wavelet matrix counts any class before
any position, and the counts of some classes together are the number of units that end there. Both cuts are found by bisection on
that number. Which form a text takes and where it is cut hangs on its key alone, so reruns and lost tasks give the same rows.

A unit is a word with the white space before it (white space at the end of the text is a unit of its own) or a line with its line
feed. Null texts count as empty; empty texts, and those that hold a marker, stay plain. A null key counts as an empty one. Repeated
rows come out as often as they come in, an empty table gives an empty one, and of the input only the named columns are read. Time
and memory are in proportion to the text, however long; several classes share three bits a code point.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a code point is: inside a word, the last of a word, white space, a line feed; from LAST on the last of the text.
INNER, WORD_END, SPACE, LINE_END, LAST = range(5)
LEVELS = 3
#: The classes that end a unit.
ENDS = {"word": (WORD_END, *range(LAST, LAST + 3)), "line": (LINE_END, *range(LAST, LAST + 3))}


class WaveletMatrix:
    """Symbols of ``LEVELS`` bits, with the count of each symbol before each position."""

    def __init__(self, symbols: np.ndarray):
        self.levels = []
        for shift in reversed(range(LEVELS)):
            bits = (symbols >> shift & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
            self.levels.append((memoryview(words), memoryview(before), len(bits) - int(np.count_nonzero(bits))))

    def rank(self, symbol: int, end: int) -> int:
        """How often ``symbol`` stands before ``end``."""
        begin = 0
        for shift, (words, before, zeros) in zip(reversed(range(LEVELS)), self.levels, strict=True):
            b = before[begin >> 6] + (words[begin >> 6] & (1 << (begin & 63)) - 1).bit_count()
            e = before[end >> 6] + (words[end >> 6] & (1 << (end & 63)) - 1).bit_count()
            begin, end = (zeros + b, zeros + e) if symbol >> shift & 1 else (begin - b, end - e)
        return end - begin


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    out = np.where(white, SPACE, INNER).astype(np.uint8)
    out[codes == 10] = LINE_END
    out[:-1][~white[:-1] & white[1:]] = WORD_END
    if len(out):
        out[-1] = LAST + max(out[-1], WORD_END) - WORD_END
    return out


class Units:
    """The units of a text: how many end by a position, and where the k-th ends."""

    def __init__(self, text: str, unit: str):
        self.length, self.ends, self.matrix = len(text), ENDS[unit], WaveletMatrix(classes(text))

    def by(self, position: int) -> int:
        return sum(self.matrix.rank(c, position) for c in self.ends)

    def end(self, k: int) -> int:
        return bisect_left(range(self.length + 1), k, key=self.by)


def moved(text: str, draws: tuple[int, int, int, int], rate: int, spm: int, unit: str) -> tuple:
    """Number of units, form, code points of prefix and middle (None if plain), and the output."""
    units = Units(text, unit)
    n = units.by(len(text))
    if not text or draws[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted(units.end(h % (n + 1)) for h in draws[:2])
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if draws[3] % 100 < spm:
        return n, "spm", first, second - first, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", first, second - first, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "word"
) -> DataFrame:
    """``key``, ``n``, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    ``rate`` percent of the texts are cut, ``spm`` percent of those with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), draws.alias("_draws"))
    kind = rows.schema["_key"].dataType.simpleString()

    def make():
        def step(batch: dict) -> dict:
            got = [moved(t, d, rate, spm, unit) for t, d in zip(batch["_text"], batch["_draws"], strict=True)]
            names = ("n", "form", "prefix_chars", "middle_chars", "output")
            return {"_key": batch["_key"]} | {c: [g[i] for g in got] for i, c in enumerate(names)}

        return step

    out = f"_key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_rows(rows, make, out).withColumnRenamed("_key", key)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that ``output`` was made from."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))

    def parted(x: Column, mark: str) -> tuple[Column, Column]:
        first = F.substring_index(x, mark, 1)
        return first, F.substr(x, F.length(first) + len(mark) + 1)

    body = F.substr(output, F.lit(len(PREFIX) + 1))
    psm_prefix, rest = parted(body, SUFFIX)
    psm_suffix, psm_middle = parted(rest, MIDDLE)
    spm_suffix, rest = parted(body, PREFIX)
    spm_prefix, spm_middle = parted(rest, MIDDLE)
    psm, spm = F.concat(psm_prefix, psm_middle, psm_suffix), F.concat(spm_prefix, spm_middle, spm_suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
