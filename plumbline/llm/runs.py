"""Periodic runs: stretches of words that repeat with a period, as far as they reach, and texts without the repeats.

The texts of a batch stand in one array of word numbers, apart by numbers that come once. How far two places agree (LCE) comes from
a difference cover: only suffixes that begin at positions whose remainder is in ``COVER`` are sorted, by doubling; any two places
reach two such positions after the same few words, which are compared, and from there the least common prefix of the sorted
neighbours between them (a sparse table) tells the rest. The same over the reversed array tells how far places agree backwards.

A run of period p and length 2p or more covers two neighbouring points of the grid 0, p, 2p, ... of its text, whose words are equal.
So for each p the neighbouring points with equal words are extended both ways; over all p the points of a text of n words are
n log n. A run found with multiples of its period keeps the least.

Null texts have no words, and texts of fewer than ``LENGTH`` words no runs. A text longer than a batch is a batch of its own, so that a
task's memory is in proportion to the longest text. Every row gives a row, repeated ones and those with a null key too, an empty
table an empty one; of the input only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows

#: Every remainder modulo ``MODULUS`` is a difference of two members of ``COVER``.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words that are looked at together, and pairs of grid points.
WORDS, POINTS = 1 << 18, 1 << 20
#: Least length of a run, and least number of periods.
LENGTH, PERIODS = 12, 2

_SLOT = np.full(MODULUS, -1)
_SLOT[list(COVER)] = range(len(COVER))
#: For each difference of two positions a remainder of the first at which both are in the cover.
_MEET = np.array([next(a for a in COVER if _SLOT[(a + d) % MODULUS] >= 0) for d in range(MODULUS)])


class CommonExtension:
    """Length of the longest common prefix of the suffixes at any two places of ``words`` (numbers from 1 on).

    The last number must come once, and so must some number between any two places that are asked for and the ends.
    """

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([words, np.zeros(2 * MODULUS, words.dtype)])
        at = np.arange(-(-len(words) // MODULUS))[:, None] * MODULUS + np.array(COVER)
        sampled = at.ravel()[: np.searchsorted(at.ravel(), len(words))]
        ranks = [self._blocks(sampled)]
        step = len(COVER)  # one block on
        while ranks[-1].max(initial=0) + 1 < len(sampled):
            behind = np.zeros(len(sampled), np.int64)
            behind[: max(0, len(sampled) - step)] = ranks[-1][step:] + 1
            ranks.append(_dense(ranks[-1].astype(np.int64) * (len(sampled) + 1) + behind))
            step *= 2
        self.rank = ranks[-1]
        order = np.empty(len(sampled), np.int64)
        order[self.rank] = np.arange(len(sampled))
        # Common prefix of neighbours: whole blocks by the ranks of each doubling, then word by word.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for level in reversed(range(len(ranks) - 1)):
            step, last = len(COVER) << level, len(sampled) - 1
            same = (np.maximum(a, b) <= last) & (ranks[level][np.minimum(a, last)] == ranks[level][np.minimum(b, last)])
            common += same * (MODULUS << level)
            a += same * step
            b += same * step
        first, second = sampled[order[:-1]] + common, sampled[order[1:]] + common
        least = common + self._direct(first, second, np.full(len(first), MODULUS))
        self.least = [least.astype(np.int32)]
        width = 1
        while 2 * width <= len(least):
            self.least.append(np.minimum(self.least[-1][:-width], self.least[-1][width:]))
            width *= 2

    def _blocks(self, sampled: np.ndarray) -> np.ndarray:
        """Ranks of the next ``MODULUS`` words, several of them packed into a sort key."""
        bits = max(1, int(self.words.max()).bit_length())
        per = max(1, 63 // bits)
        keys = []
        for begin in range(0, MODULUS, per):
            key = np.zeros(len(sampled), np.int64)
            for i in range(begin, min(begin + per, MODULUS)):
                key = key << bits | self.words[sampled + i]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(sampled), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        ranks = np.empty(len(sampled), np.int64)
        ranks[order] = np.cumsum(new)
        return ranks

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of the next ``most`` words agree, counted one by one."""
        out = np.zeros(len(i), np.int64)
        open_ = np.flatnonzero(most > 0)
        for t in range(MODULUS):
            open_ = open_[self.words[i[open_] + t] == self.words[j[open_] + t]]
            out[open_] = t + 1
            open_ = open_[most[open_] > t + 1]
            if not len(open_):
                break
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places ``i[k] != j[k]``."""
        shift = (_MEET[(j - i) % MODULUS] - i) % MODULUS
        out = self._direct(i, j, shift)
        on = np.flatnonzero(out == shift)
        a, b = (self._place(x[on] + shift[on]) for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            row, here = self.least[k], np.flatnonzero(level == k)
            out[on[here]] += np.minimum(row[low[here]], row[high[here] - (1 << int(k))])
        return out

    def _place(self, position: np.ndarray) -> np.ndarray:
        return self.rank[position // MODULUS * len(COVER) + _SLOT[position % MODULUS]]


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return ranks


def _grids(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and point (within the text), for points one period before another; about ``POINTS`` at a time."""
    halves = lengths // PERIODS
    texts = np.repeat(np.arange(len(lengths)), halves)
    periods = np.arange(len(texts)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    counts = (lengths[texts] - 1) // periods
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + POINTS, "right")))
        n = counts[begin:end]
        period = np.repeat(periods[begin:end], n)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(texts[begin:end], n), period, number * period
        begin = end


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run in texts of word numbers from 1 on, by text, start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    nothing = np.zeros(0, np.int64)
    if lengths.max(initial=0) < max(LENGTH, PERIODS):
        return nothing, nothing, nothing, nothing
    most = max(int(t.max(initial=0)) for t in texts)
    pieces = [np.array([most + 1])]
    for k, t in enumerate(texts):
        pieces += [t, np.array([most + 2 + k])]
    words = np.concatenate(pieces).astype(np.int64)
    begins = np.cumsum(lengths + 1) - lengths
    forward, backward, size = CommonExtension(words), CommonExtension(words[::-1].copy()), len(words)
    found = []
    for text, period, point in _grids(lengths):
        i = begins[text] + point
        same = np.flatnonzero(words[i] == words[i + period])
        text, period, i = text[same], period[same], i[same]
        right = forward(i, i + period)
        # The first grid point of a run has less than a period before it; others find the same run.
        may = np.flatnonzero(2 * period - 1 + right >= np.maximum(LENGTH, PERIODS * period))
        text, period, i, right = text[may], period[may], i[may], right[may]
        left = backward(size - i, size - i - period)
        length = left + period + right
        is_run = np.flatnonzero((left < period) & (length >= np.maximum(LENGTH, PERIODS * period)))
        rows = np.stack([text[is_run], (i - left - begins[text])[is_run], length[is_run], period[is_run]])
        found.append(_least_period(rows))
    text, start, length, period = _least_period(np.concatenate(found, axis=1))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _least_period(rows: np.ndarray) -> np.ndarray:
    """Of rows (text, start, length, period) alike in all but the period, the one with the least."""
    rows = rows[:, np.lexsort(rows[::-1])]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    return rows[:, first]


def _numbered(words: list[list[str]]) -> list[np.ndarray]:
    numbers: dict[str, int] = {}
    return [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in own), np.int64, len(own)) for own in words]


def _collapsed(words: list[list[str]], runs: tuple[np.ndarray, ...]) -> list[str]:
    """The texts without the words that some run holds behind its first period."""
    text, start, length, period = runs
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(lengths) - lengths
    change = np.zeros(int(lengths.sum()) + 1, np.int64)
    np.add.at(change, begins[text] + start + period, 1)
    np.add.at(change, begins[text] + start + length, -1)
    keep = np.cumsum(change) == 0
    touched = set(text.tolist())
    return [
        " ".join([w for w, k in zip(own, keep[b : b + len(own)].tolist(), strict=True) if k] if i in touched else own)
        for i, (own, b) in enumerate(zip(words, begins.tolist(), strict=True))
    ]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length, period by start and period) and ``collapsed`` (the kept words) of every row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def make():
        def together(words: list[list[str]]) -> tuple[list, list]:
            found = find_runs(_numbered(words))
            runs: list[list] = [[] for _ in words]
            for t, s, n, p in zip(*(x.tolist() for x in found), strict=True):
                runs[t].append({"start": s, "length": n, "period": p})
            return runs, _collapsed(words, found)

        def step(batch: dict) -> dict:
            out: dict[str, list] = {"_key": batch["_key"], "n_words": [], "runs": [], "collapsed": []}
            held: list[list[str]] = []
            size = 0

            def flush() -> None:
                if held:
                    runs, collapsed = together(held)
                    out["n_words"] += [len(w) for w in held]
                    out["runs"] += runs
                    out["collapsed"] += collapsed
                    held.clear()

            for value in batch["_text"]:
                # ASCII white space only, as of bytes.
                own = [w.decode() for w in (value or "").encode().split()]
                if size + len(own) > WORDS:
                    flush()
                    size = 0
                held.append(own)
                size += len(own)
            flush()
            return out

        return step

    out = f"_key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_rows(rows, make, out).withColumnRenamed("_key", key)
