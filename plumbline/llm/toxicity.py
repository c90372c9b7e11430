"""Toxicity scores from the nearest labelled examples by TF-IDF cosine, found with a block-max inverted index.

Terms are runs of letters in lower case. Which terms tell the classes apart is learnt from the examples, how rare they are from
all documents; the cosine is over those terms alone, as over all terms the neighbours are alike in subject, not in tone. A term
tells by its evidence, the log-odds against a split as uneven as its own by chance: of the ``TERMS`` with the highest chi-square
as many are taken as leave at most a share of ``FALSE`` to chance (Benjamini and Hochberg), by one rule for few examples and many. The examples are a sample of the labelled rows, at most ``EXAMPLES`` of them; what the tasks get
is their index, whose size that number and ``TERMS`` bound. A search adds up each block's best possible cosine over the terms of
the text, visits blocks from the best bound down, and stops when no block can beat the k-th cosine found: the neighbours are
exact. Their votes, weighted by closeness and drawn towards the overall rate, are mapped to the toxic share of examples with
such votes, each example judged by the others.

Null and empty texts, and texts without an indexed term, get the toxic share of examples without one. Of equally close examples
the lower number wins, an order fixed by a hash of the key. Repeated rows get repeated results and make one example; labels without
key or class are left out, and a key labelled twice counts as toxic if either says so. Without examples every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows

#: Most labelled rows that become examples, most terms, share of them that may tell by chance, least ratio between the classes' shares.
EXAMPLES, TERMS, FALSE, RATIO = 20_000, 512, 0.05, 3.0
NEIGHBOURS, BLOCK = 15, 64
#: Blocks visited at a time, the error allowed for in sums of weights, and the vectors whose scores a task keeps.
AT_ONCE, EPS, CACHED = 4, 1e-9, 20_000
#: Strength of the overall rate against the votes, in votes of cosine 1.
PRIOR = 0.25
STEPS = 12
WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = EXAMPLES) -> DataFrame:
    """``_n``, ``_key``, ``_text`` and ``_label`` of a sample of labelled rows, the first ``most`` by a hash of the key.

    A key that several rows share is one example, by its first text in order, however many rows it has.
    """
    chosen = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
        .where("_key IS NOT NULL AND _label IS NOT NULL")
        .groupBy("_key").agg(F.max("_label").alias("_label"))
        .withColumn("_n", F.xxhash64(F.col("_key").cast("string"))).orderBy("_n", "_key").limit(most)
    )
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    return texts.groupBy("_n", "_key", "_label").agg(F.min("_text").alias("_text"))


def telling_terms(sample: DataFrame, most: int = TERMS) -> list[str]:
    """The terms that tell the classes apart, those with the highest chi-square first.

    A term's evidence is n * KL(its own split, the split of the examples); by chance it is as high with odds of exp(-evidence) at most.
    """

    def make():
        def step(batch: dict) -> dict:
            counts: dict[str, list[int]] = {}
            for x, y in zip(batch["_text"], batch["_label"], strict=True):
                for t in set(terms(x)):
                    counts.setdefault(t, [0, 0])[bool(y)] += 1
            return {"term": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

        return step

    total = sample.agg(F.count(F.when(F.col("_label") == 0, 1)).alias("c"), F.count(F.when(F.col("_label") != 0, 1)).alias("t")).first()
    c, t = total["c"], total["t"]
    if not c or not t:
        return []
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")

    def part(x, rate: float):
        return F.when(x > 0, x * F.log(x / (a + b) / F.lit(rate))).otherwise(F.lit(0.0))

    share, other = (a + 0.5) / (t + 1), (b + 0.5) / (c + 1)
    counted = map_rows(sample, make, "term string, clean bigint, toxic bigint").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    chi = F.pow(a * (c - b) - b * (t - a), 2) / ((a + b) * F.greatest(c + t - a - b, F.lit(1.0)))
    counted = counted.withColumn("chi", chi).withColumn("evidence", part(a, t / (c + t)) + part(b, c / (c + t)))
    # Terms so rare that no split of theirs could tell do not count among the tried ones.
    tried = counted.where((a + b) * -math.log(min(c, t) / (c + t)) >= -math.log(FALSE)).count()
    best = (
        counted.where(F.greatest(share / other, other / share) >= RATIO)
        .orderBy(F.desc("chi"), "term").limit(most).select("term", "evidence").collect()
    )
    needed = [math.log(max(1, tried) / (FALSE * n)) for n in range(1, len(best) + 1)]
    least = min((x for x, y in zip(needed, sorted((r["evidence"] for r in best), reverse=True), strict=True) if y >= x), default=math.inf)
    return [r["term"] for r in best if r["evidence"] >= least]


def document_shares(docs: DataFrame, text: str, chosen: list[str]) -> dict[str, float]:
    """Inverse document frequency of each chosen term over all documents."""

    def make():
        wanted = set(chosen)

        def step(batch: dict) -> dict:
            counts: Counter = Counter()
            for x in batch[text]:
                counts.update(wanted.intersection(terms(x)))
            counts[""] = len(batch[text])  # no term is empty: the number of documents
            return {"term": list(counts), "n": list(counts.values())}

        return step

    rows = map_rows(docs.select(text), make, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen = {r["term"]: r["n"] for r in rows}
    return {t: math.log((1 + seen.get("", 0)) / (1 + seen.get(t, 0))) + 1 for t in chosen}


def vector(words: list[str], weights: dict[str, float]) -> dict[str, float]:
    """Cosine-normalised TF-IDF over the chosen terms."""
    counts = Counter(w for w in words if w in weights)
    raw = {t: (1 + math.log(n)) * weights[t] for t, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {t: v / norm for t, v in sorted(raw.items())}


@dataclass
class BlockMaxIndex:
    """Postings by term, cut into blocks of example numbers, with each block's place in them and its highest weight."""

    size: int
    postings: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    cuts: dict[str, list[int]] = field(default_factory=dict)
    peaks: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, vectors: list[dict[str, float]]) -> BlockMaxIndex:
        lists: dict[str, list[tuple[int, float]]] = {}
        for n, v in enumerate(vectors):
            for t, w in v.items():
                lists.setdefault(t, []).append((n, w))
        index, blocks = cls(len(vectors)), -(-len(vectors) // BLOCK)
        for t, entries in lists.items():
            at, weight = np.array([n for n, _ in entries]), np.array([w for _, w in entries])
            peak = np.zeros(blocks)
            np.maximum.at(peak, at // BLOCK, weight)
            index.postings[t], index.peaks[t] = (at, weight), peak
            index.cuts[t] = np.searchsorted(at, np.arange(blocks + 1) * BLOCK).tolist()
        return index

    def nearest(self, query: dict[str, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a cosine above 0, ties by number."""
        shared = [(w, *self.postings[t], self.cuts[t], self.peaks[t]) for t, w in query.items() if t in self.postings]
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        if not shared:
            return best_at, best
        bound = sum(w * peak for w, *_, peak in shared)
        left = np.argsort(-bound, kind="stable")
        left = left[bound[left] > 0]
        while len(left):
            blocks, left = left[:AT_ONCE].tolist(), left[AT_ONCE:]
            parts = [(at[c[b] : c[b + 1]], w * weight[c[b] : c[b + 1]]) for w, at, weight, c, _ in shared for b in blocks if c[b] < c[b + 1]]
            numbers, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            cosine = np.round(np.bincount(where, np.concatenate([p for _, p in parts])), 12)
            own = numbers != without
            best_at, best = np.concatenate([best_at, numbers[own]]), np.concatenate([best, cosine[own]])
            keep = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[keep], best[keep]
            if len(best) == k:  # a block may still hold a closer example, or one as close with a lower number
                may = (bound[left] > best[-1] + EPS) | ((bound[left] > best[-1] - EPS) & (left * BLOCK < best_at[-1]))
                left = left[may]
        return best_at, best


@dataclass
class Model:
    weights: dict[str, float]
    index: BlockMaxIndex
    labels: np.ndarray
    keys: list
    rate: float
    untold: float
    votes: np.ndarray
    shares: np.ndarray
    known: dict = field(default_factory=dict)

    def vote(self, query: dict[str, float], without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        at, cosine = self.index.nearest(query, NEIGHBOURS, without)
        weight = cosine / (1.05 - np.minimum(cosine, 1.0))
        return (float(weight @ self.labels[at]) + PRIOR * self.rate) / (float(weight.sum()) + PRIOR), at, cosine

    def score(self, text: str | None) -> tuple[float, list]:
        """The calibrated score, and the nearest examples by key."""
        query = vector(terms(text), self.weights)
        if not query:
            return self.untold, []
        same = tuple(query.items())
        if same in self.known:
            return self.known[same]
        vote, at, cosine = self.vote(query)
        evidence = [{"example": self.keys[i], "toxic": int(self.labels[i]), "cosine": float(c)} for i, c in zip(at[:3], cosine[:3], strict=True)]
        if len(self.known) >= CACHED:
            self.known.clear()
        self.known[same] = (float(np.interp(vote, self.votes, self.shares)) if len(self.votes) else vote), evidence
        return self.known[same]


def calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising map from votes to toxic shares: equal parts of the sorted votes, neighbours pooled until they rise."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(STEPS, max(1, len(order) // 20))):
        if not len(part):
            continue
        pools.append([float(votes[part].sum()), float(labels[part].sum()), float(len(part))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([v / n for v, _, n in pools]), np.array([(p + 0.5) / (n + 1) for _, p, n in pools])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model from ``labels`` (every row of which may be learnt from) and the texts of ``docs``."""
    sample = examples(docs, labels, key, text, label)
    chosen = telling_terms(sample)
    weights = document_shares(docs, text, chosen)

    def make():
        def step(batch: dict) -> dict:
            found = [sorted(Counter(w for w in terms(x) if w in weights).items()) for x in batch["_text"]]
            return {"_n": batch["_n"], "_key": batch["_key"], "_label": batch["_label"],
                    "counts": [[{"term": t, "n": n} for t, n in f] for f in found]}

        return step

    kind = sample.schema["_key"].dataType.simpleString()
    rows = map_rows(sample, make, f"_n bigint, _key {kind}, _label int, counts array<struct<term:string,n:int>>").collect()
    rows.sort(key=lambda r: (r["_n"], str(r["_key"]), r["counts"]))
    told = [r for r in rows if r["counts"]]
    untold = [r["_label"] != 0 for r in rows if not r["counts"]]
    vectors = []
    for r in told:
        raw = {c["term"]: (1 + math.log(c["n"])) * weights[c["term"]] for c in r["counts"]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors.append({t: v / norm for t, v in raw.items()})
    y = np.array([float(r["_label"] != 0) for r in told])
    rate = sum(r["_label"] != 0 for r in rows) / max(1, len(rows))
    empty = np.zeros(0)
    model = Model(weights, BlockMaxIndex.of(vectors), y, [r["_key"] for r in told], rate, (sum(untold) + rate) / (len(untold) + 1), empty, empty)
    if len(told) >= 40:  # fewer make one step, which maps all votes to one share
        votes = np.array([model.vote(v, i)[0] for i, v in enumerate(vectors)])
        model.votes, model.shares = calibrate(votes, y)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` and ``evidence`` (the three nearest examples) of every row."""
    def make():
        def step(batch: dict) -> dict:
            got = [model.score(x) for x in batch[text]]
            return {key: batch[key], "score": [s for s, _ in got], "evidence": [e for _, e in got]}

        return step

    kind = docs.schema[key].dataType.simpleString()
    evidence = f"array<struct<example:{kind},toxic:int,cosine:double>>"
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, score double, evidence {evidence}")


def may_learn(key: str = "doc_id"):
    """Rows whose label may be learnt: the rest of CRC-32 of the key as text by 3 is not 1."""
    return F.crc32(F.col(key).cast("string")) % 3 != 1


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    def make():
        def step(batch: dict) -> dict:
            kept = [i for i, x in enumerate(batch[text]) if model.score(x)[0] < threshold]
            return {n: [v[i] for i in kept] for n, v in batch.items()}

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_rows(docs, make, schema)
