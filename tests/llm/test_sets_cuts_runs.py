"""The n-gram join, fill-in-middle and periodic runs against brute force, on the small tables and on awkward rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import infill, ngram_join, queries, runs

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF_DIR}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"], strict=True))


def with_clashes(df):
    names = ("_id", "_hash", "_text", "_key", "digest", "size", "n", "form", "runs", "collapsed", "key", "part", "h", "words", "component_id")
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 700} x{i % 31}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, long), (7, long), (7, long), (8, long[:-7] + "zebra"),
        (9, "Éa İ ß x one TWO"), (None, "one two"), (None, None), (10, "a " * 500), (11, "one two"), (12, "x <S> y"), (13, "one two"),
    ]
    return with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))


def sets_of(rows):
    out = []
    for _, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def components_of(rows):
    """Rows of id, set size and least linked id by comparing all pairs."""
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [(key, len(s), least.get(top(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))]


def joined(df):
    return sorted(map(repr, map(tuple, ngram_join.similar_documents(df).collect())))


def test_pigeonhole():
    """No two linked sets differ in more shingles than a band's units allow for, whatever their sizes."""
    for size in range(1, 3_000):
        most = ngram_join.largest_linked(size)
        assert 100 * size >= 80 * most and 100 * size < 80 * (most + 1)
        for other in {size, most, (size + most) // 2}:
            apart = next(d for d in range(size + other, -1, -1) if (size + other - d) % 2 == 0 and ngram_join.linked((size + other - d) // 2, size, other))
            assert apart <= ngram_join.most_apart(size + other)
        ends = ngram_join.band_ends(size)
        assert ngram_join.segments(ends[-1]) > ngram_join.most_apart(ends[-1] + ngram_join.largest_linked(ends[-1]))


def test_units_of_sets_that_differ_in_few_shingles():
    """A segment alike but for one shingle shares a one-deletion key, wherever the shingle is and whichever set has it."""
    draw = np.random.default_rng(5)
    for size in (4, 9, 40, 300):
        for _ in range(20):
            base = np.unique(draw.integers(0, 1 << 63, size, np.uint64))
            more = np.unique(np.append(base, draw.integers(0, 1 << 63, 1, np.uint64)))
            keys = [{b: (k, u) for _, b, k, u in ngram_join.keys_of(s, np.array([len(s)]))} for s in (base, more)]
            for band in set(keys[0]) & set(keys[1]):
                (a, units), (b, others) = keys[0][band], keys[1][band]
                shared = set(a.tolist()) & set(b.tolist())
                end = ngram_join.band_ends(size + 1)[band]
                by_deletion = {u for k, u in zip(a.tolist(), units.tolist(), strict=True) if u and k in shared}
                assert len(by_deletion) == ngram_join.deletions(end)
                m = ngram_join.segments(end)
                assert len(set(a[:m].tolist()) & set(b[:m].tolist())) == m - 1
                assert (others[m:] > 0).all()


def test_sets_of_many_texts(monkeypatch):
    """Sets made together are those of each text alone, wherever stretches of bytes end."""
    draw = random.Random(8)
    texts = ["".join(draw.choice("aA bB\té\n  zİ") for _ in range(draw.randrange(60))) for _ in range(300)]
    texts += [None, "", " ", "x" * 3_000, "X" * 3_000 + " " + "x" * 2_999, "q r s t"]
    for stretch in (1, 7, ngram_join.STRETCH):
        monkeypatch.setattr(ngram_join, "STRETCH", stretch)
        values, sizes = ngram_join.shingle_sets(texts)
        digests = ngram_join.digests_of(values, sizes)
        sets = sets_of(list(enumerate(texts)))
        assert sizes.tolist() == [len(s) for s in sets]
        by_set = {}
        for digest, s in zip(digests.tolist(), sets, strict=True):
            assert by_set.setdefault(frozenset(s), digest) == digest
        assert len(set(by_set.values())) == len(by_set)
        for i in (0, 17, 300, 304):
            alone, _ = ngram_join.shingle_sets([texts[i]])
            assert alone.tolist() == values[sizes[:i].sum() : sizes[: i + 1].sum()].tolist()


@needs_tables
def test_join_equals_all_pairs(spark, texts):
    rows = list(texts.items())
    got = joined(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == sorted(map(repr, components_of(rows)))


def test_join_of_awkward_rows(spark, awkward):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert joined(awkward) == sorted(map(repr, components_of(rows)))
    empty = ngram_join.similar_documents(awkward.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id"]


def test_join_of_hot_groups(spark, monkeypatch):
    """Chains of near copies, and texts that are alike to just under and just over the limit through one passage of all."""
    draw = random.Random(11)

    def fresh(n):
        return [f"w{draw.randrange(10**9)}" for _ in range(n)]

    rows, passage = [], fresh(120)
    for _ in range(60):  # one passage and words of its own: 0.6 to 0.75 alike
        rows.append(passage + fresh(draw.randrange(15, 40)))
    for _ in range(6):  # chains: each text differs a little from the one before
        text = fresh(draw.randrange(40, 200))
        for _ in range(12):
            rows.append(list(text))
            for _ in range(draw.randrange(1, 4)):
                text[draw.randrange(len(text))] = fresh(1)[0]
            text += fresh(draw.randrange(3))
    for _ in range(30):  # short texts, a word apart
        text = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"][: draw.randrange(1, 11)]
        rows.append(text[:-1] + [draw.choice("jxyz")])
    rows += [r + fresh(1) for r in rows[:40]] + rows[:20]
    draw.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want = sorted(map(repr, components_of(rows)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(df) == want
    # Small packs and blocks take the paths of large tables.
    monkeypatch.setattr(ngram_join, "PACKED", 500)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "PAIRED", 3)
    monkeypatch.setattr(ngram_join, "CHARS", 4_000)
    assert joined(df.repartition(3)) == want


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, text
    if h4 % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units_and_cuts():
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice("ab é\n\t<P>😀 \x1c ") for _ in range(draw.randrange(200)))
        for unit, pattern in (("word", UNIT), ("line", re.compile(r"[^\n]*\n|[^\n]+"))):
            ends = [0, *(m.end() for m in pattern.finditer(text))]
            units = infill.Units(text, unit)
            assert units.by(len(text)) == len(ends) - 1
            assert [units.end(k) for k in range(len(ends))] == ends


def test_ranks():
    symbols = np.random.default_rng(2).integers(0, 8, 1_000).astype(np.uint8)
    for size in (0, 1, 63, 64, 65, 1_000):
        matrix = infill.WaveletMatrix(symbols[:size])
        for symbol in range(8):
            for end in {0, size // 3, size // 2, size}:
                assert matrix.rank(symbol, end) == int((symbols[:end] == symbol).sum())


@needs_tables
def test_fill_in_middle_equals_cut_lists(spark, texts, awkward):
    wide = spark.createDataFrame([(i + 1000, t) for i, t in enumerate(["< <S", "a<", "<P", "\n\n a", "b \n"] * 40)], "doc_id bigint, text string")
    for df in (spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), awkward, wide):
        made = infill.fill_in_middle(df)
        got = made.withColumn("back", infill.restored("output", "form")).collect()
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr(cut(*r)) for r in rows)
        assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
        assert infill.fill_in_middle(df.limit(0)).collect() == []
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_by_lines(spark):
    df = spark.createDataFrame([(i, "one\ntwo three\n\nfour" * (i % 5)) for i in range(60)], "doc_id bigint, text string")
    for r in infill.fill_in_middle(df, unit="line", rate=100).join(df, "doc_id").collect():
        if r["form"] != "plain":
            first, second = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            for at in (first, second):
                assert at in (0, len(r["text"])) or r["text"][at - 1] == "\n"


def runs_by_scan(words):
    """Start, length and period of every run, by comparing words at every distance."""
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(12, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def odd_texts(draw):
    fib, word = [1], [1, 2]
    for _ in range(draw.randrange(9)):
        fib, word = word, word + fib
    n = draw.randrange(90)
    block = [draw.randrange(1, 6) for _ in range(draw.randrange(1, 9))]
    broken = (block * 90)[:n]
    if broken:
        broken[draw.randrange(len(broken))] = 7
    return [word[:n], broken, [draw.randrange(1, 3) for _ in range(n)], [1] * n, list(range(1, n + 1))]


def test_runs_equal_scans(monkeypatch):
    draw = random.Random(3)
    for points in (50, runs.POINTS):
        monkeypatch.setattr(runs, "POINTS", points)
        for _ in range(60):
            texts = odd_texts(draw)
            got = runs.find_runs([np.array(t, np.int64) for t in texts])
            want = [(k, *r) for k, t in enumerate(texts) for r in runs_by_scan(t)]
            assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_common_extension_equals_comparison():
    draw = np.random.default_rng(4)
    words = np.concatenate([[9], draw.integers(1, 3, 400), [8], np.ones(300, np.int64), [7]]).astype(np.int64)
    lce = runs.CommonExtension(words)
    i, j = draw.integers(1, 400, 2_000), draw.integers(402, 702, 2_000)
    for a, b, got in zip(i, j, lce(i, j), strict=True):
        n = 0
        while words[a + n] == words[b + n]:
            n += 1
        assert got == n


def run_row(key, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs_by_scan(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    each = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return key, len(found), *first, hashlib.sha256(each.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


@needs_tables
def test_runs_of_documents_equal_scans(spark, texts, awkward, tmp_path):
    short = [(i, t) for i, t in texts.items() if len(t or "") < 8_000]
    odd = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect() if len(r["text"] or "") < 8_000]
    periodic = [(i, " ".join(["x y", "x y z q"][i % 2] for _ in range(30)) + " end") for i in range(900, 960)]
    rows = short + odd + periodic
    with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(run_row(*r)) for r in rows)
    empty = runs.periodic_runs(awkward.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_very_long_texts():
    """Texts longer than a batch, without, with one and with very many repeats."""
    draw = np.random.default_rng(6)
    block = draw.integers(1, 1 << 40, 1_000)
    long = [np.ones(300_000, np.int64), np.tile(block, 300), draw.integers(1, 1 << 40, 300_000)]
    got = [tuple(x.tolist() for x in runs.find_runs([t])) for t in long]
    assert got == [([0], [0], [300_000], [1]), ([0], [0], [300_000], [1_000]), ([], [], [], [])]
