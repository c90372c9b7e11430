"""Operators that learn or that compare with a benchmark, and the pipeline: held-out accuracy, planted cases, awkward rows."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from plumbline.llm import bpe, decontaminate, language, lines, queries, simhash, toxicity
from plumbline.llm.common import table

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "."), (None, "you idiot"), (4, "idiot " * 40_000), (5, "a plain text\nof two lines")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = ("_id", "_hash", "_text", "_gone", "_of", "_n", "_same", "score", "fingerprint", "_words", "_at", "_seed", "spans")
    return df.withColumns({n: F.lit(n) for n in names})


def empty(df):
    return df.where("false")


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op3_toxicity(spark, SF_DIR).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF_DIR, "labels").collect()}
    assert len(rows) == table(spark, SF_DIR, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    held = [(rows[i]["score"], y, rows[i]["predicted"]) for i, y in labels.items() if rows[i]["held_out"]]
    hit = sum(p for _, y, p in held if y)
    assert hit >= 0.7 * sum(y for _, y, _ in held) and sum(p for _, y, p in held if not y) <= 0.02 * len(held)
    assert any(r["evidence"] for r in rows.values())


def test_nearest_examples_are_exact():
    rng = random.Random(5)
    words = [f"t{i}" for i in range(30)]
    weights = {w: 1 + rng.random() for w in words}
    vectors = [toxicity.vector(rng.choices(words, k=rng.randrange(1, 6)), weights) for _ in range(700)]
    index = toxicity.BlockMaxIndex.of(vectors)
    for _ in range(60):
        query = toxicity.vector(rng.choices(words, k=4), weights)
        cosine = [round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12) for v in vectors]
        want = sorted((i for i, c in enumerate(cosine) if c > 0), key=lambda i: (-cosine[i], i))[:15]
        assert index.nearest(query, 15)[0].tolist() == want
        assert want[0] not in index.nearest(query, 15, want[0])[0].tolist()


def test_toxicity_of_awkward_rows(spark, clashing):
    labels = spark.createDataFrame([(5, 0), (4, 1), (4, 0), (None, 1), (6, None)], "doc_id bigint, toxic int")
    for learnt in (labels, empty(labels)):
        model = toxicity.fit(clashing, learnt)
        assert toxicity.score(clashing, model).count() == 7 and toxicity.score(empty(clashing), model).count() == 0
    kept = toxicity.keep_clean(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == 7
    assert toxicity.fit(empty(clashing), labels).score("x")[0] == 0.0
    often = toxicity.examples(clashing.union(clashing), labels, "doc_id", "text", "toxic").collect()
    assert sorted((r["_key"], r["_label"]) for r in often) == [(4, 1), (5, 0)]


def test_few_examples_have_neighbours(spark):
    """Among fewer than 40 examples no chi-square reaches 40; the scores still tell the classes apart."""
    rows = [(n, f"{'vile scum' if n % 3 == 0 else 'kind words'} w{'abcdefghij'[n % 10]}") for n in range(30)]
    docs = spark.createDataFrame([*rows, (90, "such vile scum"), (91, "such kind words"), (92, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, int(n % 3 == 0)) for n, _ in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert got[90]["score"] >= queries.REJECT > 0.3 > got[91]["score"]
    assert [e["toxic"] for i in (90, 91) for e in got[i]["evidence"]] == [1, 1, 1, 0, 0, 0] and not got[92]["evidence"]


@pytest.mark.parametrize("n", [400, 401, 4_000])
def test_rare_telling_words_at_any_number_of_examples(spark, n):
    """Thirty of a hundred examples are toxic, each by one of 21 words: all of the words are learnt, whatever the number."""
    rng = random.Random(3)
    vocabulary = [f"w{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijkl"]
    bad = [f"bad{c}" for c in "abcdefghijklmnopqrstu"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=12) + [bad[(i // 10 * 3 + i % 10) % 21]] * (i % 10 < 3))) for i in range(n)]
    probes = [(10_000 + k, " ".join([*rng.choices(vocabulary, k=12), w])) for k, w in enumerate(bad)]
    clean = [(20_000 + k, " ".join(rng.choices(vocabulary, k=12))) for k in range(300)]
    docs = spark.createDataFrame(rows + probes + clean, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 10 < 3)) for i in range(n)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert sum(got[i] >= queries.REJECT for i, _ in probes) >= 0.9 * len(probes)
    # A share of FALSE of the terms may tell by chance.
    assert sum(got[i] >= queries.REJECT for i, _ in clean) <= toxicity.FALSE * len(clean)


def test_pages_that_never_end():
    """A megabyte of markup without an end takes time in proportion; what is hidden is told as a plain pattern tells it."""
    import re
    import time

    for hard in ("<script>", "<!--", "<html ", "<", "<html lang", "</script ", "<style><script>"):
        page = hard * (1_000_000 // len(hard))
        began = time.perf_counter()
        language.visible(page), language.declared_language(page)
        assert time.perf_counter() - began < 2, hard
    hidden = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.IGNORECASE | re.DOTALL)
    stated = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.IGNORECASE)
    rng = random.Random(4)
    parts = ["<script", "</script >", "<STYLE>", "</style>", "<!--", "-->", "<html ", " lang = 'de'", "lang=fr", ">", "<", "a", " ", "-"]
    for _ in range(3_000):
        page = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert language.shown(page) == hidden.sub(" ", page)
        assert language.TAG.sub(" ", hidden.sub(" ", page)) == language.visible(page)
        found = stated.search(page)
        assert language.declared_language(page) == (found[1].lower() if found else "")


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    return {i: [word() for _ in range(n)] for i, n in enumerate([40, 25, 15, 60, 9, 3, 1, 30])}, word


@pytest.mark.parametrize("sent", [decontaminate.SENT, 0])
def test_planted_passages_are_found(spark, passages, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT", sent)  # 0: the seeds are joined by shuffle
    items, word = passages
    rng = random.Random(8)
    docs, want = [], set()
    for n in range(160):
        text = [word() for _ in range(rng.randrange(0, 120))]
        i = n % len(items)
        passage = list(items[i])
        if n % 4 == 1:  # a replaced word in each stretch of eight
            passage = [word() if k % 8 == 5 else w for k, w in enumerate(passage)]
        elif n % 4 == 2:
            passage = passage[:7]
        elif n % 4 == 3 and len(passage) >= 25:
            passage = passage[4:24]
        at = rng.randrange(len(text) + 1)
        docs.append((n, " ".join(text[:at]).title() + " -- " + ", ".join(passage) + "\n" + " ".join(text[at:])))
        if n % 4 == 0 or n % 4 == 1 and len(items[i]) >= 15 or n % 4 == 3:
            want.add((n, i))
    docs += [(500, None), (None, " ".join(items[0])), (501, ""), (502, "?!")]
    want.add((None, 0))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([*((i, " ".join(p)) for i, p in items.items()), (90, None), (91, ""), (0, " ".join(items[0]))], "item_id bigint, text string")
    # Passages of one or three words also occur by chance: those are told by brute force.
    plain = {n: decontaminated(t) for n, t in docs}
    for n, tokens in plain.items():
        for i in (5, 6):
            k = len(items[i])
            if any(tokens[a : a + k] == items[i] for a in range(len(tokens) - k + 1)):
                want.add((n, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(n, i) for n, i in want if n is None or n % 4 != 2 or i in (5, 6)}
    kept = {r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()}
    assert kept == {n for n, _ in docs} - {n for n, _ in got}
    assert decontaminate.leaks(empty(df), bench).count() == 0 and decontaminate.leaks(df, empty(bench)).count() == 0


def decontaminated(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def test_masks_hit_replaced_words():
    """However a fifth of a stretch's words are replaced, a seed stays whole."""
    from itertools import combinations

    for length in range(max(map(len, decontaminate.MASKS)), decontaminate.OVERLAP + 1):
        masks = [*decontaminate.MASKS, *[decontaminate.MASK_FOR_TEN] * (length == 10)]
        seeds = [frozenset(a + k for k, bit in enumerate(m) if bit == "1") for m in masks for a in range(length - len(m) + 1)]
        for gone in combinations(range(length), length // 5):
            assert any(not s & set(gone) for s in seeds), (length, gone)


@pytest.mark.parametrize("sent", [decontaminate.SENT, 0])
def test_every_offset_by_brute_force(spark, monkeypatch, sent):
    """Passages of 3 to 40 words with none to four words replaced: the rule tried at each offset of each text.

    Where a fifth of some 15 words at most is replaced all are found, as are unchanged shorter ones; nothing else ever is.
    """
    monkeypatch.setattr(decontaminate, "SENT", sent)
    draw, least, width = random.Random(5), max(map(len, decontaminate.MASKS)), decontaminate.OVERLAP
    passages = {i: [f"p{i}x{j}" for j in range(n)] for i, n in enumerate([3, 6, 7, 8, 9, 10, 12, 15, 20, 40])}
    docs = {}
    for i, words in passages.items():
        for changed in range(5):
            for _ in range(4):
                copy = list(words)
                for at in draw.sample(range(len(copy)), min(changed, len(copy))):
                    copy[at] = f"other{draw.random()}"[:12].replace(".", "")
                before = [f"f{draw.randint(0, 9)}" for _ in range(draw.randint(0, 6))]
                docs[len(docs)] = before + copy[: draw.choice([len(copy), max(1, len(copy) - 3)])] + ["end", "of", "it"]

    def rule(text, words):
        n = min(width, len(words))
        for begin in range(-len(words) + 1, len(text)):
            same = [text[begin + j] == w for j, w in enumerate(words) if 0 <= begin + j < len(text)]
            if len(words) < least:
                if len(same) == n and all(same):
                    return True
            elif len(same) >= n and (
                sum(same) >= 0.8 * len(same) or any(sum(same[k : k + n]) >= 0.8 * n for k in range(len(same) - n + 1))
            ):
                return True
        return False

    want = {(d, i) for d, text in docs.items() for i, words in passages.items() if rule(text, words)}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in passages.items()], "item_id int, text string")
    found = decontaminate.leaks(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    if sent:
        assert not [line for line in plan.splitlines() if "Aggregate [" in line and ("_words" in line or "_part" in line)]


def test_passages_of_ten_words(spark):
    words = [f"w{i}" for i in range(10)]
    docs = [(i, " ".join("x" if k in gone else w for k, w in enumerate(words))) for i, gone in enumerate([(1, 6), (4, 5), (4, 8), (0, 4, 8)])]
    bench = spark.createDataFrame([(None, " ".join(words))], "item_id bigint, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert {(r["doc_id"], r["n_equal"]) for r in got} == {(0, 8), (1, 8), (2, 8)}


@pytest.mark.parametrize("sent", [decontaminate.SENT, 0])
def test_passages_of_one_item_that_begin_alike(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT", sent)
    ways = [[*"abcdefg", *[f"w{n}x{k}" for k in range(20)]] for n in range(6)]
    items = [1, 1, 1, None, None, None]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in zip(items, ways, strict=True)], "item_id bigint, text string")
    docs = spark.createDataFrame([(n, "before " + " ".join(w) + " after") for n, w in enumerate(ways)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["n_equal"], r["n_compared"], r["start"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(n, i, 27, 27, 1) for n, i in enumerate(items)}
    assert decontaminate.keep_clean(docs, bench).count() == 0


@pytest.mark.parametrize("sent", [decontaminate.SENT, 0])
def test_a_long_text_with_a_passage_of_many_items(spark, monkeypatch, sent):
    """Each hit used to carry all words of its text: 60,000 words, 115 hits and 60 items of one passage are 10 GB of them."""
    monkeypatch.setattr(decontaminate, "SENT", sent)
    draw = random.Random(11)
    words = [f"w{draw.randrange(9**7)}" for _ in range(60_000)]
    passage = words[31_000:31_040]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:9_000]))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(passage)) for i in range(60)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["n_equal"], r["n_compared"], r["start"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, i, 40, 40, 31_000) for i in range(60)}
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()] == [2]


def test_pipeline_drops_a_long_leaked_text(spark, tmp_path):
    """The pipeline's stage held all hits of a text, each with all its words: 12 GB of them here."""
    draw = random.Random(13)
    words = [f"w{draw.randrange(9**7)}" for _ in range(60_000)]
    bench = [(i, " ".join(words[k : k + 30])) for i, k in enumerate([100, 20_000, 59_970] * 25)]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[200:9_000])), (3, None)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_leaked(spark, docs, str(tmp_path)).collect()} == {2, 3}


@pytest.mark.parametrize("places", [1, 3, 256])
def test_texts_cut_into_stretches_by_brute_force(spark, monkeypatch, places):
    """Texts and passages of few words, so that hits form runs and cross from stretch to stretch; the best of all places that share a seed."""
    monkeypatch.setattr(decontaminate, "PLACES", places)
    draw, masks, least, width = random.Random(12), decontaminate.MASKS, max(map(len, decontaminate.MASKS)), decontaminate.OVERLAP
    items = {i: draw.choices("aab", k=n) for i, n in enumerate([2, 5, 8, 9, 10, 14, 15, 22, 35])} | {20: ["a"] * 30, 21: [*"abcdefghijklmno"] * 2}
    docs = {}
    for d in range(40):
        words = draw.choices("aabc" if d % 2 else "abcdefgh", k=draw.randrange(0, 50))
        piece = list(items[draw.choice(list(items))])
        for at in draw.sample(range(len(piece)), draw.choice([0, 0, 1, 2])):
            piece[at] = "z"
        docs[d] = words + piece[draw.choice([0, 0, 3]) :] + draw.choices("abcdef", k=draw.randrange(9))

    def best(text, words):
        marked = masks + [decontaminate.MASK_FOR_TEN] + ["1" * len(words)] * (len(words) < least)
        found = []
        for begin in range(-len(words) + 1, len(text)):
            same = [text[begin + j] == w for j, w in enumerate(words) if 0 <= begin + j < len(text)]
            if not any(all(same[k + i] for i, bit in enumerate(m) if bit == "1") for m in marked for k in range(len(same) - len(m) + 1)):
                continue
            n = min(width, len(words))
            runs = [sum(same[k : k + n]) for k in range(len(same) - n + 1)]
            if runs and (sum(same) == n if n < least else sum(same) >= 0.8 * len(same) or max(runs) >= 0.8 * n):
                found.append((sum(same), -len(same), -max(begin, 0)))
        return max(found, default=None)

    want = {(d, i, m[0], -m[1], -m[2]) for d, text in docs.items() for i, words in items.items() if (m := best(text, words))}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    for sent in (decontaminate.SENT, 0):
        monkeypatch.setattr(decontaminate, "SENT", sent)
        found = decontaminate.leaks(df, bench)
        assert {tuple(r) for r in found.collect()} == want and len(want) > 60


def test_hits_of_a_text_are_not_held_at_once(spark):
    """The words of a text go no further than the join that finds hits, and generated code gets a text in stretches."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    found = decontaminate.leaks(docs, bench)
    assert found.count() == 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    joins = [line for line in plan if "BroadcastHashJoin" in line and "_number" in line]
    assert joins and not [line for line in joins if "_words" in line]
    stretches = [line for line in plan if "Generate explode(transform" in line and "_words" in line]
    assert stretches and "*(" not in stretches[0]


@needs_tables
def test_languages_of_held_out_texts(spark):
    docs = table(spark, SF_DIR, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.learn(docs.where(~held))
    rows = docs.where(held & (F.length("text") > 40)).select("text", "lang").collect()
    langs, words = model
    right = 0
    for r in rows:
        logs = language.likelihoods(r["text"], words, len(langs))
        right += langs[max(range(len(langs)), key=logs.__getitem__)] == r["lang"]
    assert right >= 0.95 * len(rows)
    pages = language.identify(table(spark, SF_DIR, "pages"), model).collect()
    assert len(pages) == table(spark, SF_DIR, "pages").count() and all(0.2 < p["score"] <= 1.0000001 for p in pages)
    stated = [p for p in pages if p["declared"] in langs]
    assert sum(p["lang"] == p["declared"] for p in stated) >= 0.9 * len(stated)


def test_evidence_is_fused_as_by_hand(spark):
    langs, words = ["de", "en"], {"the": [math.log(0.01), math.log(0.2)], "der": [math.log(0.2), math.log(0.01)]}
    rows = [
        (1, "http://a.x.de/1", "<html lang=de><p>der der</p>"), (2, "http://a.x.de/2", "<html lang='de'>der"), (3, "http://b.x.de/", ""),
        (4, "http://c.org/", "<html lang=en><script>der der</script>the the"), (5, None, None), (5, None, None), (6, "", "the"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("soft", F.lit(1))
    got = {r["page_id"]: r for r in language.identify(df, (langs, words)).collect()}
    soft = {k: language.softmax(language.likelihoods(language.visible(h or ""), words, 2)) for k, _, h in rows}
    # Page 3 has no text: its host has no other page, so the domain decides, drawn to all pages; its suffix adds to that.
    world = [sum(soft[k][i] for k, _, _ in rows) - soft[3][i] + 1 for i in (0, 1)]
    share = [w / sum(world) for w in world]
    others = [soft[1][i] + soft[2][i] for i in (0, 1)]
    domain = [(o + 20 * s) / (sum(others) + 20) for o, s in zip(others, share, strict=True)]
    odds = [d * (o + s) / (w + 1) for d, o, s, w in zip(domain, others, share, world, strict=True)]
    assert got[3]["lang"] == "de" and got[3]["score"] == pytest.approx(odds[0] / sum(odds))
    assert got[1]["lang"] == "de" and got[4]["lang"] == "en" and got[6]["lang"] == "en" and len(got) == 6
    assert language.identify(empty(df), (langs, words)).count() == 0
    assert language.identify(df, ([], {})).where("lang IS NULL").count() == 7


def test_stages_keep_columns_and_awkward_rows(spark, clashing):
    docs = clashing.withColumn("n_chars", F.length("text").cast("bigint"))
    bench = spark.createDataFrame([(1, "a plain text of two lines")], "item_id bigint, text string")
    for rows in (docs, empty(docs)):
        for kept in (lines.keep_first_lines(rows), simhash.keep_one(rows), decontaminate.keep_clean(rows, bench)):
            assert kept.columns == docs.columns and kept.count() <= rows.count()
        path, pattern = queries.tokenizer()
        assert bpe.encode(rows, path, pattern).count() == rows.count()
    left = {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()}
    assert left == {1, 2, 3, None, 4}
    assert lines.keep_first_lines(docs).count() == 7


@needs_tables
def test_pipeline_is_its_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    docs = table(spark, SF_DIR, "documents")
    rejected = {r["doc_id"] for r in queries.op3_toxicity(spark, SF_DIR).where("predicted = 1").collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF_DIR)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
    out = corpus_pipeline.run(spark, SF_DIR)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()
    assert out.where("octet_length(decoded) = 0 AND n_tokens > 0").count() == 0


def test_entry_points_have_every_operator():
    names = entry_points.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names


def test_entry_points_work_without_the_subpackage(tmp_path):
    """A copy of the repository without the subpackage, its tests and the pipeline still has its other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests")
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(x.startswith('op1_') for x in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[0]) > 100 and done.stdout.split()[1:] == ["False", "False"]
