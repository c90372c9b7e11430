"""Languages of web pages by Bayes' rule over what the page says, what it declares and where it lies.

Four kinds of evidence are multiplied: the likelihood of the words under each language (from a sample of labelled texts), the
declared markup language, the address suffix, and a prior of the page's host. How a declaration or a suffix depends on the language, and how
languages are spread over hosts, is counted over all pages by grouped aggregation of the text evidence. The prior of a host is
drawn towards that of its domain, which is drawn towards that of all pages; the page's own count is left out of each.

Null and empty pages and addresses give no evidence of that kind and keep the rest. Repeated rows count as often as they come and
get equal results. Pages are read whole. Only the named columns are read; ties go to the first language by name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_rows, stored

#: Labelled texts of each language that are learnt from, words kept for each, words of a page after which more add no certainty.
SAMPLE, WORDS, CERTAIN = 1_000, 3_000, 40
#: Weight of the wider prior, in pages.
HOST_PRIOR, DOMAIN_PRIOR, SMOOTH = 4.0, 20.0, 1.0

WORD = re.compile(r"[^\W\d_]+")
ROOT = re.compile(r"<html\b", re.IGNORECASE)
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.IGNORECASE)
HIDES = re.compile(r"<(?:(script|style)\b|!--)", re.IGNORECASE)
SHOWS = {
    "script": re.compile(r"</script\s*>", re.IGNORECASE),
    "style": re.compile(r"</style\s*>", re.IGNORECASE),
    "": re.compile("-->"),
}
TAG = re.compile(r"<[^>]*>")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def declared_language(page: str) -> str:
    """The language that the page's root tag declares in lower case, empty without one; no part of a page is searched twice."""
    end = 0
    for m in ROOT.finditer(page):
        if m.start() < end:
            continue  # a tag within one that was searched
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        found = LANG.search(page, m.end(), end)
        if found:
            return found[1].lower()
    return ""


def shown(page: str) -> str:
    """A page without scripts, styles and comments; what never ends stays, and its end is looked for once."""
    parts, at, endless = [], 0, set()
    for m in HIDES.finditer(page):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in endless:
            continue
        end = SHOWS[kind].search(page, m.end())
        if end is None:
            endless.add(kind)
        else:
            parts += page[at : m.start()], " "
            at = end.end()
    return "".join([*parts, page[at:]])


def visible(page: str) -> str:
    """The text of a page, without scripts, styles, comments and tags, in time proportional to its length."""
    page = shown(page)
    closed = page.rfind(">") + 1  # up to here every tag ends
    return entities.unescape(TAG.sub(" ", page[:closed]) + page[closed:])


def place(url: str | None) -> tuple[str, str, str]:
    """Host, registered domain (its last two labels) and suffix of an address, empty where there is none."""
    m = HOST.match(url or "")
    host = m[1].lower().rstrip(".") if m else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], dict[str, list[float]]]:
    """The languages, and for each word its log-likelihood under each of them, from ``sample`` texts of each language."""
    labelled = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_text IS NOT NULL AND _lang IS NOT NULL")
    sizes = {r["_lang"]: r["n"] for r in labelled.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], {}
    # A share of each language that gives about as many texts, chosen by a hash of the text.
    share = F.create_map(*[F.lit(x) for n in langs for x in (n, min(1.0, sample / sizes[n]))])[F.col("_lang")]
    chosen = labelled.where(F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) < share * 1_000_000)

    def make():
        def step(batch: dict) -> dict:
            counts: Counter = Counter()
            for x, y in zip(batch["_text"], batch["_lang"], strict=True):
                counts.update((y, w) for w in WORD.findall(x.lower()))
            return {"lang": [y for y, _ in counts], "word": [w for _, w in counts], "n": list(counts.values())}

        return step

    counted = map_rows(chosen, make, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted)
    counts = {n: {} for n in langs}
    for n in langs:  # the most frequent words of each, WORDS at most
        for r in counted.where(F.col("lang") == n).orderBy(F.desc("n"), "word").limit(WORDS).collect():
            counts[n][r["word"]] = r["n"]
    words = sorted(set().union(*counts.values()))
    totals = {n: sum(c.values()) + 0.5 * len(words) for n, c in counts.items()}
    return langs, {w: [math.log((counts[n].get(w, 0) + 0.5) / totals[n]) for n in langs] for w in words}


def likelihoods(text: str, words: dict[str, list[float]], n: int) -> list[float]:
    """Log-likelihoods of the known words, as if there were ``CERTAIN`` of them at most; words of a text are not independent."""
    total, known = [0.0] * n, 0
    for w, k in Counter(WORD.findall(text.lower())).items():
        row = words.get(w)
        if row:
            known += k
            total = [t + k * v for t, v in zip(total, row, strict=True)]
    scale = min(1.0, CERTAIN / known) if known else 0.0
    return [t * scale for t in total]


def softmax(logs: list[float]) -> list[float]:
    top = max(logs)
    raw = [math.exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def _evidence(pages: DataFrame, key: str, url: str, page: str, langs: list[str], words: dict) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(words)
    kind = pages.schema[key].dataType.simpleString()

    def make():
        def of(address: str | None, source: str | None) -> tuple:
            text = likelihoods(visible(source or ""), shared.value, len(langs))
            return *place(address), declared_language(source or ""), text, softmax(text)

        def step(batch: dict) -> dict:
            rows = [of(u, p) for u, p in zip(batch[url], batch[page], strict=True)]
            names = ("host", "domain", "suffix", "declared", "text", "soft")
            return {key: batch[key]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return step

    out = f"`{key}` {kind}, host string, domain string, suffix string, declared string, text array<double>, soft array<double>"
    return map_rows(pages.select(key, url, page), make, out)


def _counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Pages of each language, by the text evidence, for each value of ``by``."""
    sums = F.array(*[F.sum(F.col("soft")[i]) for i in range(n)])
    return rows.groupBy(by).agg(sums.alias(f"by_{by}"))


def identify(
    pages: DataFrame, model: tuple[list[str], dict], key: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """``key``, ``lang``, its probability ``score``, and by each kind of evidence alone ``by_text``, ``declared``, ``by_host``."""
    langs, words = model
    n = len(langs)
    if not n:
        empty = F.lit(None)
        return pages.select(key, empty.cast("string").alias("lang"), empty.cast("double").alias("score"), empty.cast("string").alias("by_text"),
                            empty.cast("string").alias("declared"), empty.cast("string").alias("by_host"))
    rows = stored(_evidence(pages, key, url, page, langs, words))
    everything = rows.agg(*[F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(n)]).first()
    total = [float(everything[i] or 0.0) for i in range(n)]
    joined = rows
    for by in ("host", "domain", "declared", "suffix"):
        joined = joined.join(stored(_counts(rows, by, n)), by)

    def added(values: list[Column]) -> Column:
        out = values[0]
        for v in values[1:]:
            out = out + v
        return out

    soft = [F.col("soft")[i] for i in range(n)]
    others = {by: [F.greatest(F.col(f"by_{by}")[i] - soft[i], F.lit(0.0)) for i in range(n)] for by in ("host", "domain", "declared", "suffix")}
    world = [F.greatest(F.lit(total[i]) - soft[i], F.lit(0.0)) + SMOOTH for i in range(n)]
    share = [w / added(world) for w in world]
    domain = [(o + DOMAIN_PRIOR * s) / (added(others["domain"]) + DOMAIN_PRIOR) for o, s in zip(others["domain"], share, strict=True)]
    host = [(o + HOST_PRIOR * d) / (added(others["host"]) + HOST_PRIOR) for o, d in zip(others["host"], domain, strict=True)]

    def given(by: str, i: int) -> Column:
        """Log-likelihood of what the page shows in ``by`` if its language is ``i``; none if it shows nothing."""
        return F.when(F.col(by) == "", F.lit(0.0)).otherwise(F.log((others[by][i] + SMOOTH * share[i]) / (world[i] + SMOOTH)))

    fused = joined.select(
        key, "soft", "declared", F.array(*host).alias("prior"),
        F.array(*[F.col("text")[i] + given("declared", i) + given("suffix", i) + F.log(host[i]) for i in range(n)]).alias("logs"),
    )
    names = F.array(*[F.lit(x) for x in langs])

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logs")))
    return fused.select(
        key, best(F.col("logs")).alias("lang"), (F.lit(1.0) / mass).alias("score"), best(F.col("soft")).alias("by_text"),
        F.when(F.col("declared") != "", F.col("declared")).alias("declared"), best(F.col("prior")).alias("by_host"),
    )
