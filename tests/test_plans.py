"""The shared plans against brute force, on the paths meant for large tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import Profile
from plumbline.functions.rounding import rnd
from plumbline.functions.types import columns_of
from plumbline.operators import cardinality, duplicates, numeric, outliers, semantics
from plumbline.plans import coded, pairs, quantiles
from plumbline.plans.blocks import aggregate_arrays
from plumbline.plans.frequencies import distinct_stats, frequencies
from plumbline.plans.lookup import lookup
from plumbline.plans.pairs import WIDE, pearson
from plumbline.plans.quantiles import exact_quantiles
from plumbline.plans.running import previous_value, running_total
from tests.conftest import by_column


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_rounding_is_exact(spark):
    rng = random.Random(1)
    values = [k / 600 for k in range(0, 60000, 7)] + [k / 1000 for k in range(-3000, 3000)]
    values += [rng.gauss(0, 1) * 10 ** rng.randint(-6, 9) for _ in range(5000)] + [0.125, -0.125, 2.5, 1.005, 1.015]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 4):
        got = [r[0] for r in df.select(rnd("x", digits)).collect()]
        assert got == [round(v, digits) for v in values]


@pytest.mark.parametrize("gather", [10, 100, 100_000])
def test_quantiles_by_selection(spark, gather):
    rng = random.Random(gather)
    n = 4000
    rows = [
        (
            rng.expovariate(1.0) ** 3,
            float(rng.choice([1, 1, 1, 2, 7])),
            rng.choice([3, 4]) if i % 3 else None,
            math.inf if i % 50 == 0 else -math.inf if i % 70 == 0 else rng.gauss(0, 1),
            5,
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "skewed double, few double, edge int, wild double, same int").repartition(3)
    data = {c: np.array([r[i] for r in rows if r[i] is not None], float) for i, c in enumerate(df.columns)}
    wild = data["wild"]
    got = exact_quantiles(
        df,
        columns_of(df),
        (0.0, 0.1, 0.25, 0.5, 0.75, 1.0),
        counts={c: len(v) for c, v in data.items()},
        infinite={"wild": (int((wild == -math.inf).sum()), int((wild == math.inf).sum()))},
        gather_rows=gather,
        sketch_k=64,
        slack=0.02,
    )
    for c, v in data.items():
        ordered = np.sort(v)
        for p, q in zip((0.0, 0.1, 0.25, 0.5, 0.75, 1.0), got[c]):
            at = p * (len(ordered) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert q == pytest.approx(want, rel=1e-12), (c, p)


def test_quantiles_of_wide_tables_send_few_numbers(spark, monkeypatch):
    """Of 300 columns the driver gets the wanted values, not the columns."""
    rows = 400
    df = spark.range(rows).select(*[((F.col("id") * (2 * j + 1)) % (rows + j)).cast("double").alias(f"x{j}") for j in range(300)])
    sent = []

    def counted(*args):
        found = aggregate_arrays(*args)
        sent.append(sum(len(v) for v in found.values()))
        return found

    monkeypatch.setattr(quantiles, "aggregate_arrays", counted)
    got = exact_quantiles(df, columns_of(df), counts={f"x{j}": rows for j in range(300)})
    assert sum(sent) <= 6 * 300
    for j in range(0, 300, 37):
        want = np.quantile([(i * (2 * j + 1)) % (rows + j) for i in range(rows)], quantiles.QUARTILES)
        assert got[f"x{j}"] == pytest.approx(list(want))


def test_sketches_stay_within_their_error(spark):
    n = 50_000
    df = spark.range(n).selectExpr("double((id * 7919) % 50000) AS x", "id % 20011 AS few")
    p = Profile(df, exact=False)
    found = by_column(numeric.numeric_quantiles(p))["x"]
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(found[name] / n - share) <= 2e-4  # a rank within 1/10,000, and the place between two values
    distinct = by_column(cardinality.distinct_profile(p))
    assert distinct["x"]["unique_count"] == pytest.approx(n, rel=0.15)  # three times the standard error of 5 %
    assert distinct["few"]["unique_count"] == pytest.approx(20_011, rel=0.15)


def test_distinct_stats_mode_ties(spark):
    df = spark.createDataFrame([(9, "b"), (10, "a"), (9, "a"), (10, "b"), (3, None)], "n int, s string")
    found = {r["ordinal"]: r for r in distinct_stats(frequencies(df)).collect()}
    assert (found[0]["ndv"], found[0]["mode_l"], found[0]["mode_n"], found[0]["mode_ties"]) == (3, 9, 2, 2)
    assert (found[1]["ndv"], found[1]["mode_s"]) == (2, "a")


def test_zero_signs_and_nan(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (1.0,)], "x double")
    found = by_column(numeric.numeric_profile(df))["x"]
    assert (found["count"], found["unique_count"], found["zero_count"]) == (3, 2, 2)


def test_long_text_mode_is_shown_in_full(spark):
    common, other = "c" * 500, "b" * 500
    df = spark.createDataFrame([(common,)] * 3 + [(other,)] * 2 + [("short",), (None,)], "t string")
    assert by_column(cardinality.most_frequent(df))["t"]["most_frequent_value"] == common
    tied = spark.createDataFrame([(common,), (other,), ("d" * 500,)], "t string")
    assert by_column(cardinality.most_frequent(tied))["t"]["most_frequent_value"] == other
    assert cardinality.top_categories(df).orderBy("rank").first()["value"] == common


@pytest.mark.parametrize("window_rows", [0, 10_000])
def test_running_total_and_previous_value(spark, window_rows):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 9)) for i in range(500)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k int, v int").repartition(7)
    total = running_total(df, [F.asc("k")], "v", "total", window_rows)
    assert [r["total"] for r in total.orderBy("k").collect()] == list(np.cumsum([v for _, v in rows]))
    lagged = previous_value(df, [F.asc("k")], "v", "before", window_rows)
    assert [r["before"] for r in lagged.orderBy("k").collect()] == [None] + [v for _, v in rows[:-1]]


def test_range_partitions_of_long_texts(spark, monkeypatch):
    """Long texts with long beginnings in common are dealt by bins, none of which the driver gets whole, and add up in order."""
    rng = random.Random(6)
    texts = ["x" * 3_000 + "".join(rng.choices("abé\U0001f600", k=40)) * 50 for _ in range(200)] + [c * 4_000 for c in "acdy"]
    rows = [(t, rng.randint(1, 3)) for t in texts]
    df = spark.createDataFrame(rows, "`k.` string, v int").repartition(5)
    ranges, dealt = [], type(df).repartitionByRange

    def noted(self, *by):
        got = dealt(self, *by)
        ranges.append((self.agg(F.countDistinct("_bin")).first()[0] if "_bin" in self.columns else 0, [str(c) for c in by]))
        return got

    monkeypatch.setattr(type(df), "repartitionByRange", noted)
    total = running_total(df, [F.desc("v"), F.asc("`k.`")], "v", "total", 0, text="k.").collect()
    ordered = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    assert {(r["k."], r["total"]) for r in total} == {(k, int(t)) for (k, _), t in zip(ordered, np.cumsum([v for _, v in ordered]), strict=True)}
    lagged = previous_value(df, [F.asc("`k.`")], "v", "before", 0, text="k.").collect()
    by_text = sorted(rows, key=lambda r: r[0].encode())
    assert {(r["k."], r["before"]) for r in lagged} == {(k, b) for (k, _), b in zip(by_text, [None] + [v for _, v in by_text[:-1]], strict=True)}
    assert [n > 100 for n, _ in ranges] == [True, True] and not any("k." in c for _, by in ranges for c in by)


def test_lookup_with_hot_keys(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string")
    facts = df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("seen", F.col("n"))
    small = lookup(df, ["k"], facts)
    large = lookup(df, ["k"], facts, broadcast_values=3, hot_share=10)
    assert sorted(map(str, small.select("i", "k", "seen").collect())) == sorted(map(str, large.select("i", "k", "seen").collect()))
    assert large.count() == 600


def test_duplicate_rows_with_a_hot_group(spark):
    rows = [(i, "same" if i % 2 else f"v{i % 5}", None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a string, b double")
    seen, want = set(), set()
    for i, a, _ in rows:
        (want.add(i) if a in seen else seen.add(a))
    assert {r["id"] for r in duplicates.duplicate_rows(df, "id").collect()} == want
    plan = plan_of(duplicates.duplicate_rows(df, "id"))
    assert "Window" not in plan


def test_sequence_buckets(spark):
    rows = [(i, i + 10, i if i != 50 else 51, None if i % 2 else i // 2, i + 0.5, -i) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, up int, twice int, gaps int, half double, down int").repartition(5)
    p = Profile(df, order_by="k")
    assert semantics.sequential_columns(p, bucket=7) == ["k", "up", "gaps", "half"]
    swapped = df.withColumn("up", F.expr("CASE up WHEN 41 THEN 42 WHEN 42 THEN 41 ELSE up END"))
    assert "up" not in semantics.sequential_columns(Profile(swapped, order_by="k"), bucket=32)


def test_wide_correlation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n, c = 400, WIDE + 3
    x = rng.normal(1e6, 1.0, (n, c))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.1, n)
    x[:, 2] = 7.0
    holes = rng.random((n, c)) < 0.1
    rows = [tuple(None if holes[i, j] else float(x[i, j]) for j in range(c)) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"x{j} double" for j in range(c))).repartition(3)
    p = Profile(df)
    every = [(a, b) for i, a in enumerate(p.columns) for b in p.columns[i + 1 :]]
    wide = {(r["column_a"], r["column_b"]): r for r in pearson(p, every).collect()}
    narrow = {(r["column_a"], r["column_b"]): r for r in pearson(p, [q for q in every if q[1].ordinal < 4]).collect()}
    for (a, b), r in wide.items():
        i, j = int(a[1:]), int(b[1:])
        both = ~holes[:, i] & ~holes[:, j]
        assert r["n"] == both.sum()
        if 2 in (i, j):
            assert r["r"] is None and not r["varies"]
        else:
            assert r["r"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)
        if (a, b) in narrow:
            assert narrow[(a, b)]["r"] == (None if r["r"] is None else pytest.approx(r["r"], abs=1e-9))


def test_cramers_v_without_broadcast(spark, monkeypatch):
    rows = [("x" if i % 3 == 0 else f"a{i % 17}", f"b{(i * i) % 23}", None if i % 5 else "z") for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b string, c string").repartition(3)
    p = Profile(df)
    every = [(p.columns[0], p.columns[1]), (p.columns[0], p.columns[2]), (p.columns[1], p.columns[2])]
    monkeypatch.setattr(coded, "CODED", 0)
    monkeypatch.setattr(pairs, "BROADCAST_TOTALS", 0)
    monkeypatch.setattr(pairs, "lookup", lambda df, keys, facts: lookup(df, keys, facts, broadcast_values=1, hot_share=30))
    large = pairs.cramers_v(p, every).collect()
    monkeypatch.undo()
    assert len(large) == 3
    by_pair = {(r["column_a"], r["column_b"]): round(r["v"], 9) for r in pairs.cramers_v(p, every).collect()}
    assert by_pair == {(r["column_a"], r["column_b"]): round(r["v"], 9) for r in large}
    assert by_pair[("a", "c")] == 0.0


def test_results_do_not_depend_on_partitioning(spark, staff):
    def picture(df):
        p = Profile(df)
        frames = [numeric.numeric_profile(p), cardinality.top_categories(p), outliers.iqr_outliers(p), duplicates.duplicate_summary(p)]
        return [sorted(map(str, f.collect())) for f in frames]

    assert picture(staff) == picture(staff.orderBy(F.desc("Salary")).repartition(5)) == picture(staff.coalesce(1))


def test_plans_push_down_and_prune(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).selectExpr("id", "id % 10 AS a", "double(id * id) AS x", "string(id % 3) AS s").write.parquet(path)
    p = Profile(spark.read.parquet(path))
    plan = plan_of(outliers.outlier_rows(p, "x"))
    assert "PushedFilters: [Or(LessThan(x" in plan
    assert "PushedFilters: [Or(LessThan(id" in plan_of(outliers.outlier_rows(p, "id"))
    plan = plan_of(cardinality.class_distribution(p, "s"))
    assert "ReadSchema: struct<s:string>" in plan
    assert "WindowGroupLimit" in plan_of(cardinality.top_categories(p))
    assert "SinglePartition" not in plan_of(frequencies(p.df))


def test_pairs_of_coded_columns_take_one_scan(spark, tmp_path, monkeypatch):
    """Cells of 24 columns' 276 pairs come from one read of the table, and give what counting by value gives."""
    rng = random.Random(7)
    rows = [tuple(None if rng.random() < 0.1 else f"v{rng.randrange(2 + k)}" for k in range(24)) for _ in range(700)]
    spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(24))).write.parquet(f"{tmp_path}/t")
    p = Profile(spark.read.parquet(f"{tmp_path}/t"))
    every = [(a, b) for i, a in enumerate(p.columns) for b in p.columns[:i]]
    found = pairs.cramers_v(p, every)
    assert plan_of(found).count("Scan parquet") == plan_of(pairs.cramers_v(p, every[:1])).count("Scan parquet")
    want = {(r["column_a"], r["column_b"]): (r["n"], round(r["v"], 9)) for r in found.collect()}
    assert len(want) == 276
    for cells, task in ((0, 0), (100, 1_000)):  # pairs beyond a task's arrays
        monkeypatch.setattr(coded, "PAIR_CELLS", cells)
        monkeypatch.setattr(coded, "TASK_CELLS", task)
        got = pairs.cramers_v(p, every).collect()
        assert {(r["column_a"], r["column_b"]): (r["n"], round(r["v"], 9)) for r in got} == want
    for most in (0, 9):  # all or some columns without codes
        monkeypatch.setattr(coded, "CODED", most)
        some = every[::17]
        got = pairs.cramers_v(p, some).collect()
        assert {(r["column_a"], r["column_b"]): (r["n"], round(r["v"], 9)) for r in got} == {(a.name, b.name): want[a.name, b.name] for a, b in some}


def test_coded_cells_of_missing_and_odd_values(spark):
    rows = [(None, 1.0, True), ("", float("nan"), None), ("x", -0.0, False), ("", 0.0, True), (None, None, None), ("x", 1.0, False)]
    p = Profile(spark.createDataFrame(rows, "a string, b double, c boolean"))
    codes = coded.dictionaries(p.df, p.columns)
    assert codes == {0: ["", "x"], 1: [0.0, 1.0], 2: ["False", "True"]}
    a, b, c = p.columns
    cells = coded.count_cells(p.df, [(0, a, c), (1, a, b)], codes)
    assert sorted(tuple(r) for r in cells.where("pair = 0").collect()) == [(0, 1, 2, 1.0), (0, 2, 1, 2.0)]
    assert cells.where("pair = 1").agg({"cell": "sum"}).first()[0] == 3
    assert coded.dictionaries(p.df, p.columns, most=1) == {}
    empty = Profile(p.df.limit(0))
    assert [tuple(r) for r in pairs.cramers_v(empty, [(empty.columns[0], empty.columns[2])]).collect()] == [("a", "c", 0, 0.0, 0.0)]


def test_rules_count_only_what_they_turn_on(spark):
    """Types are those of exact counts, though columns far from every limit are not counted exactly."""
    n = 6_000
    df = spark.range(n).selectExpr(
        "id AS plain", "CAST(id AS string) AS label", "concat('t', CAST(id % 5900 AS string)) AS nearly", "id % 2 AS flag",
        "CAST(id % 2 AS double) AS half", "id % 5 AS grade", "id % 6 AS more", "IF(id % 2 = 0, 'true', 'false') AS answer",
        "IF(id % 2 = 0, 'up', 'down') AS way", "id % 900 AS middle", "CAST(id % 70 AS string) AS word",
        "CAST(NULL AS string) AS gone", "rand(3) AS real", "7 AS same", "IF(id = 17, NULL, id * 3) AS gap",
    )
    quick, exact = Profile(df, order_by="plain"), Profile(df, order_by="plain")
    _ = exact.distinct
    got, want = (sorted(tuple(r) for r in semantics.semantic_types(p).collect()) for p in (quick, exact))
    assert got == want
    assert "distinct" not in quick.__dict__
    counts = {r["column_name"]: r["ndv"] for r in quick.rule_counts.collect()}
    assert (counts["label"], counts["grade"], counts["gone"], counts["same"], counts["gap"]) == (n, 5, 0, 1, n - 1)
    assert (counts["nearly"], counts["middle"], counts["word"]) == (coded.CODED + 1, 900, 70)
    assert sorted(map(tuple, cardinality.constant_columns(df).collect())) == [("gone", 0), ("same", 1)]
    sketched = Profile(df, exact=False)
    types = {r["column_name"]: r["semantic_type"] for r in semantics.semantic_types(sketched).collect()}
    assert (types["flag"], types["half"], types["answer"], types["way"]) == ("Boolean", "Boolean", "Boolean", "Binary")
