"""Results that must not depend on how large, long or odd the data are."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cardinality, charts, duplicates, prepare, semantics, temporal
from plumbline.plans.lookup import lookup
from plumbline.plans.pairs import pearson
from plumbline.profile import Profile
from plumbline.sources import readers

FIRST = 1 << 60


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_integers_of_nineteen_digits_stay_apart(spark):
    df = readers.infer_types(spark.createDataFrame([(str(FIRST + i),) for i in range(60)], "k string"))
    assert df.dtypes == [("k", "bigint")]
    assert rows_of(cardinality.distinct_profile(df)) == [("k", 60, 1.0, True)]
    beyond = readers.infer_types(spark.createDataFrame([("9" * 25,), ("1",)], "k string"))
    assert beyond.dtypes == [("k", "string")]


def test_steps_of_one_beyond_doubles(spark):
    df = spark.createDataFrame([(i, (1 << 53) + i, (1 << 53) + 2 * i) for i in range(20)], "n int, k bigint, even bigint")
    assert semantics.sequential_columns(Profile(df, order_by="n")) == ["n", "k"]


def test_long_texts_are_ranked_by_text(spark):
    texts = [c * 100 for c in "fbdace"]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "t string")
    assert [r["value"][0] for r in cardinality.top_categories(df).orderBy("rank").collect()] == list("fabcde")
    got = cardinality.pareto(df, "t").orderBy("cumulative_percentage").collect()
    assert [r["value"] for r in got] == [c * 100 for c in "fabcde"]


def test_pearson_is_one_result_for_narrow_and_wide_tables(spark):
    rows = [(float(i), float(i * i % 7), *[float((i * k) % 11) for k in range(16)]) for i in range(30)]
    rows += [(float("inf"), None, *[None] * 16)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(18)))
    wide, narrow = Profile(df), Profile(df.select("c0", "c1"))
    a = pearson(wide, [(wide.columns[i], wide.columns[j]) for i in range(18) for j in range(i)])
    b = pearson(narrow, [(narrow.columns[1], narrow.columns[0])])
    r = a.where("column_a = 'c1' AND column_b = 'c0'").first()
    assert r["n"] == 30 and r["r"] == pytest.approx(b.first()["r"])
    spoilt = spark.createDataFrame([*rows, (float("inf"), 1.0, *[1.0] * 16)], df.schema)
    p = Profile(spoilt)
    assert pearson(p, [(p.columns[i], p.columns[j]) for i in range(18) for j in range(i)]).where("column_b = 'c0'").where("r IS NOT NULL").count() == 0


def test_an_infinity_leaves_the_histogram_of_the_others(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(math.inf,)], "v double")
    bins = charts.histogram_bins(df).collect()
    assert sum(r["count"] for r in bins) == 20 and min(r["bin_start"] for r in bins) == 0.0


@pytest.mark.parametrize("columns", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_scatter_cells_hold_every_complete_case(spark, columns):
    """Counts add up; only cells at the last level hold more than the limit; each holds the points within its bounds."""
    inf = float("inf")
    points = [((i * 37 % 101) / 7.0, (i % 10) ** 3 * 1.0, 5.0) for i in range(900)] + [(0.5, 0.5, 5.0)] * 300
    odd = [(inf, 1.0, 5.0), (1.0, -inf, 5.0), (None, 1.0, 5.0), (1.0, None, 5.0)]
    df = spark.createDataFrame(points + odd, "x double, y double, z double")
    found = charts.cells(df, columns, most=40, halvings=6).collect()
    complete = [p for p in points + odd if None not in p[: len(columns)]]
    assert sum(r["count"] for r in found) == len(complete)
    apart = [r["count"] for r in found if r["level"] is None]
    finite = [p for p in complete if all(abs(v) < inf for v in p[: len(columns)])]
    assert sum(apart) == len(complete) - len(finite)
    placed = [r for r in found if r["level"] is not None]
    assert all(r["count"] <= 40 or r["level"] == 6 for r in placed) and len({r["level"] for r in placed}) > 1
    tops = [max(r[f"high_{i}"] for r in placed) for i in range(len(columns))]
    for r in placed:
        if any(abs(r[f"{end}_{i}"] - p[i]) < 1e-3 for end in ("low", "high") for i in range(len(columns)) for p in finite):
            continue  # bounds are rounded, so points on them may be on either side
        inside = [
            p for p in finite
            if all(r[f"low_{i}"] <= p[i] and (p[i] < r[f"high_{i}"] or r[f"high_{i}"] == tops[i]) for i in range(len(columns)))
        ]
        assert len(inside) == r["count"]


def test_scatter_cells_without_rows_and_of_one_value(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert charts.cells(empty, ["x", "y"]).count() == 0 and charts.scatter_cells(empty).count() == 0
    same = spark.createDataFrame([(3.0, 4.0)] * 500, "x double, y double")
    assert [(r["level"], r["count"]) for r in charts.cells(same, ["x", "y"], most=10).collect()] == [(8, 500)]


@pytest.mark.parametrize("window_rows", [200_000, 5])
def test_sparse_one_hot_of_any_number_of_values(spark, monkeypatch, window_rows):
    """More values than the dense form takes, a name that needs quotes, and the plan for many values."""
    from plumbline.plans import running

    monkeypatch.setattr(running.running_total, "__defaults__", (window_rows,))
    rows = [(i, None if i % 50 == 0 else f"v{i * 7 % 600:03d}") for i in range(1_500)]
    df = spark.createDataFrame(rows, "id long, `a.b` string").repartition(4)
    values = sorted({v for _, v in rows if v is not None})
    got = {r["id"]: r["a.b_one_hot"] for r in prepare.one_hot_sparse(df, "a.b").collect()}
    assert len(got) == len(rows) and len(values) > prepare.ONE_HOT_LIMIT
    for i, v in rows:
        assert got[i]["size"] == len(values)
        assert (got[i]["indices"], got[i]["values"]) == (([], []) if v is None else ([values.index(v)], [1.0]))
    assert prepare.one_hot_sparse(df, "a.b").columns == ["id", "a.b_one_hot"]
    assert prepare.one_hot_sparse(df.where("false"), "a.b").count() == 0


def test_scatter_points_are_all_points(spark):
    df = spark.range(6_000).select("id", (F.col("id") * 2).alias("twice"), (F.col("id") % 7).alias("z"))
    assert charts.scatter3d_sample(Profile(df, order_by="id")).count() == 6_000
    assert charts.scatter3d_sample(Profile(df, order_by="id"), 10).count() == 10


def test_one_of_each_row_as_the_summary_counts(spark):
    df = spark.createDataFrame([(1, math.nan), (1, None), (2, 0.5)], "k int, v double")
    assert duplicates.duplicate_summary(df).first()["duplicate_rows"] == 1 and duplicates.dedupe_rows(df).count() == 2
    maps = spark.createDataFrame([({"a": 1},), ({"a": 1},)], "m map<string,int>")
    assert duplicates.dedupe_rows(maps).count() == 1 and duplicates.dedupe_rows(maps).columns == ["m"]


def test_modes_without_exact_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert prepare.impute_mode(Profile(df, exact=False)).where("c IS NULL").count() == 0


def test_modes_keep_microseconds(spark):
    at = dt.datetime(2020, 1, 1, 0, 0, 0, 123456)
    df = spark.createDataFrame([(at,), (at,), (dt.datetime(2021, 1, 1),)], "t timestamp")
    assert cardinality.most_frequent(df).first()["most_frequent_value"] == "2020-01-01 00:00:00.123456"


@pytest.mark.parametrize("values", [0, 100])
def test_lookup_keeps_rows_without_a_key(spark, values):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "k string, n_row int")
    facts = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25)], "k string, n bigint, f double")
    got = sorted(rows_of(lookup(df, ["k"], facts, broadcast_values=values)), key=lambda r: r[1])
    assert got == [("a", 1, 0.5), ("b", 2, 0.25), (None, 3, None), (None, 4, None)]


FORMATS = [
    ("%Y-%m-%dT%H:%M:%SZ", "2020-03-15 10:20:30"), ("%Y-%m-%dT%H:%M:%S+02:00", "2020-03-15 08:20:30"), ("%d.%m.%Y", "2020-03-15 00:00:00"),
    ("%B %d, %Y", "2020-03-15 00:00:00"), ("%Y-%m-%d %I:%M %p", "2020-03-15 10:20:00"), ("%d-%b-%Y", "2020-03-15 00:00:00"),
    ("%m/%d/%y", "2020-03-15 00:00:00"), ("%Y-%m", "2020-03-01 00:00:00"), ("%d %B %Y", "2020-03-15 00:00:00"),
    ("%Y-%m-%d %H:%M:%S.%f+0000", "2020-03-15 10:20:30"), ("%a, %d %b %Y", "2020-03-15 00:00:00"),
    ("%A, %B %d, %Y", "2020-03-15 00:00:00"), ("%Y%m%dT%H%M%S", "2020-03-15 10:20:30"),
]


@pytest.mark.parametrize("shape, first", FORMATS)
def test_text_dates_are_found(spark, shape, first):
    days = [dt.datetime(2020, 3, 15, 10, 20, 30) + dt.timedelta(days=31 * i) for i in range(20)]
    df = spark.createDataFrame([(d.strftime(shape),) for d in days], "t string")
    p = Profile(df)
    assert temporal.detect_datetime(p).first()["parse_success"] == 100.0
    column = temporal._detected(p)[0][0]
    assert df.select(F.date_format(F.min(column.parsed), "yyyy-MM-dd HH:mm:ss")).first()[0] == first


@pytest.mark.parametrize("written", ["15-jan-2020", "JAN 15, 2020", "wednesday, january 15, 2020 10:00 AM", "15 Jan 2020T10:00:00Z"])
def test_text_dates_in_any_case(spark, written):
    df = spark.createDataFrame([(written,)] * 3, "t string")
    p = Profile(df)
    assert temporal.detect_datetime(p).first()["parse_success"] == 100.0
    assert str(df.select(F.to_date(temporal._detected(p)[0][0].parsed)).first()[0]) == "2020-01-15"


def test_other_words_before_a_date_are_no_weekday(spark):
    df = spark.createDataFrame([("Due, 15 Jan 2020",)] * 3, "t string")
    assert not temporal.detect_datetime(Profile(df)).first()["detected"]


def test_csv_as_it_is_written(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('a,b\n1,"two\nlines"\n2,"say ""x"""\n3\n')
    assert sorted(rows_of(readers.read_csv(spark, str(good)))) == [(1, "two\nlines"), (2, 'say "x"'), (3, None)]
    extra = tmp_path / "extra.csv"
    extra.write_text("a,b\n1,2\n3,4,5\n6,7,8\n")
    with pytest.raises(readers.MalformedTableError, match="2 lines"):
        readers.read_csv(spark, str(extra))
    broken = tmp_path / "broken.csv"
    broken.write_bytes(b"a,b\n1,\xff\xfe\n2,x\n")
    with pytest.raises(readers.MalformedTableError, match="1 lines"):
        readers.read_csv(spark, str(broken))


def test_csv_has_a_row_order(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("k,v\n" + "".join(f"{i + 100},{(i * 7) % 5}\n" for i in range(30)))
    df = readers.with_row_index(spark, str(path))
    p = Profile(df, order_by="row_idx")
    assert [r["k"] for r in df.orderBy("row_idx").limit(3).collect()] == [100, 101, 102]
    assert "k" in semantics.sequential_columns(p)


def test_density_beside_an_infinity(spark):
    """The curve of the finite values is that of a table without the infinite ones."""
    from plumbline.operators import charts

    values = [(float(i * i % 97),) for i in range(200)]
    plain = charts.density_curve(spark.createDataFrame(values, "x double"))
    spoilt = charts.density_curve(spark.createDataFrame([*values, (float("inf"),), (float("-inf"),)], "x double"))

    def area(df):
        rows = sorted((r["x"], r["density"]) for r in df.collect())
        assert rows and all(math.isfinite(d) for _, d in rows)
        return sum(d for _, d in rows) * (rows[-1][0] - rows[0][0]) / (len(rows) - 1)

    assert area(spoilt) == pytest.approx(area(plain), rel=0.02) and 0.8 < area(plain) < 1.05
