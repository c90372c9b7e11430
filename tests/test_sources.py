import json

import pytest

from plumbline import Profile, assert_nonempty, full_profile, read_table, write_report
from plumbline.operators import numeric, prepare
from plumbline.sources import readers, sinks


def test_csv_tokens_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e,f\n1,1.5,True,x,,2020-01-15\nNA,nan,False,"y, z",,n/a\n3,-2e3,,NULL,,2020-02-01\n')
    df = read_table(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "x", None, "2020-01-15"),
        (None, None, False, "y, z", None, None),
        (3, -2000.0, None, None, None, "2020-02-01"),
    ]
    kinds = {r["column_name"]: r["kind"] for r in Profile(df).counts.collect()}
    assert kinds == {"a": "float", "b": "float", "c": "object", "d": "object", "e": "float", "f": "object"}


def test_corrupt_lines_are_counted(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\n3\n4,5,6\n")
    found = readers.corrupt_rows(readers.read_csv_text(spark, str(path)).cache()).first()
    assert (found["corrupt_rows"], found["n_rows"]) == (2, 3)


def test_csv_errors(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        return readers.read_csv(spark, str(path))

    with pytest.raises(readers.EmptyTableError):
        read("")
    for extra in ("a,b\n1,2\n3,4,\n", 'a,b\n1,"x,y"\n"3",4,""\n', "a,b\n1,2,3\n"):
        with pytest.raises(readers.MalformedTableError, match="1 lines"):
            read(extra)
    assert [tuple(r) for r in read('a,b\n1,\n3\n"4","x,y"\n5,"q""r"\n').collect()] == [(1, None), (3, None), (4, "x,y"), (5, 'q"r')]
    assert read("a,a,b,a\n1,2,3,4\n").columns == ["a", "a.1", "b", "a.2"]
    assert tuple(read("a,a,b\n1,x,3\n").first()) == (1, "x", 3)
    assert len(set(read("a,a,a.1\n1,2,3\n").columns)) == 3


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x bigint, s string")
    for name in ("parquet", "json", "orc"):
        path = str(tmp_path / f"t.{name}")
        df.write.format(name).save(path)
        assert [tuple(r) for r in read_table(spark, path).select("x", "s").collect()] == [(1, "a")]
    with pytest.raises(readers.UnsupportedFormatError):
        read_table(spark, "table.exe")


def test_empty_tables_are_refused(spark):
    with pytest.raises(readers.EmptyTableError):
        assert_nonempty(spark.createDataFrame([], "a int"))
    with pytest.raises(readers.EmptyTableError):
        assert_nonempty(spark.range(3).select())


def test_row_index(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(50).coalesce(1).write.parquet(path)
    rows = readers.with_row_index(spark, path).orderBy("row_idx").collect()
    assert [r["id"] for r in rows] == list(range(50))


def test_report_is_json_safe(spark, tmp_path, staff):
    df = spark.createDataFrame([(float("inf"), float("nan"), 1.5)], "a double, b double, c double")
    assert tuple(sinks.json_safe(df).first()) == (None, None, 1.5)
    paths = write_report(full_profile(staff, ["numeric", "quality_score"]), str(tmp_path / "report"))
    rows = [json.loads(r["value"]) for r in spark.read.text(paths[1]).collect()]
    assert rows == [{"quality_score": 85.0}]


def test_full_profile_sections(staff):
    sections = full_profile(Profile(staff, order_by="Salary"))
    assert {"head", "numeric", "relationships", "findings"} <= set(sections)
    assert all(df.columns for df in sections.values())


def test_prepare(spark, staff):
    ages = [r["Age"] for r in prepare.impute_median(staff).collect()]
    assert ages == [25.0, 30.0, 45.0, 25.0, 50.0, 60.0, 37.5]
    capped = spark.createDataFrame([(float(i),) for i in range(10)] + [(100.0,), (None,)], "x double")
    from plumbline.operators.outliers import cap_outliers

    values = [r["x"] for r in cap_outliers(capped).collect()]
    assert values[-1] is None and values[-2] == 15.0 and values[0] == 0.0
    with pytest.raises(ValueError):
        prepare.one_hot(staff, "HireDate", limit=3)
    scaled = numeric.numeric_describe(prepare.standard_scale(staff, ["Salary"])).where("column_name = 'Salary'").first()
    assert (scaled["mean"], round(scaled["std"] ** 2 * 6 / 7, 3)) == (0.0, 1.0)
