import pytest
from pyspark.sql import functions as F

from tableprobe.operators import roles


def candidates(df, **kwargs):
    return [(r["column"], r["distinct_count"]) for r in roles.label_candidates(df, **kwargs).collect()]


def test_bounds_and_tie_order(spark):
    df = spark.range(420).select(
        F.lit(1).alias("one"), (F.col("id") % 21).alias("twentyone"), (F.col("id") % 20).alias("twenty"),
        (F.col("id") % 5).cast("string").alias("tied_b"), (F.col("id") % 2).alias("two"),
        (F.col("id") % 5).alias("tied_a"), "id")
    assert candidates(df) == [("two", 2), ("tied_b", 5), ("tied_a", 5), ("twenty", 20)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 15, 18, 19, 20, 21, 22, 40, 66])
def test_screen_never_loses_a_candidate(spark, n):
    df = spark.range(n * 3).select(
        F.concat(F.lit(f"v{n}-"), F.col("id") % n).alias("s"), (F.col("id") % n / 7).alias("d"))
    expected = [("s", n), ("d", n)] if 2 <= n <= 20 else []
    assert candidates(df) == expected


def test_screen_covers_other_limits(spark):
    df = spark.range(600).select((F.col("id") % 60).alias("a"), (F.col("id") % 3).alias("b"))
    assert candidates(df, low=3, high=60) == [("b", 3), ("a", 60)]
    assert candidates(df, low=3, high=40) == [("b", 3)]


def test_missing_values_do_not_count(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, None), (1.0, "a"), (1.0, None), (None, "b")], "v double, s string")
    assert candidates(df) == [("s", 2)]


def test_both_zeros_are_one_value(spark):
    rows = [(float(i),) for i in range(20)] + [(-0.0,)]
    assert candidates(spark.createDataFrame(rows, "v double")) == [("v", 20)]


def test_maps_are_passed_over(spark):
    df = spark.sql("SELECT map(id, 1) AS m, array(id % 2) AS a, id % 2 AS k FROM range(4)")
    assert candidates(df) == [("a", 2), ("k", 2)]
    assert roles.choose_label(df, ["a", "k"]) == "k"


def test_no_candidates(spark):
    assert candidates(spark.range(100)) == []
    assert candidates(spark.sql("SELECT map(1, 2) AS m")) == []
    assert candidates(spark.createDataFrame([], "a string")) == []


def test_label_choice_prefers_what_is_not_numeric(spark):
    df = spark.createDataFrame([(1, "a", True)], "n int, s string, b boolean")
    assert roles.choose_label(df, ["n", "s"]) == "s"
    assert roles.choose_label(df, ["b", "s"]) == "b"
    assert roles.choose_label(df, ["n"]) == "n"
    assert roles.choose_label(df, []) is None


def test_classification_roles(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 1.5).alias("v"))
    assert roles.classification_roles(df) == (["id", "v"], "k")


def test_numeric_columns_include_decimals(spark):
    df = spark.sql("SELECT 1Y AS t, 1S AS s, 1 AS i, 1L AS l, 1.5 AS d, 1D AS dd, 1F AS f, 'a' AS x, true AS b")
    assert roles.numeric_columns(df) == ["t", "s", "i", "l", "d", "dd", "f"]
    assert roles.value_column(df) == "t" and roles.regression_label(df) == "f"


@pytest.mark.parametrize("schema, expected", [
    ("d date, updated_date string", "updated_date"),  # a name goes before a type
    ("updated_at_time int, d date", "d"),  # but not the name of a number
    ("x int, d date", "d"),
    ("x int, n timestamp_ntz", "n"),
    ("x int, UpTime string, t timestamp", "UpTime"),
    ("x int, y string", None),
])
def test_date_column(spark, schema, expected):
    assert roles.date_column(spark.createDataFrame([], schema)) == expected


def test_counts_of_bounded_state(spark):
    rows = [(k % 20, float("nan") if k % 3 else -0.0 * (k % 2), f"v{k % 21}", [None, k % 2] if k % 4 else [k % 2, None],
             None, {"m": k}) for k in range(2000)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d array<int>, e string, m map<string,int>").repartition(4)
    counts = {r["column"]: (r["pos"], r["distinct_count"]) for r in roles.bounded_counts(df, 20).collect()}
    assert counts == {"a": (0, 20), "b": (1, 1), "c": (2, 21), "d": (3, 3), "e": (4, 0)}
    for high in (1, 2, 15, 16, 20, 31, 32, 1000):
        for n in (high - 1, high, high + 1, 3 * high + 5):
            found = roles.bounded_counts(spark.range(4 * n, numPartitions=5).selectExpr(f"id % {n or 1} AS v"), high)
            count = found.first()["distinct_count"]
            assert count == n if n <= high else count > high
    assert [r["column"] for r in roles.label_candidates(df).collect()] == ["d", "a"]
    assert roles.bounded_counts(df.limit(0), 20).where("distinct_count <> 0").isEmpty()
    assert roles.bounded_counts(df.select("m"), 20).isEmpty()
    with pytest.raises(ValueError):
        roles.bounded_counts(df, 2 ** 27)


def test_candidates_take_one_scan(spark, tmp_path, capsys):
    spark.range(50).selectExpr("id % 3 AS a", "string(id) AS b", "id % 7 AS c").write.parquet(str(tmp_path / "t"))
    roles.label_candidates(spark.read.parquet(str(tmp_path / "t"))).explain("simple")
    assert capsys.readouterr().out.count("FileScan") == 1
