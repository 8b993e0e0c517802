import datetime as dt

import pytest
from pyspark.sql import functions as F

from tableprobe.operators.timeseries import daily_stats, first_days


def test_mixed_formats(spark):
    rows = [("2024-01-02", 1.0), ("2024-01-02 03:04:05", 2.0), ("2024/01/02", 3.0), ("02/01/2024", 4.0),
            ("junk", 5.0), ("a/b-c", 6.0), (None, 7.0), ("2024-01-03T10:00:00", None), ("2024-01-04", float("nan"))]
    days = daily_stats(spark.createDataFrame(rows, "s string, v double"), "s", "v").collect()
    assert [tuple(r) for r in days] == [(dt.date(2024, 1, 2), 4, 2.5, 1.0, 4.0, 10.0)]


def test_separator_guard_keeps_every_parse(spark):
    """The guarded chain gives what the plain chain of parsers gives."""
    texts = ["2024-01-02", "2024/01/02", "02/01/2024", "31/12/1999", "1/2/2024", "2024/1/2", "2024-1-2", "20240102",
             "2024", "12:00", "2024-13-01", "32/01/2024", "", " 2024-01-02 ", "2024-01-02/03"]
    df = spark.createDataFrame([(t, 1) for t in texts], "s string, v int")
    plain = F.coalesce(F.try_to_timestamp("s"), *[
        F.try_to_timestamp("s", F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy")])
    expected = df.select(F.to_date(plain).alias("day")).dropna().groupBy("day").count()
    got = daily_stats(df, "s", "v").select("day", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "string"])
def test_every_date_type(spark, kind):
    df = spark.sql(f"SELECT cast(timestamp_ntz'2024-05-06 00:30:00' AS {kind}) AS seen_date, 3 AS v")
    assert daily_stats(df).select("day", "sum_value").first() == (dt.date(2024, 5, 6), 3.0)


def test_columns_are_guessed_and_names_do_not_clash(spark):
    df = spark.createDataFrame([(7, "2024-01-01", 1, 2)], "value int, `the.date` string, day int, ts int")
    assert daily_stats(df).first()["sum_value"] == 7.0


def test_sum_of_large_integers_does_not_overflow(spark):
    df = spark.createDataFrame([("2024-01-01", 9223372036854775807), ("2024-01-01", 1)], "d string, v bigint")
    assert daily_stats(df, "d", "v").first()["sum_value"] == float(2 ** 63)
    assert daily_stats(df, "d", "v", exact_scale=0).first()["sum_value"] == float(2 ** 63)


def test_decimals(spark):
    df = spark.sql("SELECT date'2024-01-01' AS d, cast(1.25 AS decimal(10, 2)) AS v")
    assert daily_stats(df, exact_scale=2).first()["mean_value"] == 1.25


def test_numbers_hold_no_dates(spark):
    with pytest.raises(TypeError):
        daily_stats(spark.range(3).withColumn("v", F.lit(1)), "id", "v")
    with pytest.raises(ValueError):
        daily_stats(spark.range(3))


def test_first_days(spark):
    df = spark.range(400).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int") % 40).alias("d"), "id")
    days = [r["day"] for r in first_days(daily_stats(df, "d", "id")).collect()]
    assert days == [dt.date(2024, 1, 1) + dt.timedelta(n) for n in range(10)]


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_exact_sums_do_not_depend_on_partitioning(spark, partitions):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "2024-01-01").otherwise("2024/01/02").alias("d"),
        (F.col("id") * 7919 % 1000003 / 100).alias("v"))
    expected = sorted(daily_stats(df.coalesce(1), "d", "v", 2).collect())
    assert sorted(daily_stats(df.repartition(partitions), "d", "v", 2).collect()) == expected
    assert expected[0]["sum_value"] == df.where(F.col("d") == "2024-01-01").select(
        F.sum(F.col("v").cast("decimal(18,2)")).cast("double")).first()[0]


def test_scan_sees_the_null_tests_and_two_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' AS ts, 1D AS v, 'x' AS other FROM range(5)").write.parquet(path)
    plan = daily_stats(spark.read.parquet(path), "ts", "v")._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(ts), IsNotNull(v)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,v:double>" in plan
