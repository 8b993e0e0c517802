from pyspark.sql import functions as F

from tableprobe.operators import scaling
from tableprobe.operators.scaling import TIMINGS_SCHEMA, scaling_report, scaling_skips


def report(spark, rows):
    found = scaling_report(spark.createDataFrame(rows, TIMINGS_SCHEMA))
    return {(r["job"], r["workers"], r["time"]): (r["speedup"], r["efficiency"]) for r in found.collect()}


def test_speedup_and_efficiency(spark):
    rows = [("a", 4, 3.0, False, ""), ("a", 1, 10.0, False, ""), ("a", 2, 6.0, False, ""),
            ("b", 2, 5.0, True, "x"), ("b", 4, 0.0, False, ""), (None, 1, 2.0, False, "")]
    assert report(spark, rows) == {
        ("a", 1, 10.0): (1.0, 100.0), ("a", 2, 6.0): (1.667, 83.33), ("a", 4, 3.0): (3.333, 83.33),
        ("b", 2, 5.0): (1.0, 50.0), ("b", 4, 0.0): (0.0, 0.0), (None, 1, 2.0): (1.0, 100.0)}


def test_of_several_first_runs_the_fastest_is_the_baseline(spark):
    rows = [("a", 1, 12.0, False, ""), ("a", 1, 10.0, False, ""), ("a", 2, 5.0, False, "")]
    assert report(spark, rows)[("a", 2, 5.0)] == (2.0, 100.0)


def test_no_workers(spark):
    assert report(spark, [("a", 0, 1.0, False, "")]) == {("a", 0, 1.0): (1.0, 0.0)}


def test_skips(spark):
    rows = [("a", 1, 1.0, False, ""), ("a", 2, 1.0, True, "x"), ("b", 1, 1.0, False, "")]
    found = scaling_skips(spark.createDataFrame(rows, TIMINGS_SCHEMA)).collect()
    assert {r["job"]: r["any_skipped"] for r in found} == {"a": True, "b": False}


def test_one_job_with_most_runs_is_not_gathered(spark):
    plan = scaling_report(spark.createDataFrame([("a", 1, 1.0, False, "")], TIMINGS_SCHEMA))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SortAggregate" not in text and "Cartesian" not in text


def test_many_jobs_are_dealt_by_salt(spark, monkeypatch):
    timings = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("j"), F.col("id") % 50)).alias("job"),
        (F.col("id") % 4 + 1).cast("int").alias("workers"), (F.col("id") % 7 + 1).cast("double").alias("elapsed"),
        F.lit(False).alias("skipped"), F.lit("").alias("reason"))
    expected = sorted(map(tuple, scaling_report(timings).collect()))
    monkeypatch.setattr(scaling, "BROADCAST_JOBS", 0)
    salted = scaling_report(timings)
    assert sorted(map(tuple, salted.collect())) == expected
    plan = salted._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("salt" in line for line in dealt)
