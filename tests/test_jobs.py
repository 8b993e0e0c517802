import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tableprobe.operators import jobs
from tableprobe.operators.jobs import REPORT_SCHEMA, held, run_job, run_jobs, time_jobs
from tableprobe.operators.models import REASONS
from tableprobe.operators.scaling import TIMINGS_SCHEMA


def codes(report):
    return {r["job"]: r["reason_code"] for r in report.collect()}


def everything(spark, n=200):
    return spark.range(n).select(
        "id", (F.col("id") % 17 * 2.0).alias("v"), (F.col("id") % 2).cast("string").alias("kind"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("day"))


@pytest.mark.parametrize("hold, concurrent", [(False, False), (True, True)])
def test_all_jobs_run(spark, hold, concurrent):
    df = everything(spark)
    report = run_jobs(df, " CSV ", hold=hold, concurrent=concurrent)
    assert report.schema == REPORT_SCHEMA
    rows = report.collect()
    assert [(r["job_order"], r["job"], r["skipped"]) for r in rows] == [
        (1, "regression", False), (2, "classification", False), (3, "clustering", False), (4, "timeSeries", False)]
    assert {tuple(r["numeric_columns"]) for r in rows} == {("id", "v")}
    assert [r["method"] for r in rows] == [None, None, "kmeans", "daily"]
    assert rows[0]["label"] == "v" and rows[0]["features"] == ["id"] and set(rows[0]["metrics"]) == {"intercept", "rmse", "r2"}
    assert rows[1]["label"] == "kind" and rows[1]["metrics"]["num_classes"] == 2.0
    assert len(rows[2]["centers"]) == 3 and rows[2]["metrics"]["k"] == 3.0
    assert rows[3]["date_column"] == "day" and rows[3]["value_column"] == "id"
    assert [s["day"] for s in rows[3]["sample"]] == [dt.date(2024, 1, 1) + dt.timedelta(n) for n in range(10)]
    assert not df.is_cached and {r["file_type"] for r in rows} == {"csv"}


def test_text(spark):
    df = spark.createDataFrame([("a",), ("b",)], "value string")
    assert set(codes(run_jobs(df, "Text")).values()) == {"TEXT_INPUT"}
    assert time_jobs(df, "text").count() == 0
    assert codes(run_job("regression", df, "text")) == {"regression": "TEXT_INPUT"}


@pytest.mark.parametrize("schema, rows, expected", [
    ("s string", [("a",), ("b",)], ["FEW_NUMERIC", "NO_NUMERIC", "FEW_NUMERIC", "NO_DATE"]),
    ("v int, date string", [(1, "2024-01-01"), (1, "junk")], ["FEW_NUMERIC", None, "FEW_NUMERIC", None]),
    ("v int, day date", [(1, None), (2, None)], ["FEW_NUMERIC", "NO_FEATURES", "FEW_NUMERIC", "EMPTY_AFTER_PARSE"]),
    ("v int, w double", [(i, float(i)) for i in range(30)], [None, "NO_LABEL", None, "NO_DATE"]),
    ("v int, w double, k string", [(None, 1.0, "a"), (1, None, "b")],
     ["EMPTY_AFTER_CLEAN", "EMPTY_AFTER_CLEAN", "EMPTY_AFTER_CLEAN", "NO_DATE"]),
    ("a double, b double", [], ["EMPTY_AFTER_CLEAN", "NO_LABEL", "EMPTY_AFTER_CLEAN", "NO_DATE"]),
    ("day date", [(dt.date(2024, 1, 1),)], ["FEW_NUMERIC", "NO_NUMERIC", "FEW_NUMERIC", "NO_NUMERIC"]),
    ("when_time string, v int", [("junk", 1), ("", 2)], ["FEW_NUMERIC", None, "FEW_NUMERIC", "EMPTY_AFTER_PARSE"]),
])
def test_skip_codes(spark, schema, rows, expected):
    found = codes(run_jobs(spark.createDataFrame(rows, schema)))
    assert list(found) == list(jobs.JOBS)
    for job, want in zip(found, expected):
        if want is None:  # runs, or has too few rows to be split
            assert found[job] in (None, "EMPTY_SPLIT"), (job, found[job])
        else:
            assert found[job] == want, job


def test_empty_split(spark):
    # copies of a row stay together, so two distinct rows on one side leave the other empty
    df = spark.createDataFrame([(1, "a"), (1, "b")] * 10, "v int, k string")
    report = run_jobs(df, arguments={"classification": {"keys": ["v"]}})
    assert codes(report)["classification"] == "EMPTY_SPLIT"


def test_every_code_has_a_reason(spark):
    row = run_job("timeSeries", spark.range(3)).first()
    assert row["reason"] == REASONS["NO_DATE"]


def test_a_failure_is_captured_by_the_suite_only(spark):
    df = everything(spark, 20)
    wrong = {"date_col": "no such column"}
    report = run_jobs(df, arguments={"timeSeries": wrong}).collect()
    assert report[3]["reason_code"] == "ERROR" and report[3]["reason"]
    assert not report[0]["skipped"]
    with pytest.raises((PySparkException, KeyError)):
        run_job("timeSeries", df, **wrong)


def test_roles_can_be_given(spark):
    arguments = {"regression": {"label": "id", "features": ["v"]}, "clustering": {"k": 2},
                 "timeSeries": {"value_col": "v"}}
    rows = run_jobs(everything(spark), arguments=arguments).collect()
    assert rows[0]["label"] == "id" and len(rows[2]["centers"]) == 2 and rows[3]["value_column"] == "v"


def test_names_of_output_columns_may_exist(spark):
    df = everything(spark).select(
        F.col("id").alias("features"), F.col("v").alias("value"), F.col("kind").alias("label"), F.col("day").alias("ts.date"))
    assert set(codes(run_jobs(df)).values()) == {None}


def test_held_releases_on_failure(spark):
    df = spark.range(5)
    with pytest.raises(RuntimeError):
        with held(df) as kept:
            assert kept.is_cached
            raise RuntimeError
    assert not df.is_cached


def test_held_keeps_a_table_its_owner_caches(spark):
    df = spark.range(5).cache()
    with held(df) as kept:
        assert kept.is_cached
    assert df.is_cached
    df.unpersist()


def test_timings(spark):
    timings = time_jobs(everything(spark), workers=4)
    assert timings.schema == TIMINGS_SCHEMA
    rows = timings.collect()
    assert [r["job"] for r in rows] == list(jobs.JOBS)
    assert all(r["elapsed"] > 0 and r["workers"] == 4 and not r["skipped"] for r in rows)
