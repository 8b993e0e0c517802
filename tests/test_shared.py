import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.operators import jobs, models, profile, shared
from tableprobe.operators.timeseries import daily_stats


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    rows = [(int(k), float(x), None if k % 13 == 0 else float(x * 3 - k / 50 + e), f"2024-01-{k % 9 + 1:02d}" if k % 7 else
             "junk" if k % 2 else None, float("nan") if k % 31 == 0 else float(k % 5), "ab"[k % 2])
            for k, x, e in zip(range(400), rng.normal(5, 2, 400), rng.normal(size=400))]
    path = str(tmp_path_factory.mktemp("t") / "t")
    spark.createDataFrame(rows, "id int, x double, y double, when_date string, z double, kind string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def scan(table):
    found = jobs.shared_scan(table, arguments={"regression": {"label": "y", "features": ["x", "id", "z"]},
                                               "timeSeries": {"value_col": "y"}})
    yield found
    found.close()


def test_days_and_ranges_are_those_of_their_own_scans(table, scan):
    own = daily_stats(table, "when_date", "y").orderBy("day").collect()
    for a, b in zip(scan.days().orderBy("day").collect(), own, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])
    fields = {r["column"]: r for r in profile.describe(table, stats=scan.stats()).collect()}
    for r in profile.describe(table).collect():
        got = fields[r["column"]]
        assert got[:-1] == pytest.approx(r[:-1], nan_ok=True) and got[-1] == pytest.approx(r[-1], abs=2e-6, nan_ok=True)


def test_one_scan_serves_all(table, scan, capsys):
    scan._grouped().explain("simple")
    assert capsys.readouterr().out.count("FileScan") == 1
    assert scan.by_day() is scan.by_day()
    report = jobs.run_jobs(table, shared=scan, arguments={"regression": {"label": "y", "features": ["x", "id", "z"]},
                                                          "timeSeries": {"value_col": "y"}}).collect()
    assert [r["skipped"] for r in report] == [False] * 4
    scan.days().explain("simple")
    assert "InMemoryTableScan" in capsys.readouterr().out


def test_least_squares(table, scan):
    rows = table.dropna(subset=["x", "id", "z", "y"]).collect()
    a = np.array([[r["x"], r["id"], r["z"], 1] for r in rows])
    y = np.array([r["y"] for r in rows])
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ beta
    for fit in (scan.regression(), shared.moments(table, ["x", "id", "z", "y"])):
        assert fit["coefficients"] == pytest.approx(beta[:3], rel=1e-9) and fit["intercept"] == pytest.approx(beta[3])
        assert fit["rmse"] == pytest.approx(np.sqrt((rest ** 2).mean()), rel=1e-9)
        assert fit["r2"] == pytest.approx(1 - (rest ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-9)


def test_offsets_constants_and_columns_that_repeat_others(spark):
    df = spark.range(100).select(
        (F.col("id") + 1.7e15).alias("late"), F.lit(3.0).alias("same"), ((F.col("id") * 7) % 11).cast("double").alias("w"),
        (2.0 * ((F.col("id") * 7) % 11)).alias("w2"), (F.col("id") * 0.5 + ((F.col("id") * 7) % 11) * 4 + 1e9).alias("y"))
    fit = shared.moments(df, ["late", "same", "w", "y"])
    assert fit["coefficients"] == pytest.approx([0.5, 0.0, 4.0]) and fit["r2"] == pytest.approx(1.0)
    fit = shared.moments(df, ["late", "w", "w2", "y"])
    assert fit["coefficients"][1] + 2 * fit["coefficients"][2] == pytest.approx(4.0) and fit["rmse"] < 1e-4
    flat = shared.moments(df, ["w", "same"])
    assert flat["coefficients"] == [0.0] and flat["intercept"] == 3.0 and flat["rmse"] == 0.0
    assert shared.moments(df.where("id < 0"), ["w", "y"]) is None
    assert np.isnan(shared.moments(df.select((F.col("w") / F.lit(0.0) if False else F.when(
        F.col("w") == 3, float("inf")).otherwise(F.col("w"))).alias("w"), "y"), ["w", "y"])["intercept"])


def test_many_features_go_to_mllib(spark):
    df = spark.range(80).select(*[((F.col("id") * (i + 2)) % (13 + i)).cast("double").alias(f"c{i}") for i in range(15)])
    assert jobs.shared_scan(df) is None
    fit = models.fit_regression(df)
    a = np.array(df.collect())
    beta, *_ = np.linalg.lstsq(np.column_stack([a[:, :-1], np.ones(80)]), a[:, -1], rcond=None)
    assert fit["coefficients"] == pytest.approx(beta[:-1], abs=1e-6)


def test_a_scan_that_fails_leaves_the_jobs_to_themselves(table, monkeypatch):
    monkeypatch.setattr(shared.SharedScan, "_grouped", lambda self: 1 / 0)
    assert [r["skipped"] for r in jobs.run_jobs(table).collect()] == [False] * 4
