import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.operators import features as fx
from tableprobe.operators import models
from tableprobe.operators.models import SkipJob


@pytest.fixture(scope="module")
def line(spark):
    """y = 3a - 2b + 5 with a little deterministic noise."""
    return spark.range(400).select(
        (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).alias("b.c"),
        (3 * (F.col("id") % 20) - 2 * (F.col("id") % 7) + 5 + (F.col("id") % 3 - 1) / 10).alias("label"))


@pytest.fixture(scope="module")
def groups(spark):
    """Two classes a line tells apart, in a column called features."""
    side = F.when(F.col("id") % 2 == 0, "left").otherwise("right")
    return spark.range(1000).select(
        (F.col("id") % 10 + F.when(F.col("id") % 2 == 0, 0).otherwise(100)).alias("x"),
        (F.col("id") % 13).cast("decimal(10,2)").alias("z"), side.alias("features"))


def test_regression_equals_least_squares(line):
    row = models.regression_report(line).first()
    rows = np.array(line.collect(), dtype=float)
    design = np.column_stack([rows[:, :2], np.ones(len(rows))])
    solution = np.linalg.lstsq(design, rows[:, 2], rcond=None)[0]
    residual = rows[:, 2] - design @ solution
    assert row["label"] == "label" and row["features"] == ["a", "b.c"]
    assert np.allclose(row["coefficients"] + [row["intercept"]], solution, atol=1e-8)
    assert math.isclose(row["rmse"], np.sqrt(np.mean(residual ** 2)), rel_tol=1e-8)
    assert math.isclose(row["r2"], 1 - np.sum(residual ** 2) / np.sum((rows[:, 2] - rows[:, 2].mean()) ** 2), rel_tol=1e-8)
    assert abs(residual.sum()) < 1e-6


def test_regression_roles_can_be_given(line):
    row = models.regression_report(line, label="a", features=["label"]).first()
    assert row["label"] == "a" and row["features"] == ["label"]
    assert models.regression_report(line, label="a").first()["features"] == ["b.c", "label"]


def test_r2_of_one_row_is_null(spark):
    row = models.regression_report(spark.createDataFrame([(1.0, 2.0)], "a double, b double")).first()
    assert row["r2"] is None


@pytest.mark.parametrize("rows, code", [([], "EMPTY_AFTER_CLEAN"), ([(1.0, None), (None, 1.0)], "EMPTY_AFTER_CLEAN")])
def test_regression_skips(spark, rows, code):
    with pytest.raises(SkipJob) as skip:
        models.fit_regression(spark.createDataFrame(rows, "a double, b double"))
    assert skip.value.code == code


def test_classification_separates(groups):
    row = models.classification_report(groups).first()
    assert row["label"] == "features" and row["features"] == ["x", "z"]
    assert row["accuracy"] == 1.0 and row["num_classes"] == 2
    assert models.classification_report(groups, method="random").first()["accuracy"] == 1.0
    keyed = models.classification_report(groups, keys=["x", "z"], method="md5").first()
    assert keyed["accuracy"] == 1.0


def test_boolean_and_numeric_labels(spark):
    df = spark.range(300).select((F.col("id") % 2 == 0).alias("flag"), (F.col("id") % 2 * 50 + F.col("id") % 5).alias("x"))
    assert models.classification_report(df.withColumn("y", F.rand(1))).first()["label"] == "flag"
    numeric = df.select(F.col("flag").cast("int").alias("flag"), (F.col("x") + F.rand(2)).alias("x"))
    row = models.classification_report(numeric).first()
    assert row["label"] == "flag" and row["features"] == ["x"] and row["accuracy"] == 1.0


def test_a_named_label_may_have_many_values(spark):
    df = spark.range(2000).select((F.col("id") % 25 * 10 + F.col("id") % 3).alias("x"),
                                  F.concat(F.lit("k"), F.col("id") % 25).alias("k"))
    row = models.classification_report(df, label="k").first()
    assert row["num_classes"] == 25 and row["features"] == ["x"]
    assert models.calibration(models.train_classifier(df, "k")).count() == 25
    wide = spark.range(5000).select((F.col("id") % 1500).alias("v"))
    found = fx.label_index(wide, "v").collect()
    expected = sorted(found, key=lambda r: (-r["rows"], r["label"]))
    assert [r["label_index"] for r in expected] == list(range(1500))
    assert fx.label_index(wide.where("v < 0"), "v").count() == 0


def test_label_index_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "s string")
    assert sorted(map(tuple, fx.label_index(df, "s").collect())) == [("a", 1.0, 1), ("b", 2.0, 1), ("c", 0.0, 2)]


def test_features_drop_missing_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2), (nan, 2), (1.0, None)], "a double, features int")
    vectors = fx.prepare_features(df, ["a", "features"]).collect()
    assert [list(v["features"]) for v in vectors] == [[1.0, 2.0]]


@pytest.mark.parametrize("method", ["hash", "md5"])
def test_split_ignores_partitioning_and_loses_nothing(spark, method):
    df = spark.range(5000).select("id", (F.col("id") % 11).alias("k"))
    train, test = fx.split(df, method=method)
    again = fx.split(df.repartition(7), method=method)[1]
    assert train.count() + test.count() == 5000
    assert 850 < test.count() < 1150
    assert sorted(r["id"] for r in test.collect()) == sorted(r["id"] for r in again.collect())
    assert train.join(test, "id").count() == 0


def test_split_method_is_checked(spark):
    with pytest.raises(ValueError):
        fx.split(spark.range(2), method="other")
    train, test = fx.split(spark.range(1000), method="random")
    assert train.count() + test.count() == 1000


def test_kmeans_centers_are_the_means_of_their_rows(spark):
    df = spark.range(900).select(
        (F.col("id") % 3 * 100 + F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 * -50).alias("y"))
    rows = models.kmeans_report(df).orderBy("cluster").collect()
    centers = [r["center"] for r in rows]
    assert sum(r["size"] for r in rows) == 900 and len(rows) == 3
    assigned = models.assign_clusters(df, ["x", "y"], centers)
    means = assigned.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    for r in means.collect():
        assert np.allclose([r["x"], r["y"]], centers[r["cluster"]], atol=1e-6)
        assert r["n"] == rows[r["cluster"]]["size"]
    distances = [min((r["x"] - c[0]) ** 2 + (r["y"] - c[1]) ** 2 for c in centers) for r in df.collect()]
    assert math.isclose(sum(distances), rows[0]["training_cost"], rel_tol=1e-6)
    assert models.kmeans_report(df, k=2).count() == 2


def test_assign_clusters_takes_the_lower_number_on_a_tie(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "v double")
    found = models.assign_clusters(df, ["v"], [[10.0], [0.0], [0.0]])
    assert sorted(map(tuple, found.collect())) == [(0.0, 1), (5.0, 0), (10.0, 0)]


def test_assign_clusters_grows_with_the_centers_only(spark):
    df = spark.range(500).select(*[((F.col("id") * (i + 3)) % 97).cast("double").alias(f"x{i}") for i in range(8)])
    centers = np.random.default_rng(1).uniform(0, 97, (80, 8))
    rows = models.assign_clusters(df, df.columns, centers.tolist()).collect()
    for r in rows:
        distance = ((np.array(r[:8]) - centers) ** 2).sum(1)
        assert distance[r["cluster"]] <= distance.min() + 1e-9


def test_accuracy(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (0.0, 0.0)], "label double, prediction double")
    assert df.agg(models.accuracy(F.col("label"), F.col("prediction")).alias("a")).first()["a"] == 0.666667


def test_labels_of_a_named_column_stay_on_spark(spark, monkeypatch):
    monkeypatch.setattr(fx, "label_indexer", lambda *a: 1 / 0)
    monkeypatch.setattr(models, "LOGISTIC_ITERATIONS", 1)
    df = spark.range(9000).select((F.col("id") % 2500).alias("x"), F.concat(F.lit("k"), F.col("id") % 2500).alias("k"))
    fit = models.train_classifier(df, "k")
    assert fit.classes == 2500 and fit.model.numClasses == 2500
    rows = fit.train.unionAll(fit.test).select("features", "label").collect()
    assert len(rows) == 9000
    order = {r["label"]: r["label_index"] for r in fit.labels.collect()}
    assert sorted(order.values()) == list(range(2500))
    assert {(int(r["features"][0]), r["label"]) for r in rows} == {(i, order[f"k{i}"]) for i in range(2500)}


def test_calibration_counts(spark):
    df = spark.range(900).select((F.col("id") % 7).alias("x"), F.concat(F.lit("k"), F.least(F.col("id") % 5, F.lit(3))).alias("k"))
    fit = models.train_classifier(df, "k", ["x"], None, "md5")
    rows = {r["label"]: r for r in models.calibration(fit).collect()}
    assert set(rows) == {"k0", "k1", "k2", "k3"} and sum(r["train_rows"] + r["test_rows"] for r in rows.values()) == 900
    assert sum(r["share"] for r in rows.values()) == pytest.approx(1)
    assert all(abs(r["share"] - r["mean_probability"]) < 1e-4 for r in rows.values())
