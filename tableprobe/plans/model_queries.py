"""Column role, feature, model and job queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import mean
from tableprobe.operators import features as fx
from tableprobe.operators import models, roles
from tableprobe.operators.jobs import run_job, run_jobs
from tableprobe.plans.tables import EXACT, LINEITEM_TYPES, ORDERS_TYPES, PART_TYPES, table

CENTERS = [[10.0], [60.0], [200.0]]  # fixed starting centers for events.value
MANY_CENTERS = 60


def _label_candidates(spark, sf_dir):
    found = [roles.label_candidates(table(spark, sf_dir, name)).withColumn("table_name", F.lit(name))
             for name in ("part", "lineitem", "orders")]
    return reduce(lambda a, b: a.unionByName(b), found)


def _class_features(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    features, label = roles.classification_roles(orders)
    vectors = fx.assemble(fx.clean_columns(orders, features, label, "string"), len(features))
    values = vector_to_array("features")
    return vectors.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("label").alias("num_classes"),
        F.max(F.size(values)).alias("n_features"), F.max(F.get(values, F.lit(0))).alias("max_first"),
    ).select(F.lit(label).alias("label"), F.lit(",".join(features)).alias("features"),
             "rows", "num_classes", "n_features", "max_first")


def _split_counts(spark, sf_dir):
    train, test = fx.split(table(spark, sf_dir, "customer"), ["c_custkey"], "md5")
    parts = train.select(F.lit("train").alias("part")).unionByName(test.select(F.lit("test").alias("part")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


def _class_split(spark, sf_dir):
    """Rows of each indexed label on either side of the split."""
    orders = table(spark, sf_dir, "orders")
    clean = fx.clean_columns(orders, ["o_totalprice"], "o_orderpriority", "string", extra=["o_orderkey"])
    indexed = fx.label_indexer(clean).transform(clean)
    in_train = fx.hash_bucket([F.col("x0")], portable=True) < fx.TRAIN_PERCENT
    return indexed.groupBy("label_index").agg(
        F.count_if(in_train).alias("train_rows"), F.count_if(~in_train).alias("test_rows"))


def _regression(spark, sf_dir, name, label, features):
    """Coefficients as rows, rounded well away from the noise of the solver."""
    report = models.regression_report(table(spark, sf_dir, name), label, features)
    return report.select(
        *[F.round(F.get("coefficients", F.lit(i)), 4).alias(f"slope_{i + 1}")
          for i in range(len(features) if features else 2)],
        F.round("intercept", 3).alias("intercept"), F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"))


def _accuracy(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(
        models.accuracy(F.col("quality"), F.col("toxic")).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def _kmeans_step(spark, sf_dir):
    """Nearest fixed center of every event, and where each center moves to."""
    assigned = models.assign_clusters(table(spark, sf_dir, "events"), ["value"], CENTERS)
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.expr(mean("value", T.DoubleType(), EXACT)).alias("center"))


def _many_centers(spark, sf_dir):
    """Events by the nearest of sixty centers."""
    centers = [[5.0 * i] for i in range(MANY_CENTERS)]
    return models.assign_clusters(table(spark, sf_dir, "events"), ["value"], centers).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"))


def _logistic_calibration(spark, sf_dir):
    """Share and mean probability of every class in the training part of the orders, by a fit on one feature."""
    fit = models.train_classifier(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"], ["o_orderkey"],
                                  "md5")
    return models.calibration(fit).select(
        "label", "train_rows", "test_rows", F.round("share", 6).alias("share"),
        (F.abs(F.col("share") - F.col("mean_probability")) < 1e-4).alias("calibrated"))


def _kmeans_check(spark, sf_dir):
    """Whether the fitted centers are the means of the rows nearest to them, within a hundredth of the deviation, and
    whether the cost is the sum of these rows' squared distances."""
    events = table(spark, sf_dir, "events")
    fit = models.fit_kmeans(events, ["value"])
    centers = spark.createDataFrame([(i, c[0]) for i, c in enumerate(fit["centers"])], "cluster int, center double")
    assigned = models.assign_clusters(events, ["value"], fit["centers"]).join(F.broadcast(centers), "cluster")
    means = assigned.groupBy("cluster", "center").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("size"),
        F.sum(F.pow(F.col("value") - F.col("center"), 2)).alias("cost"))
    spread = events.agg(F.stddev_pop("value").alias("spread")).first()["spread"]
    cost = fit["metrics"]["training_cost"]
    return means.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("rows"),
        F.lit(sum(fit["sizes"])).cast("bigint").alias("fitted_rows"),
        F.bool_and(F.abs(F.col("mean") - F.col("center")) <= 0.01 * spread).alias("centered"),
        (F.abs(F.sum("cost") - cost) <= 1e-6 * cost).alias("cost_agrees"))


def _job_report(spark, sf_dir):
    """The four jobs on the orders: roles, slopes to four digits, and the whole sample of days."""
    day = "concat_ws(':', d.day, d.count, bigint(d.min_value), bigint(d.max_value), bigint(d.sum_value))"
    return run_jobs(table(spark, sf_dir, "orders")).select(
        "job_order", "job", "skipped", "label", F.array_join("features", ",").alias("features"),
        *[F.round(F.get("coefficients", F.lit(i)), 4).alias(f"slope_{i + 1}") for i in range(2)],
        F.element_at("metrics", "num_classes").alias("num_classes"),
        F.array_join(F.expr(f"transform(sample, d -> {day})"), ",").alias("days"))


def _single_job(spark, sf_dir):
    """The first ten days of the events by the single-job entry point."""
    report = run_job("timeSeries", table(spark, sf_dir, "events"), date_col="ts", value_col="value")
    return report.select("job", F.explode("sample").alias("d")).select(
        "job", "d.day", "d.count", "d.min_value", "d.max_value")


def _job_status(spark, sf_dir):
    """Which jobs run on which table, on which columns, and why the others are skipped."""
    reports = [run_jobs(table(spark, sf_dir, name)).withColumn("table_name", F.lit(name))
               for name in ("orders", "customer", "pages")]
    return reduce(lambda a, b: a.unionByName(b), reports).select(
        "table_name", "job_order", "job", "skipped", "reason_code", "label",
        F.array_join("features", ",").alias("features"), "date_column", "value_column",
        F.get("sample", F.lit(0))["count"].alias("first_day_count"))


QUERIES = {
    "label_candidates": _label_candidates,
    "class_features": _class_features,
    "label_index": lambda spark, d: fx.label_index(table(spark, d, "lineitem"), "l_returnflag"),
    "label_index_wide": lambda spark, d: fx.label_index(table(spark, d, "lineitem"), "l_suppkey"),
    "split_counts": _split_counts,
    "class_split": _class_split,
    "regression_one": lambda spark, d: _regression(spark, d, "lineitem", "l_extendedprice", ["l_quantity"]),
    "regression_two": lambda spark, d: _regression(
        spark, d, "lineitem", "l_extendedprice", ["l_quantity", "l_discount"]),
    "regression_auto": lambda spark, d: _regression(spark, d, "customer", None, None),
    "accuracy_agg": _accuracy,
    "classification_report": lambda spark, d: models.classification_report(table(spark, d, "orders")),
    "kmeans_report": lambda spark, d: models.kmeans_report(table(spark, d, "events"), ["value"]),
    "logistic_calibration": _logistic_calibration,
    "kmeans_check": _kmeans_check,
    "kmeans_assign": _kmeans_step,
    "kmeans_assign_many": _many_centers,
    "job_report": _job_report,
    "job_single": _single_job,
    "job_status": _job_status,
}


def _candidates_sql(name: str, types: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS \"column\", {pos} AS pos, "
        f"count(DISTINCT {c}) AS distinct_count FROM {name}" for pos, c in enumerate(types))


def _two_features_sql(source: str, y: str, x1: str, x2: str) -> str:
    """Normal equations of two features in closed form."""
    return f"""
        WITH moments AS (
            SELECT avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, var_pop({y}) AS syy,
                   var_pop({x1}) AS s11, var_pop({x2}) AS s22, covar_pop({x1}, {x2}) AS s12,
                   covar_pop({x1}, {y}) AS s1y, covar_pop({x2}, {y}) AS s2y
            FROM {source}),
        slopes AS (
            SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
                   (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM moments),
        fit AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM slopes),
        errors AS (
            SELECT avg(power({y} - b0 - b1 * {x1} - b2 * {x2}, 2)) AS mse FROM {source}, fit)
        SELECT round(b1, 4) AS slope_1, round(b2, 4) AS slope_2, round(b0, 3) AS intercept,
               round(sqrt(mse), 4) AS rmse, round(1 - mse / syy, 8) AS r2
        FROM fit, errors"""


# table, order, job, skip code, label, features, date column, value column
_STATUS_ROWS = """
    ('orders', 1, 'regression', NULL, 'o_totalprice', 'o_orderkey,o_custkey', NULL, NULL),
    ('orders', 2, 'classification', NULL, 'o_orderstatus', 'o_orderkey,o_custkey,o_totalprice', NULL, NULL),
    ('orders', 3, 'clustering', NULL, NULL, 'o_orderkey,o_custkey,o_totalprice', NULL, NULL),
    ('orders', 4, 'timeSeries', NULL, NULL, NULL, 'o_orderdate', 'o_orderkey'),
    ('customer', 1, 'regression', NULL, 'c_acctbal', 'c_custkey,c_nationkey', NULL, NULL),
    ('customer', 2, 'classification', NULL, 'c_mktsegment', 'c_custkey,c_nationkey,c_acctbal', NULL, NULL),
    ('customer', 3, 'clustering', NULL, NULL, 'c_custkey,c_nationkey,c_acctbal', NULL, NULL),
    ('customer', 4, 'timeSeries', 'NO_DATE', NULL, NULL, NULL, NULL),
    ('pages', 1, 'regression', 'FEW_NUMERIC', NULL, NULL, NULL, NULL),
    ('pages', 2, 'classification', 'NO_LABEL', NULL, NULL, NULL, NULL),
    ('pages', 3, 'clustering', 'FEW_NUMERIC', NULL, NULL, NULL, NULL),
    ('pages', 4, 'timeSeries', 'NO_DATE', NULL, NULL, NULL, NULL)"""

ORACLES = {
    "label_candidates": "SELECT table_name, \"column\", distinct_count, pos FROM (" + " UNION ALL ".join(
        _candidates_sql(n, t) for n, t in
        (("part", PART_TYPES), ("lineitem", LINEITEM_TYPES), ("orders", ORDERS_TYPES))
    ) + ") WHERE distinct_count BETWEEN 2 AND 20",
    "class_features": """
        SELECT 'o_orderstatus' AS label, 'o_orderkey,o_custkey,o_totalprice' AS features, count(*) AS rows,
               count(DISTINCT o_orderstatus) AS num_classes, 3 AS n_features, max(o_orderkey)::DOUBLE AS max_first
        FROM orders""",
    "label_index": """
        SELECT l_returnflag AS label, (row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1)::DOUBLE
               AS label_index, count(*) AS rows
        FROM lineitem GROUP BY l_returnflag""",
    "split_counts": """
        SELECT CASE WHEN ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 100 < 80
                    THEN 'train' ELSE 'test' END AS part, count(*) AS rows
        FROM customer GROUP BY 1""",
    "class_split": """
        WITH indexed AS (
            SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS label_index
            FROM orders GROUP BY o_orderpriority)
        SELECT label_index::DOUBLE AS label_index,
               count(*) FILTER (WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 80)
                   AS train_rows,
               count(*) FILTER (WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 >= 80)
                   AS test_rows
        FROM orders JOIN indexed USING (o_orderpriority) GROUP BY label_index""",
    "regression_one": """
        WITH fit AS (
            SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0,
                   regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem),
        errors AS (SELECT avg(power(l_extendedprice - b0 - b1 * l_quantity, 2)) AS mse FROM lineitem, fit)
        SELECT round(b1, 4) AS slope_1, round(b0, 3) AS intercept, round(sqrt(mse), 4) AS rmse, round(r2, 8) AS r2
        FROM fit, errors""",
    "regression_two": _two_features_sql("lineitem", "l_extendedprice", "l_quantity", "l_discount"),
    "regression_auto": _two_features_sql("customer", "c_acctbal", "c_custkey", "c_nationkey"),
    "accuracy_agg": "SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, count(*) AS rows FROM labels",
    "job_status": f"""
        SELECT table_name, job_order, job, reason_code IS NOT NULL AS skipped, reason_code, label, features,
               date_column, value_column,
               CASE WHEN date_column IS NOT NULL THEN (
                   SELECT count(*) FROM orders
                   WHERE o_orderdate::DATE = (SELECT min(o_orderdate)::DATE FROM orders)) END AS first_day_count
        FROM (VALUES {_STATUS_ROWS}) AS status(
            table_name, job_order, job, reason_code, label, features, date_column, value_column)""",
    "label_index_wide": """
        SELECT l_suppkey::VARCHAR AS label, (row_number() OVER (ORDER BY count(*) DESC, l_suppkey::VARCHAR) - 1)::DOUBLE
               AS label_index, count(*) AS rows
        FROM lineitem GROUP BY l_suppkey""",
    "logistic_calibration": """
        WITH sides AS (
            SELECT o_orderpriority AS label,
                   ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 80 AS train FROM orders)
        SELECT label, count(*) FILTER (WHERE train) AS train_rows, count(*) FILTER (WHERE NOT train) AS test_rows,
               round(count(*) FILTER (WHERE train) / (SELECT count(*) FROM sides WHERE train), 6) AS share,
               true AS calibrated
        FROM sides GROUP BY label""",
    "kmeans_check": """
        SELECT least(3, count(DISTINCT value)) AS clusters, count(*) AS rows, count(*) AS fitted_rows, true AS centered,
               true AS cost_agrees
        FROM events WHERE value IS NOT NULL""",
    "kmeans_assign_many": f"""
        WITH near AS (
            SELECT list_transform(range({MANY_CENTERS}), lambda i: power(value - i * 5.0::DOUBLE, 2)) AS d FROM events)
        SELECT (list_position(d, list_min(d)) - 1)::INT AS cluster, count(*) AS size FROM near GROUP BY 1""",
    "job_single": """
        SELECT 'timeSeries' AS job, ts::DATE AS day, count(*) AS "count", min(value) AS min_value,
               max(value) AS max_value
        FROM events GROUP BY ts::DATE ORDER BY day LIMIT 10""",
    "job_report": f"""
        WITH days AS (
            SELECT o_orderdate::DATE AS day, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi,
                   sum(o_orderkey)::BIGINT AS total
            FROM orders GROUP BY 1 ORDER BY 1 LIMIT 10),
        fit AS ({_two_features_sql("orders", "o_totalprice", "o_orderkey", "o_custkey")})
        SELECT job_order, job, false AS skipped, label, features,
               CASE WHEN job_order = 1 THEN slope_1 END AS slope_1, CASE WHEN job_order = 1 THEN slope_2 END AS slope_2,
               CASE WHEN job_order = 2 THEN (SELECT count(DISTINCT o_orderstatus) FROM orders)::DOUBLE END AS num_classes,
               CASE WHEN job_order = 4 THEN (
                   SELECT string_agg(concat_ws(':', day, n, lo, hi, total), ',' ORDER BY day) FROM days) END AS days
        FROM fit, (VALUES (1, 'regression', 'o_totalprice', 'o_orderkey,o_custkey'),
                          (2, 'classification', 'o_orderstatus', 'o_orderkey,o_custkey,o_totalprice'),
                          (3, 'clustering', NULL, 'o_orderkey,o_custkey,o_totalprice'),
                          (4, 'timeSeries', NULL, NULL)) AS jobs(job_order, job, label, features)""",
    "kmeans_assign": """
        WITH assigned AS (
            SELECT value, CASE WHEN abs(value - 10) <= abs(value - 60) AND abs(value - 10) <= abs(value - 200) THEN 0
                               WHEN abs(value - 60) <= abs(value - 200) THEN 1 ELSE 2 END AS cluster
            FROM events)
        SELECT cluster, count(*) AS size, sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS center
        FROM assigned GROUP BY cluster""",
}
