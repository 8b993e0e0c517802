"""Time the headline queries: one warm-up run each, then the median of several.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one line of JSON. Query names given as arguments
replace the headline set. With the headline set come, for comparison, the lineitem profile, its label candidates and
a profile of 200 columns next to plans that take one action per column, the four jobs next to the same fits run in
turn with a count before each, and the bytes that distinct counts of keys shuffle as words next to values.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe import describe, label_candidates, numeric_columns, run_jobs
from tableprobe.operators.profile import bitmaps, stacked
from tableprobe.plans.catalog import QUERIES
from tableprobe.sources.scratch import own_folder

HEADLINE = [
    "profile_lineitem", "profile_distinct", "profile_distinct_nested", "label_index_wide", "kmeans_assign_many",
    "logistic_calibration", "profile_nulls", "profile_numeric", "profile_distinct_texts",
    "label_candidates", "ts_daily_events", "ts_daily_lineitem", "ts_mixed_formats", "ts_first10",
    "regression_one", "regression_two", "regression_auto", "classification_report", "kmeans_report",
    "kmeans_assign", "label_index", "split_counts", "job_report", "src_csv", "src_json", "scaling_report",
    "analyze_csv", "src_csv_staged", "profile_increment", "profile_distinct_keys",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    own_folder(spark)
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> None:
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def median(action, repeats: int) -> float:
    def timed() -> float:
        start = time.perf_counter()
        action()
        return time.perf_counter() - start

    timed()
    return round(statistics.median(timed() for _ in range(repeats)), 3)


def shuffled_bytes(df: DataFrame) -> int:
    """Bytes that all exchanges of a plan wrote, from the metrics of the plan that ran."""
    df.collect()

    def of(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(node.plan())
        written = node.metrics().get("shuffleBytesWritten")
        children = node.children()
        return (written.get().value() if written.isDefined() else 0) + sum(
            of(children.apply(i)) for i in range(children.size()))

    return of(df._jdf.queryExecution().executedPlan())


def compare(spark: SparkSession, sf_dir: str, repeats: int) -> dict[str, dict[str, float]]:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    numeric = numeric_columns(df)

    def distinct_by_column():
        return [df.select(c).na.drop().distinct().count() for c in df.columns]

    def profile_by_column():
        df.count()
        for c in df.columns:
            df.where(F.col(c).isNull()).count()
            df.select(c).distinct().count()
        df.agg(*[f(c) for c in numeric for f in (F.min, F.max, F.avg)]).collect()

    wide = df.select(*[(F.col(numeric[i % len(numeric)]) + i).alias(f"c{i}") for i in range(200)])

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    few = wide.limit(1000).cache()
    few.count()

    def wide_by_column():
        for c in few.columns:
            few.where(F.col(c).isNull()).count()
            few.select(c).distinct().count()
        few.agg(*[f(c) for c in few.columns for f in (F.min, F.max, F.avg)]).collect()

    keys = [f for f in df.schema.fields if f.name in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    (_, values), = stacked(df, keys)
    return {
        "distinct_keys_shuffled_bytes": {"tableprobe": shuffled_bytes(bitmaps(values).groupBy("pos").count()),
                                         "values": shuffled_bytes(values.distinct().groupBy("pos").count())},
        "jobs": {"tableprobe": median(lambda: run_jobs(orders).collect(), repeats),
                 "in_turn": median(lambda: jobs_in_turn(orders), repeats)},
        "wide_profile_1000_rows": {"tableprobe": median(lambda: describe(few).collect(), repeats),
                                   "by_column": median(wide_by_column, 1)},
        "profile": {"tableprobe": median(lambda: describe(df).collect(), repeats),
                    "by_column": median(profile_by_column, repeats)},
        "label_candidates": {"tableprobe": median(lambda: label_candidates(df).collect(), repeats),
                             "by_column": median(distinct_by_column, repeats)},
    }


def jobs_in_turn(orders) -> None:
    """The four jobs on the orders, one after the other, each counting its input and scanning per column."""
    numeric = numeric_columns(orders)
    rows = orders.dropna(subset=numeric)
    rows.count()
    features = VectorAssembler(inputCols=numeric[:-1], outputCol="v").transform(rows)
    LinearRegression(featuresCol="v", labelCol=numeric[-1]).fit(features)
    for c in orders.columns:
        orders.select(c).na.drop().distinct().count()
    rows.count()
    vectors = VectorAssembler(inputCols=numeric, outputCol="v").transform(rows)
    indexed = StringIndexer(inputCol="o_orderstatus", outputCol="y", handleInvalid="skip").fit(vectors).transform(vectors)
    train, test = indexed.randomSplit([0.8, 0.2], 42)
    train.count(), test.count()
    scored = LogisticRegression(featuresCol="v", labelCol="y", maxIter=50).fit(train).transform(test)
    scored.where("y = prediction").count(), test.count(), indexed.select("y").distinct().count()
    rows.count()
    KMeans(k=3, seed=42, featuresCol="v").fit(vectors)
    days = orders.select(F.to_date("o_orderdate").alias("day"), numeric[0]).dropna()
    days.count()
    days.groupBy("day").agg(F.count("*"), *[f(numeric[0]) for f in (F.avg, F.min, F.max, F.sum)]).orderBy(
        "day").limit(10).collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = session()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds[name] = median(lambda: run(spark, name, sf_dir), repeats)
    compared = {} if sys.argv[1:] else compare(spark, sf_dir, repeats)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")), "repeats": repeats, "compared": compared}))
    spark.stop()


if __name__ == "__main__":
    main()
