"""Speedup and efficiency from a table of job timings: (job, workers, elapsed, skipped, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import ratio

BROADCAST_JOBS = 100_000
SALTS = 64

TIMINGS_SCHEMA = T.StructType([
    T.StructField("job", T.StringType()),
    T.StructField("workers", T.IntegerType()),
    T.StructField("elapsed", T.DoubleType()),
    T.StructField("skipped", T.BooleanType()),
    T.StructField("reason", T.StringType()),
])


def scaling_report(timings: DataFrame) -> DataFrame:
    """Add speedup over the run with the fewest workers of the same job, and efficiency in percent.

    The baseline of a job is an aggregate joined back, not a window over the job's runs. The baselines, one row per
    job, are counted when this is called: up to ``BROADCAST_JOBS`` they are broadcast; more are dealt with the runs
    by job and salt, so that a job with very many runs is spread over as many tasks as there are salts. Of several
    runs with the fewest workers the fastest counts.
    """
    fastest = timings.groupBy("job", "workers").agg(F.min("elapsed").alias("elapsed"))
    baselines = fastest.groupBy(F.col("job").alias("base_job")).agg(
        F.min_by("elapsed", "workers").alias("baseline"))
    same_job = F.col("job").eqNullSafe(F.col("base_job"))
    if baselines.count() <= BROADCAST_JOBS:
        joined = timings.join(F.broadcast(baselines), same_job)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = timings.withColumn("salt", F.pmod(F.xxhash64(*timings.columns, F.spark_partition_id()), SALTS))
        joined = salted.join(baselines.withColumn("base_salt", salts).hint("merge"),
                             same_job & (F.col("salt") == F.col("base_salt")))
    speedup = ratio(F.col("baseline"), F.col("elapsed"))
    efficiency = ratio(speedup * 100.0, F.col("workers"))
    return joined.select(
        "job", "workers", F.round("elapsed", 2).alias("time"), F.round(speedup, 3).alias("speedup"),
        F.round(efficiency, 2).alias("efficiency"), "skipped", "reason")


def scaling_skips(timings: DataFrame) -> DataFrame:
    """Per job: was any run skipped?"""
    return timings.groupBy("job").agg(F.bool_or("skipped").alias("any_skipped"))
