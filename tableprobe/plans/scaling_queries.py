"""Scaling report queries, on timings derived from the events: a job per event type, a run per user group."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import total
from tableprobe.operators.scaling import scaling_report, scaling_skips
from tableprobe.plans.tables import EXACT, table

LONG_RUN = 25000.0  # a derived run of less than this counts as skipped


def timings(spark, sf_dir):
    workers = F.pow(F.lit(2), F.col("user_id") % 4).cast("int")
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("job"), workers.alias("workers"))
    skipped = F.col("elapsed") < LONG_RUN
    return runs.agg(F.expr(total("value", T.DoubleType(), EXACT)).alias("elapsed")).select(
        "job", "workers", "elapsed", skipped.alias("skipped"),
        F.when(skipped, "EMPTY_AFTER_CLEAN").otherwise("").alias("reason"))


QUERIES = {
    "scaling_report": lambda spark, d: scaling_report(timings(spark, d)),
    "scaling_skips": lambda spark, d: scaling_skips(timings(spark, d)),
}

_TIMINGS = f"""timings AS (
    SELECT event_type AS job, power(2, user_id % 4)::INT AS workers,
           sum(value::DECIMAL(18,2))::DOUBLE AS elapsed
    FROM events GROUP BY 1, 2),
marked AS (SELECT *, elapsed < {LONG_RUN} AS skipped FROM timings),
based AS (SELECT *, first_value(elapsed) OVER (PARTITION BY job ORDER BY workers, elapsed) AS baseline FROM marked)"""

ORACLES = {
    "scaling_report": f"""
        WITH {_TIMINGS}
        SELECT job, workers, round(elapsed, 2) AS time,
               round(CASE WHEN elapsed > 0 THEN baseline / elapsed ELSE 0 END, 3) AS speedup,
               round(CASE WHEN elapsed > 0 THEN baseline / elapsed ELSE 0 END * 100.0 / workers, 2) AS efficiency,
               skipped, CASE WHEN skipped THEN 'EMPTY_AFTER_CLEAN' ELSE '' END AS reason
        FROM based""",
    "scaling_skips": f"WITH {_TIMINGS} SELECT job, bool_or(skipped) AS any_skipped FROM marked GROUP BY job",
}
