"""The four jobs as one suite: each yields metrics or a coded reason for being skipped."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableprobe.functions.columns import finite_or_none
from tableprobe.operators import models, roles
from tableprobe.operators.models import REASONS, SkipJob
from tableprobe.operators.scaling import TIMINGS_SCHEMA
from tableprobe.operators.shared import SharedScan
from tableprobe.operators.timeseries import FIRST_DAYS, daily_stats, first_days

DAY_SCHEMA = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("count", T.LongType()),
    T.StructField("mean_value", T.DoubleType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("sum_value", T.DoubleType()),
])

REPORT_SCHEMA = T.StructType([
    T.StructField("job_order", T.IntegerType()),
    T.StructField("job", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("skipped", T.BooleanType()),
    T.StructField("reason_code", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("numeric_columns", T.ArrayType(T.StringType())),
    T.StructField("method", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
    T.StructField("centers", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("date_column", T.StringType()),
    T.StructField("value_column", T.StringType()),
    T.StructField("sample", T.ArrayType(DAY_SCHEMA)),
])


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The table kept in memory and on disk, and read once, for the length of the block.

    A table that its owner keeps already stays so afterwards.
    """
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        df.count()
        yield df
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept.count()
        yield kept
    finally:
        kept.unpersist()


def _daily_sample(df: DataFrame, date_col: str | None = None, value_col: str | None = None,
                  shared: SharedScan | None = None) -> dict:
    date_col = date_col or roles.date_column(df)
    if date_col is None:
        raise SkipJob("NO_DATE")
    value_col = value_col or roles.value_column(df)
    if value_col is None:
        raise SkipJob("NO_NUMERIC")
    known = shared is not None and (shared.date_col, shared.value_col) == (date_col, value_col)
    days = first_days(shared.days() if known else daily_stats(df, date_col, value_col), FIRST_DAYS).collect()
    if not days:
        raise SkipJob("EMPTY_AFTER_PARSE")
    sample = [tuple(finite_or_none(v) if isinstance(v, float) else v for v in day) for day in days]
    return {"method": "daily", "date_column": date_col, "value_column": value_col, "sample": sample}


# In the order of the report.
JOBS: dict[str, Callable[..., dict]] = {
    "regression": models.fit_regression,
    "classification": models.fit_classification,
    "clustering": models.fit_kmeans,
    "timeSeries": _daily_sample,
}

SHARING = ("regression", "timeSeries")


def _is_text(file_type: str | None) -> bool:
    return (file_type or "").strip().lower() == "text"


def _skip(code: str, reason: str | None = None) -> dict:
    return {"skipped": True, "reason_code": code, "reason": reason or REASONS[code]}


def _outcome(job: str, df: DataFrame, file_type: str, capture: bool, **arguments) -> dict:
    """Run one job; ``capture`` turns any failure into a skip, otherwise only known reasons are."""
    if _is_text(file_type):
        return _skip("TEXT_INPUT")
    try:
        return {"skipped": False, **JOBS[job](df, **arguments)}
    except SkipJob as skip:
        return _skip(skip.code)
    except Exception as error:  # one job must not stop the others
        if not capture:
            raise
        return _skip("ERROR", str(error))


def _report(df: DataFrame, file_type: str, outcomes: dict[str, dict]) -> DataFrame:
    order = list(JOBS)
    numeric = [] if _is_text(file_type) else roles.numeric_columns(df)
    rows = []
    for job, outcome in outcomes.items():
        known = {"job_order": order.index(job) + 1, "job": job, "numeric_columns": numeric,
                 "file_type": (file_type or "").strip().lower(), **outcome}
        rows.append(tuple(known.get(f.name) for f in REPORT_SCHEMA.fields))
    return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def run_job(job: str, df: DataFrame, file_type: str = "csv", **arguments) -> DataFrame:
    """The report row of one job; failures other than the known reasons for a skip are raised."""
    return _report(df, file_type, {job: _outcome(job, df, file_type, capture=False, **arguments)})


def shared_scan(df: DataFrame, file_type: str = "csv", arguments: dict[str, dict] | None = None) -> SharedScan | None:
    """The scan that the regression, the daily job and the profile can share; None if it would serve one of them only.

    The caller closes it.
    """
    arguments = arguments or {}
    if _is_text(file_type):
        return None
    try:
        columns = models.regression_columns(df, **arguments.get("regression", {}))
    except SkipJob:
        return None
    dates = arguments.get("timeSeries", {})
    date_col = dates.get("date_col") or roles.date_column(df)
    value_col = dates.get("value_col") or roles.value_column(df)
    known = {f.name: f.dataType for f in df.schema.fields}
    if date_col not in known or value_col not in known or any(c not in known for c in columns):
        return None
    return SharedScan(df, columns, date_col, value_col) if SharedScan.fits(df, columns) else None


def run_jobs(df: DataFrame, file_type: str = "csv", hold: bool = False, concurrent: bool = True,
             arguments: dict[str, dict] | None = None, shared: SharedScan | None = None) -> DataFrame:
    """The report of all four jobs, in order; a job that fails becomes a skip with its message.

    The jobs do not depend on each other and are submitted together, so that one's short stages fill the gaps of
    another's; ``concurrent=False`` runs them in turn. ``arguments`` overrides the guessed roles per job. ``hold``
    keeps the table for the length of the run, which pays where reading it is dear, as with CSV; Parquet is
    better read again, column by column. The regression and the daily job take their sums from one scan, ``shared`` if
    it is given, and each by itself if that fails.
    """
    arguments = arguments or {}

    def outcomes(table: DataFrame) -> dict[str, dict]:
        scan = shared or shared_scan(table, file_type, arguments)

        @inheritable_thread_target(df.sparkSession)
        def outcome(job: str) -> dict:
            own = arguments.get(job, {})
            if scan is not None and job in SHARING:
                found = _outcome(job, table, file_type, True, **own, shared=scan)
                if found.get("reason_code") != "ERROR":
                    return found
            return _outcome(job, table, file_type, True, **own)

        try:
            with ThreadPoolExecutor(len(JOBS) if concurrent else 1) as pool:
                return dict(zip(JOBS, pool.map(outcome, JOBS)))
        finally:
            if scan is not None and scan is not shared:
                scan.close()

    if hold and not _is_text(file_type):
        with held(df) as table:
            return _report(df, file_type, outcomes(table))
    return _report(df, file_type, outcomes(df))


def time_jobs(df: DataFrame, file_type: str = "csv", workers: int | None = None) -> DataFrame:
    """Timings of the four jobs on this session, in `TIMINGS_SCHEMA`; reading the table is not timed.

    ``workers`` defaults to the cores the session uses. Union the timings of several sizes of cluster, or write
    them, and hand them to `scaling_report`. Text yields no rows.
    """
    spark = df.sparkSession
    if _is_text(file_type):
        return spark.createDataFrame([], TIMINGS_SCHEMA)
    workers = workers or spark.sparkContext.defaultParallelism
    rows = []
    with held(df) as table:
        for job in JOBS:
            start = time.perf_counter()
            outcome = _outcome(job, table, file_type, capture=False)
            elapsed = time.perf_counter() - start
            rows.append((job, workers, elapsed, outcome["skipped"], outcome.get("reason") or ""))
    return spark.createDataFrame(rows, TIMINGS_SCHEMA)
