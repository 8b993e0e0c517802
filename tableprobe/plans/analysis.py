"""One dataset from file to written reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tableprobe.operators.jobs import held, run_jobs, shared_scan
from tableprobe.operators.profile import describe
from tableprobe.plans import reading
from tableprobe.sources.datasets import check_dataset, read_dataset
from tableprobe.sources.reports import make_run_id, read_report, write_run
from tableprobe.sources.scratch import has_shared_folder, scratch_directory
from tableprobe.sources.staging import reads_in_one_pass, stage_dataset


def analyze(spark: SparkSession, path: str | list[str], file_type: str, report_base: str, run_id: str | None = None,
            hold: bool = False, staging: str | None = None, **options) -> tuple[str, DataFrame, DataFrame]:
    """Read, profile and model a dataset; publish both reports and return the run id and the written reports.

    The profile and the jobs scan the dataset a dozen times. ``staging``, a path on shared storage, has it parsed
    once into Parquet there, from which every scan takes only its columns; the copy is the caller's to remove.
    ``hold`` keeps it in the executors' memory and disks instead. Without either, the way that is cheapest by the
    dataset's size, the number of scans and the free memory is taken, see `tableprobe.plans.reading`; a copy then goes
    to the session's shared folder. Readers see both reports or none.
    """
    name = os.path.basename((path if isinstance(path, str) else path[0]).rstrip("/"))
    run_id = run_id or make_run_id(name)
    way, cells = _way(spark, path, file_type, hold, staging, options)
    if way == reading.STAGE:
        df = stage_dataset(spark, path, file_type, staging or scratch_directory(spark), **options)
    else:
        df = cells if cells is not None else read_dataset(spark, path, file_type, **options)
    if way == reading.HOLD:
        with held(df) as table:
            _write(table, file_type, report_base, run_id)
    else:
        _write(df, file_type, report_base, run_id)
    return (run_id, read_report(spark, report_base, run_id, "descriptive"),
            read_report(spark, report_base, run_id, "ml"))


def _way(spark: SparkSession, path: str | list[str], file_type: str, hold: bool, staging: str | None,
         options: dict) -> tuple[str, DataFrame | None]:
    """How to read the dataset, and the dataset if it has been opened with its types for that; refuses what is empty.

    CSV is opened without types first, which reads a line, so that a copy of it reads the text once in all.
    """
    one_pass = reads_in_one_pass(spark, file_type, options)
    cells = read_dataset(spark, path, file_type, **{**options, "inferSchema": False}) if one_pass else read_dataset(
        spark, path, file_type, **options)
    size = check_dataset(cells, path, file_type)
    if staging is not None:
        way = reading.STAGE
    elif hold:
        way = reading.HOLD
    else:
        scans = reading.scans_of(cells, not one_pass)
        way = reading.choose(size, scans, reading.storage_memory(spark), has_shared_folder(spark))
    return way, None if one_pass else cells


def _write(df: DataFrame, file_type: str, report_base: str, run_id: str) -> None:
    scan = shared_scan(df, file_type)
    try:
        stats = scan.stats() if scan is not None else None
        write_run({"descriptive": describe(df, file_type, stats=stats), "ml": run_jobs(df, file_type, shared=scan)},
                  report_base, run_id)
    finally:
        if scan is not None:
            scan.close()
