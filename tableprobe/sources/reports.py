"""Keep reports as JSON, one directory per kind and run, published by a manifest."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import is_floating, quoted
from tableprobe.operators.jobs import REPORT_SCHEMA
from tableprobe.operators.profile import PROFILE_SCHEMA

# The kinds of report, with the schema of each.
SCHEMAS = {"descriptive": PROFILE_SCHEMA, "ml": REPORT_SCHEMA}


RUN_ID = r"[A-Za-z0-9_.-]+"


def make_run_id(file_name: str, now: datetime | None = None) -> str:
    """Time to the second and the file name, reduced to letters, digits, dots, dashes and underscores."""
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", file_name.replace("/", " ")).strip("._")
    return f"{(now or datetime.now()):%Y%m%d_%H%M%S}_{safe}"


def _kind(kind: str) -> str:
    name = (kind or "").strip().lower()
    if name not in SCHEMAS:
        raise ValueError(f"unknown report kind: {kind!r}; one of {', '.join(SCHEMAS)}")
    return name


def _directory(base: str, run_id: str, kind: str) -> str:
    if not re.fullmatch(RUN_ID, run_id or "") or not run_id.strip("."):
        raise ValueError(f"not a run id: {run_id!r}; letters, digits, dots, dashes and underscores make one")
    return f"{base.rstrip('/')}/kind={_kind(kind)}/run_id={run_id}"


def _holds_floats(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _holds_floats(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return _holds_floats(data_type.valueType)
    if isinstance(data_type, T.StructType):
        return any(_holds_floats(f.dataType) for f in data_type.fields)
    return is_floating(data_type)


def _finite(value: Column, data_type: T.DataType) -> Column:
    """The value with null for every NaN and infinity in it, at any depth."""
    if not _holds_floats(data_type):
        return value
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda e: _finite(e, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, v: _finite(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        parts = [_finite(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    return F.when(F.abs(value) < float("inf"), value)  # NaN is above infinity


def _finite_only(df: DataFrame) -> DataFrame:
    """JSON has no number for NaN and the infinities; they are written as null."""
    return df.select(*[_finite(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _manifest(base: str, run_id: str) -> str:
    """Where a run says which of its reports are whole; names that start so are no data to Spark's readers."""
    return f"{base.rstrip('/')}/_published/run_id={run_id}"


def _published(spark: SparkSession, base: str, run_id: str) -> set[str]:
    try:
        rows = spark.read.schema("kind string").json(_manifest(base, run_id)).distinct().collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return set()
        raise
    return {r["kind"] for r in rows if r["kind"] in SCHEMAS}


def write_run(reports: dict[str, DataFrame], base: str, run_id: str) -> list[str]:
    """Write the reports of a run, by kind, as JSON lines and return their directories.

    Readers see all of them or none: they go by a manifest, which is written last and as one file. What an earlier
    attempt left without one is written anew; a report that is published is not overwritten.
    """
    if not reports:
        return []
    directories = {_kind(kind): _directory(base, run_id, kind) for kind in reports}
    spark = next(iter(reports.values())).sparkSession
    before = _published(spark, base, run_id)
    if twice := before & directories.keys():
        raise ValueError(f"the run {run_id!r} already exists: {', '.join(sorted(twice))}")
    for (kind, directory), report in zip(directories.items(), reports.values()):
        _finite_only(report).write.mode("overwrite").json(directory)
    (spark.createDataFrame([(kind,) for kind in directories], "kind string").coalesce(1)
     .write.mode("append").json(_manifest(base, run_id)))
    return list(directories.values())


def write_report(report: DataFrame, base: str, run_id: str, kind: str) -> str:
    """Write and publish one report of a run and return its directory; see `write_run`."""
    return write_run({kind: report}, base, run_id)[0]


def read_report(spark: SparkSession, base: str, run_id: str, kind: str,
                schema: T.StructType | str | None = None) -> DataFrame | None:
    """The report of a run with its ``run_id``, or None if none is published; reads that directory only."""
    directory = _directory(base, run_id, kind)
    if _kind(kind) not in _published(spark, base, run_id):
        return None
    report = spark.read.schema(schema or SCHEMAS[_kind(kind)]).json(directory)
    return report.withColumn("run_id", F.lit(run_id))


def published_runs(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, kind) of every report that is published under ``base``."""
    empty = spark.createDataFrame([], "run_id string, kind string")
    try:
        found = spark.read.schema("kind string, run_id string").option("basePath", f"{base.rstrip('/')}/_published").json(
            f"{base.rstrip('/')}/_published/run_id=*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    return found.where(F.col("kind").isin(*SCHEMAS)).select("run_id", "kind").distinct()
