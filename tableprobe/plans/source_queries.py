"""Source and sink queries: a driver table is written in a row format and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.operators.profile import describe
from tableprobe.plans.analysis import analyze
from tableprobe.plans.profile_queries import ORACLES as PROFILE_ORACLES
from tableprobe.plans.tables import EXACT, NUMERIC, ORDERS_TYPES, gapped_orders, table
from tableprobe.sources.datasets import read_dataset
from tableprobe.sources.reports import published_runs, read_report, write_report, write_run
from tableprobe.sources.scratch import scratch_directory
from tableprobe.sources.staging import stage_dataset

RUN_ID = "20240101_000000_orders.csv"
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # the writers keep milliseconds unless told


def _events_through(file_type):
    def query(spark, sf_dir):
        directory = scratch_directory(spark)
        writer = table(spark, sf_dir, "events").write.format(file_type).option("timestampNTZFormat", MICROSECONDS)
        if file_type == "csv":
            writer = writer.option("header", True)
        writer.save(directory)
        read = read_dataset(spark, directory, f" {file_type.upper()} ")
        return read.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type",
                           "value", "props")
    return query


def _staged_csv(spark, sf_dir):
    """Events written as CSV, then copied to Parquet with their types in one pass over the text."""
    directory = scratch_directory(spark)
    table(spark, sf_dir, "events").write.option("header", True).option(
        "timestampNTZFormat", MICROSECONDS).csv(directory)
    copy = stage_dataset(spark, directory, "csv", scratch_directory(spark))
    return copy.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _published(spark, sf_dir):
    """The profile of a published run, and the reports that readers see: not that of a run without its manifest."""
    base = scratch_directory(spark)
    profile = describe(gapped_orders(spark, sf_dir), exact_scale=EXACT)
    write_run({"descriptive": profile}, base, RUN_ID)
    profile.write.json(f"{base}/kind=descriptive/run_id=half")
    seen = [read_report(spark, base, run, "descriptive") for run in (RUN_ID, "half")]
    return seen[0].join(published_runs(spark, base).where("kind = 'descriptive'"), "run_id").select(
        "run_id", "kind", "column", "rows", "null_count", "distinct_count",
        F.lit(seen[1] is None).alias("half_is_absent"))


def _names_as_text(spark, sf_dir):
    directory = scratch_directory(spark)
    table(spark, sf_dir, "customer").select("c_name").write.text(directory)
    return read_dataset(spark, directory, "text")


def _text_profile(spark, sf_dir):
    lines = _names_as_text(spark, sf_dir)
    return describe(lines, "text").select("file_type", "rows", "cols", "column", "type", "null_count",
                                          "distinct_count")


def _both_reports(profile, jobs):
    """The two written reports as rows of one shape: columns with their counts and ranges, jobs with their days."""
    of_columns = profile.select(
        F.lit("descriptive").alias("report"), F.col("column").alias("name"), "rows", "null_count", "distinct_count",
        "min", "max", F.lit(None).cast("boolean").alias("skipped"), F.lit(None).cast("string").alias("reason_code"))
    of_jobs = jobs.select(
        F.lit("ml").alias("report"), F.col("job").alias("name"),
        F.expr("aggregate(sample, 0L, (n, d) -> n + d.count)").alias("rows"),
        F.lit(None).cast("bigint").alias("null_count"),
        F.expr("bigint(size(sample))").alias("distinct_count"), F.expr("array_min(sample.min_value)").alias("min"),
        F.expr("array_max(sample.max_value)").alias("max"), "skipped", "reason_code")
    return of_columns.unionByName(of_jobs)


def _analyze_csv(spark, sf_dir):
    """Orders written as CSV, then the whole way: read, profile, four jobs, both reports written and read back."""
    source, reports = scratch_directory(spark), scratch_directory(spark)
    table(spark, sf_dir, "orders").write.option("header", True).option("timestampNTZFormat", MICROSECONDS).csv(source)
    _, profile, jobs = analyze(spark, source, "csv", reports, run_id=RUN_ID, hold=True)
    return _both_reports(profile, jobs)


def _analyze_text(spark, sf_dir):
    source, reports = scratch_directory(spark), scratch_directory(spark)
    table(spark, sf_dir, "customer").select("c_name").write.text(source)
    _, profile, jobs = analyze(spark, source, "text", reports, run_id=RUN_ID)
    return _both_reports(profile, jobs)


def _bad_json(spark, sf_dir):
    """Numbers of the events as JSON lines with one line that is none: no other column of text is there."""
    directory = scratch_directory(spark)
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value"))
    bad = spark.createDataFrame([("not json",)], "value string")
    lines.unionByName(bad).write.text(directory)
    return describe(read_dataset(spark, directory, "json"), "json").select(
        "column", "rows", "null_count", "distinct_count")


def _report_round_trip(spark, sf_dir):
    base = scratch_directory(spark)
    write_report(describe(gapped_orders(spark, sf_dir), exact_scale=EXACT), base, RUN_ID, "descriptive")
    return read_report(spark, base, RUN_ID, "descriptive")


QUERIES = {
    "src_csv": _events_through("csv"),
    "src_csv_staged": _staged_csv,
    "sink_published": _published,
    "src_json": _events_through("json"),
    "src_text": _names_as_text,
    "profile_text": _text_profile,
    "analyze_csv": _analyze_csv,
    "analyze_text": _analyze_text,
    "profile_bad_json": _bad_json,
    "sink_roundtrip": _report_round_trip,
}

def limits(column: str, kind: str) -> str:
    """SQL for the range of a numeric column, null for others."""
    lo, hi = (f"min({column})", f"max({column})") if kind in NUMERIC else ("NULL", "NULL")
    return f"{lo}::DOUBLE AS min, {hi}::DOUBLE AS max"


ORACLES = {
    "src_csv_staged":
        "SELECT event_id::INT AS event_id, ts, user_id::INT AS user_id, event_type, value, props FROM events",
    "sink_published": f"""
        SELECT '{RUN_ID}' AS run_id, 'descriptive' AS kind, "column", rows, null_count, distinct_count,
               true AS half_is_absent
        FROM ({PROFILE_ORACLES['profile_columns']})""",
    "src_csv": "SELECT event_id::INT AS event_id, ts, user_id::INT AS user_id, event_type, value, props FROM events",
    "src_json": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "src_text": "SELECT c_name AS value FROM customer",
    "profile_text": """
        SELECT 'text' AS file_type, count(*) AS rows, 1 AS cols, 'value' AS "column", 'string' AS type,
               count(*) - count(c_name) AS null_count, count(DISTINCT c_name) AS distinct_count
        FROM customer""",
    "analyze_csv": " UNION ALL ".join(
        f"SELECT 'descriptive' AS report, '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) AS distinct_count, {limits(c, kind)}, NULL::BOOLEAN AS skipped, "
        f"NULL::VARCHAR AS reason_code FROM orders" for c, kind in ORDERS_TYPES.items()) + """
        UNION ALL SELECT 'ml', job, NULL, NULL, NULL, NULL, NULL, false, NULL
        FROM (VALUES ('regression'), ('classification'), ('clustering')) AS jobs(job)
        UNION ALL SELECT 'ml', 'timeSeries', sum(n), NULL, count(*), min(lo), max(hi), false, NULL
        FROM (SELECT count(*) AS n, min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi FROM orders
              GROUP BY o_orderdate::DATE ORDER BY o_orderdate::DATE LIMIT 10)""",
    "analyze_text": """
        SELECT 'descriptive' AS report, 'value' AS name, count(*) AS rows, count(*) - count(c_name) AS null_count,
               count(DISTINCT c_name) AS distinct_count, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
               NULL::BOOLEAN AS skipped, NULL::VARCHAR AS reason_code FROM customer
        UNION ALL SELECT 'ml', job, NULL, NULL, NULL, NULL, NULL, true, 'TEXT_INPUT'
        FROM (VALUES ('regression'), ('classification'), ('clustering'), ('timeSeries')) AS jobs(job)""",
    "profile_bad_json": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) + 1 AS rows, count(*) - count({c}) + 1 AS null_count, "
        f"count(DISTINCT {c}) + 1 AS distinct_count FROM events" for c in ("event_id", "user_id", "value")) + """
        UNION ALL SELECT '_corrupt_record', count(*) + 1, count(*), 2 FROM events""",
    "sink_roundtrip": f"SELECT *, '{RUN_ID}' AS run_id FROM ({PROFILE_ORACLES['profile_columns']})",
}
