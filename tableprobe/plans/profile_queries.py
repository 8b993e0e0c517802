"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.functions.columns import drop_missing
from tableprobe.operators import increments, profile
from tableprobe.plans.tables import (
    EXACT, GAPPED_ORDERS_SQL, LINEITEM_TYPES, NUMERIC, ORDERS_TYPES, exact_mean_sql, gapped_orders, table)
from tableprobe.sources.scratch import scratch_directory


def _unnested(columns: list[str], line: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {line.format(c=c)} FROM {source}" for c in columns)


def _distinct_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {source})) AS distinct_count"
        for c in columns)


def describe_sql(types: dict[str, str], source: str) -> str:
    """The full profile, one branch per column."""
    branches = []
    for pos, (c, kind) in enumerate(types.items()):
        numbers = (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {exact_mean_sql(c)} AS mean"
                   if kind in NUMERIC else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean")
        branches.append(
            f"SELECT 'csv' AS file_type, count(*) AS rows, {len(types)} AS cols, {pos} AS pos, '{c}' AS \"column\", "
            f"'{kind}' AS type, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 4)::DOUBLE AS missing_percent, "
            f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM {source})) AS distinct_count, {numbers} FROM {source}")
    return " UNION ALL ".join(branches)


def _schema_types(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return profile.describe(orders).select("pos", "column", "type", "rows")


def _cleaned_events(spark, sf_dir):
    gaps = table(spark, sf_dir, "events").select(
        "event_id", "ts",
        F.nullif(F.col("event_type"), F.lit("click")).alias("event_type"),
        F.when(F.col("value") < 20, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return drop_missing(gaps, ["event_type", "value"])


def _nonfinite(spark, sf_dir):
    """A NaN and an infinity among the prices must not end an exact profile, nor change other columns."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_extendedprice")).alias("with_nan"),
        F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_extendedprice")).alias("with_infinity"),
        F.col("l_extendedprice").alias("plain"))
    finite = F.abs(F.col("mean")) < float("inf")
    return profile.describe(lines, exact_scale=EXACT).select(
        "column", "null_count", "distinct_count", F.isnan("mean").alias("mean_is_nan"),
        (F.col("mean") == float("inf")).alias("mean_is_infinite"), F.when(finite, F.col("mean")).alias("finite_mean"))


def _keys(spark, sf_dir):
    """Whole numbers and days, some missing, whose distinct values are counted by words of neighbours."""
    line = table(spark, sf_dir, "lineitem")
    gap = F.col("l_linenumber") < 7
    return profile.distinct_profile(line.select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_day"),
        F.when(gap, F.col("l_partkey")).alias("l_partkey"), (F.col("l_suppkey") * -1000003).alias("far_apart"),
        F.when(gap, F.to_date("l_shipdate")).alias("gap_day")))


def _increment(spark, sf_dir):
    """Two parts of the lines are profiled apart, the first is kept, and the second added to it."""
    lines = table(spark, sf_dir, "lineitem")
    base = scratch_directory(spark)
    first = F.col("l_linenumber") <= 3
    increments.add_state(base, "first", increments.profile_state(lines.where(first), EXACT))
    return increments.profile_increment(spark, base, "second", lines.where(~first), exact_scale=EXACT)


QUERIES = {
    "profile_distinct_keys": _keys,
    "profile_increment": _increment,
    "profile_overview": lambda spark, d: profile.overview(table(spark, d, "orders")),
    "schema_types": _schema_types,
    "profile_nulls": lambda spark, d: profile.null_profile(gapped_orders(spark, d)),
    "profile_distinct": lambda spark, d: profile.distinct_profile(gapped_orders(spark, d)),
    "profile_distinct_texts": lambda spark, d: profile.distinct_profile(table(spark, d, "documents")),
    "profile_distinct_nested": lambda spark, d: profile.distinct_profile(table(spark, d, "embeddings")),
    "profile_numeric": lambda spark, d: profile.numeric_profile(gapped_orders(spark, d), exact_scale=EXACT),
    "profile_columns": lambda spark, d: profile.describe(gapped_orders(spark, d), exact_scale=EXACT),
    "profile_lineitem": lambda spark, d: profile.describe(table(spark, d, "lineitem"), exact_scale=EXACT),
    "profile_nonfinite": _nonfinite,
    "profile_means": lambda spark, d: profile.numeric_profile(
        table(spark, d, "lineitem"), ["l_linenumber", "l_partkey", "l_suppkey"]).select("column", "mean"),
    "distinct_values": lambda spark, d: profile.distinct_values(table(spark, d, "orders"), "o_orderpriority"),
    "dropna_subset": _cleaned_events,
}

_NUMERIC_ORDERS = [c for c, kind in ORDERS_TYPES.items() if kind in NUMERIC]

ORACLES = {
    "profile_increment": describe_sql(LINEITEM_TYPES, "lineitem"),
    "profile_distinct_keys": """
        WITH line AS (
            SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS ship_day, l_suppkey,
                   CASE WHEN l_linenumber < 7 THEN l_partkey END AS l_partkey,
                   CASE WHEN l_linenumber < 7 THEN l_shipdate::DATE END AS gap_day FROM lineitem)
        """ + " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", (SELECT count(*) FROM (SELECT DISTINCT {value} FROM line)) AS distinct_count"
        for name, value in (("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("ship_day", "ship_day"),
                            ("l_partkey", "l_partkey"), ("far_apart", "l_suppkey"), ("gap_day", "gap_day"))),
    "profile_overview": f"SELECT count(*) AS rows, {len(ORDERS_TYPES)} AS cols FROM orders",
    "schema_types": " UNION ALL ".join(
        f"SELECT {pos} AS pos, '{c}' AS \"column\", '{kind}' AS type, count(*) AS rows FROM orders"
        for pos, (c, kind) in enumerate(ORDERS_TYPES.items())),
    "profile_nulls": f"WITH {GAPPED_ORDERS_SQL} " + _unnested(
        list(ORDERS_TYPES),
        "'{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS null_count, "
        "round((count(*) - count({c})) * 100.0 / count(*), 4)::DOUBLE AS missing_percent", "gapped"),
    "profile_distinct": f"WITH {GAPPED_ORDERS_SQL} " + _distinct_sql(list(ORDERS_TYPES), "gapped"),
    "profile_distinct_texts": _distinct_sql(["doc_id", "text", "lang", "source", "n_chars"], "documents"),
    "profile_distinct_nested": _distinct_sql(["vec_id", "embedding", "label"], "embeddings"),
    "profile_numeric": f"WITH {GAPPED_ORDERS_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
        f"{exact_mean_sql(c)} AS mean FROM gapped" for c in _NUMERIC_ORDERS),
    "profile_columns": f"WITH {GAPPED_ORDERS_SQL} " + describe_sql(ORDERS_TYPES, "gapped"),
    "profile_lineitem": describe_sql(LINEITEM_TYPES, "lineitem"),
    "profile_nonfinite": f"""
        SELECT 'with_nan' AS "column", 0 AS null_count,
               count(DISTINCT CASE WHEN l_linenumber <> 7 THEN l_extendedprice END) + max((l_linenumber = 7)::INT)
                   AS distinct_count, max(l_linenumber) = 7 AS mean_is_nan, false AS mean_is_infinite,
               NULL::DOUBLE AS finite_mean FROM lineitem
        UNION ALL SELECT 'with_infinity', 0,
               count(DISTINCT CASE WHEN l_linenumber <> 7 THEN l_extendedprice END) + max((l_linenumber = 7)::INT),
               false, max(l_linenumber) = 7, NULL FROM lineitem
        UNION ALL SELECT 'plain', 0, count(DISTINCT l_extendedprice), false, false,
               {exact_mean_sql("l_extendedprice")} FROM lineitem""",
    "profile_means": _unnested(["l_linenumber", "l_partkey", "l_suppkey"],
                               "'{c}' AS \"column\", round(avg({c}), 6) AS mean", "lineitem"),
    "distinct_values": "SELECT DISTINCT o_orderpriority FROM orders",
    "dropna_subset": """
        SELECT event_id, ts, event_type, value FROM events
        WHERE nullif(event_type, 'click') IS NOT NULL AND NOT value < 20""",
}
