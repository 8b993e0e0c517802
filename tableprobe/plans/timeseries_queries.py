"""Daily aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.operators.timeseries import daily_stats, first_days
from tableprobe.plans.tables import EXACT, table


def _daily_events(spark, sf_dir):
    return daily_stats(table(spark, sf_dir, "events"), "ts", "value", EXACT)


def _mixed_dates(spark, sf_dir):
    """Orders with the date as text, in a format that goes by the priority; one priority gets no date at all."""
    date, priority = F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    text = (F.when(priority == "1", F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
            .when(priority == "2", F.date_format(date, "yyyy-MM-dd"))
            .when(priority == "3", F.date_format(date, "yyyy/MM/dd"))
            .when(priority == "4", F.date_format(date, "dd/MM/yyyy"))
            .otherwise("unknown"))
    return table(spark, sf_dir, "orders").select(text.alias("order_date"), "o_totalprice")


def _daily_sql(table_name: str, date: str, value: str) -> str:
    exact = f"sum({value}::DECIMAL(18,2))::DOUBLE"
    return f"""
        SELECT CAST({date} AS DATE) AS day, count(*) AS count, {exact} / count(*) AS mean_value,
               min({value})::DOUBLE AS min_value, max({value})::DOUBLE AS max_value, {exact} AS sum_value
        FROM {table_name} WHERE {date} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1"""


QUERIES = {
    "ts_daily_events": _daily_events,
    "ts_daily_orders": lambda spark, d: daily_stats(
        table(spark, d, "orders"), value_col="o_totalprice", exact_scale=EXACT),
    "ts_daily_lineitem": lambda spark, d: daily_stats(
        table(spark, d, "lineitem"), value_col="l_extendedprice", exact_scale=EXACT),
    "ts_daily_auto": lambda spark, d: daily_stats(table(spark, d, "orders")),
    "ts_first10": lambda spark, d: first_days(_daily_events(spark, d)),
    "ts_mixed_formats": lambda spark, d: daily_stats(_mixed_dates(spark, d), exact_scale=EXACT),
}

ORACLES = {
    "ts_daily_events": _daily_sql("events", "ts", "value"),
    "ts_daily_orders": _daily_sql("orders", "o_orderdate", "o_totalprice"),
    "ts_daily_lineitem": _daily_sql("lineitem", "l_shipdate", "l_extendedprice"),
    "ts_daily_auto": """
        SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS count,
               sum(o_orderkey)::DOUBLE / count(*) AS mean_value, min(o_orderkey)::DOUBLE AS min_value,
               max(o_orderkey)::DOUBLE AS max_value, sum(o_orderkey)::DOUBLE AS sum_value
        FROM orders GROUP BY 1""",
    "ts_first10": _daily_sql("events", "ts", "value") + " ORDER BY day LIMIT 10",
    "ts_mixed_formats": """
        WITH texts AS (
            SELECT CASE substr(o_orderpriority, 1, 1)
                       WHEN '1' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                       WHEN '2' THEN strftime(o_orderdate, '%Y-%m-%d')
                       WHEN '3' THEN strftime(o_orderdate, '%Y/%m/%d')
                       WHEN '4' THEN strftime(o_orderdate, '%d/%m/%Y')
                       ELSE 'unknown' END AS order_date,
                   o_totalprice AS value
            FROM orders),
        days AS (
            SELECT CAST(coalesce(try_strptime(order_date, '%Y-%m-%d %H:%M:%S'), try_strptime(order_date, '%Y-%m-%d'),
                                 try_strptime(order_date, '%Y/%m/%d'), try_strptime(order_date, '%d/%m/%Y')) AS DATE)
                       AS day, value
            FROM texts)
        SELECT day, count(*) AS count, sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS mean_value,
               min(value) AS min_value, max(value) AS max_value, sum(value::DECIMAL(18,2))::DOUBLE AS sum_value
        FROM days WHERE day IS NOT NULL GROUP BY day""",
}
