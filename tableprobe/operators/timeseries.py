"""Daily aggregation of one value column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import mean, present, quoted, total
from tableprobe.functions.timestamps import parse_timestamp
from tableprobe.operators.roles import date_column, value_column

FIRST_DAYS = 10


def dated_values(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """(day, value) of the rows that have a date and a value; the day is null where the date cannot be read."""
    rows = df.where(quoted(date_col).isNotNull()).where(present(value_col, df.schema[value_col].dataType))
    return rows.select(F.to_date(parse_timestamp(df, date_col)).alias("day"), quoted(value_col).alias("value"))


def daily_stats(df: DataFrame, date_col: str | None = None, value_col: str | None = None,
                exact_scale: int | None = None) -> DataFrame:
    """Per calendar day: count, mean, min, max and sum of the value column.

    Columns not named are guessed. The group-by combines on the map side, so each task ships one row per day it
    has seen however many rows fall on that day. Sums are doubles, or exact decimals with ``exact_scale``.
    """
    date_col = date_col or date_column(df)
    value_col = value_col or value_column(df)
    if date_col is None or value_col is None:
        raise ValueError("the table has no date column or no numeric column")
    value_type = df.schema[value_col].dataType
    days = dated_values(df, date_col, value_col).groupBy("day").agg(
        F.count("day").alias("count"),
        F.expr(mean("value", value_type, exact_scale)).alias("mean_value"),
        F.min("value").cast(T.DoubleType()).alias("min_value"),
        F.max("value").cast(T.DoubleType()).alias("max_value"),
        F.expr(total("value", value_type, exact_scale)).alias("sum_value"),
    )
    # Unreadable dates go by their count, after the group-by: a test of the day itself would be pushed below it
    # and parse every date twice.
    return days.where(F.col("count") > 0)


def first_days(daily: DataFrame, n: int = FIRST_DAYS) -> DataFrame:
    """The first ``n`` days in order."""
    return daily.orderBy("day").limit(n)
