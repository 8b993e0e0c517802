"""Turn a date-like column of any supported type into a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import quoted

# The formats tried, in this order, after Spark's own ISO-like parsing.
FALLBACK_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy"]

DATE_LIKE = (T.DateType, T.TimestampType, T.TimestampNTZType)


def parse_timestamp(df: DataFrame, name: str) -> Column:
    """Timestamps pass through, dates are cast, strings are parsed with the first format that fits, else null."""
    data_type = df.schema[name].dataType
    column = quoted(name)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return column
    if isinstance(data_type, T.DateType):
        return column.cast("timestamp")
    if isinstance(data_type, T.StringType):
        # a failed parse is dear, so a format is only tried on text that has its separator
        attempts = [F.when(column.contains("/" if "/" in fmt else "-"), F.try_to_timestamp(column, F.lit(fmt)))
                    for fmt in FALLBACK_FORMATS]
        return F.coalesce(F.try_to_timestamp(column), *attempts)
    raise TypeError(f"column {name!r} of type {data_type.simpleString()} holds no dates")
