"""Guess what each column is for: numeric, label, date, value.

The rules read the schema and the cardinalities only, and are ordered: ties keep the order of the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import canonical, identifier, is_groupable, is_numeric, present
from tableprobe.functions.timestamps import DATE_LIKE

# A label has this many distinct values, and a date column is called something like this.
MIN_LABEL_VALUES = 2
MAX_LABEL_VALUES = 20
DATE_WORDS = ["date", "time", "timestamp"]

SMALLEST_SET, LARGEST_SET = 4, 26  # powers of two that Spark's sets of hashes may hold


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order, decimals included."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def date_column(df: DataFrame) -> str | None:
    """First date-like or string column named after a date or time, else first column of a date-like type."""
    fields = df.schema.fields
    for field in fields:
        named = any(word in field.name.lower() for word in DATE_WORDS)
        if named and isinstance(field.dataType, (*DATE_LIKE, T.StringType)):
            return field.name
    return next((f.name for f in fields if isinstance(f.dataType, DATE_LIKE)), None)


def value_column(df: DataFrame) -> str | None:
    """First numeric column."""
    return next(iter(numeric_columns(df)), None)


def regression_label(df: DataFrame) -> str | None:
    """Last numeric column; the numeric columns before it are the features."""
    return next(reversed(numeric_columns(df)), None)


def _hash(field: T.StructField) -> str:
    """64 bits of a value, equal for values that Spark counts as one; Spark's hash of a nested value skips its nulls."""
    column, kind = identifier(field.name), field.dataType
    plain = not isinstance(kind, (T.ArrayType, T.StructType)) and not (
        isinstance(kind, T.StringType) and not kind.isUTF8BinaryCollation())
    return f"xxhash64({column if plain else canonical(column, kind)})"


def bounded_counts(df: DataFrame, high: int) -> DataFrame:
    """(pos, column, distinct_count) of the columns that can be compared, null and NaN not counted, in one scan.

    Counts up to ``high`` are exact; those beyond are estimates that are larger than ``high``. The state of a column is
    a set of at most a few times ``high`` hashes (a theta sketch that isn't full yet), so a task ships one small row,
    whatever the data. That two values are told apart rests on 64 bits.
    """
    fields = [(pos, f) for pos, f in enumerate(df.schema.fields) if is_groupable(f.dataType)]
    size = max(SMALLEST_SET, high.bit_length())
    if size > LARGEST_SET:
        raise ValueError(f"counts of up to {high} values need exact_counts")
    if not fields:
        return df.sparkSession.createDataFrame([], "pos int, column string, distinct_count bigint")
    sets = df.selectExpr(*[
        f"theta_sketch_agg(CASE WHEN {present(f.name, f.dataType)} THEN {_hash(f)} END, {size}) AS s{pos}"
        for pos, f in fields])
    cells = ", ".join(f"{pos}, coalesce(theta_sketch_estimate(s{pos}), 0L)" for pos, _ in fields)
    names = F.element_at(F.lit(df.columns), F.col("pos") + 1)
    return sets.selectExpr(f"stack({len(fields)}, {cells}) AS (pos, distinct_count)").select(
        "pos", names.alias("column"), "distinct_count")


def label_candidates(df: DataFrame, low: int = MIN_LABEL_VALUES, high: int = MAX_LABEL_VALUES) -> DataFrame:
    """Columns with ``low``..``high`` distinct values, null and NaN not counted, fewest first, from one scan."""
    return bounded_counts(df, high).where(F.col("distinct_count").between(low, high)).select(
        "column", "distinct_count", "pos").orderBy("distinct_count", "pos")


def choose_label(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate that is not numeric, else the first; nested and binary columns cannot be labels."""
    types = {f.name: f.dataType for f in df.schema.fields}
    nested = (T.ArrayType, T.StructType, T.MapType, T.BinaryType)
    usable = [c for c in candidates if not isinstance(types[c], nested)]
    return next((c for c in usable if not is_numeric(types[c])), next(iter(usable), None))


def classification_roles(df: DataFrame) -> tuple[list[str], str | None]:
    """All numeric columns but the label as features, and the label."""
    candidates = [row["column"] for row in label_candidates(df).collect()]
    label = choose_label(df, candidates)
    return [c for c in numeric_columns(df) if c != label], label
