"""Dataset profile: size, types, null counts, distinct counts and numeric ranges.

Nulls and ranges of all columns come from one global aggregate over one scan. Distinct counts come from a
scan per column type, in long form; see `stacked`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import (
    canonical, identifier, is_groupable, is_numeric, mean, present, quoted, ratio)

COLUMNS_PER_AGGREGATE = 24  # one aggregate of very many measures takes long to plan and is not compiled

PROFILE_SCHEMA = T.StructType([
    T.StructField("file_type", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("cols", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("missing_percent", T.DoubleType()),
    T.StructField("distinct_count", T.LongType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
])


def overview(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: position, name and Spark type."""
    rows = [(pos, f.name, f.dataType.simpleString()) for pos, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "pos int, column string, type string")


def _stats(df: DataFrame, fields: list[T.StructField], nulls: bool, numbers: bool,
           exact_scale: int | None) -> DataFrame:
    """One row per field. Columnar files are read once, whatever the width: each aggregate scans its own columns."""
    size = COLUMNS_PER_AGGREGATE
    parts = [_stats_of(df, fields[at:at + size], at, nulls, numbers, exact_scale)
             for at in range(0, max(1, len(fields)), size)]
    return reduce(DataFrame.unionByName, parts)


def _stats_of(df: DataFrame, fields: list[T.StructField], first: int, nulls: bool, numbers: bool,
              exact_scale: int | None) -> DataFrame:
    """One row per field, from a single one-row aggregate over one scan that is then turned on its side.

    Positions count from ``first``.
    """
    names = ["present"] * nulls + ["min", "max", "mean"] * numbers
    if not fields:
        empty = T.StructType([T.StructField("rows", T.LongType()), T.StructField("column", T.StringType())])
        return df.sparkSession.createDataFrame([], empty).selectExpr("*", *[f"double(null) AS {n}" for n in names])
    measures, cells = ["count(1) AS rows"], []
    for pos, field in enumerate(fields):
        column = identifier(field.name)
        cells.append(f"{pos}")
        if nulls:
            # count(c) rather than a test for null: it is what file formats can answer from their footers
            measures.append(f"count({column}) AS n{pos}")
            cells.append(f"n{pos}")
        if numbers and is_numeric(field.dataType):
            average = mean(field.name, field.dataType, exact_scale)
            measures += [f"double(min({column})) AS lo{pos}", f"double(max({column})) AS hi{pos}",
                         f"{average if exact_scale is not None else f'round({average}, 6)'} AS avg{pos}"]
            cells += [f"lo{pos}", f"hi{pos}", f"avg{pos}"]
        elif numbers:
            cells += ["double(null)"] * 3
    wide = df.selectExpr(*measures)
    stats = wide.selectExpr("rows", f"stack({len(fields)}, {', '.join(cells)}) AS ({', '.join(['pos'] + names)})")
    return stats.select("rows", (F.col("pos") + first).alias("pos"), _at([f.name for f in fields]).alias("column"),
                        _at([f.dataType.simpleString() for f in fields]).alias("type"), *names)


def _at(values: list) -> Column:
    """The element of ``values`` that ``pos`` points to."""
    return F.element_at(F.lit(values), F.col("pos") + 1)


def _null_columns() -> list[Column]:
    null_count = F.col("rows") - F.col("present")
    return [null_count.alias("null_count"),
            F.round(ratio(null_count * 100.0, F.col("rows")), 4).alias("missing_percent")]


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and the share of nulls in percent (0 for an empty table)."""
    stats = _stats(df, df.schema.fields, nulls=True, numbers=False, exact_scale=None)
    return stats.select("column", "rows", *_null_columns())


def numeric_profile(df: DataFrame, columns: list[str] | None = None,
                    exact_scale: int | None = None) -> DataFrame:
    """One row per numeric column: min, max and mean, all null when the column holds no value.

    The mean is rounded to 6 decimals, or left unrounded but independent of row order when ``exact_scale`` names
    the number of decimals the data has.
    """
    fields = [f for f in df.schema.fields if is_numeric(f.dataType) and (columns is None or f.name in columns)]
    return _stats(df, fields, nulls=False, numbers=True, exact_scale=exact_scale).select("column", "min", "max", "mean")


SHORT = 32  # bytes of a digest; shorter texts travel as they are


def _family(data_type: T.DataType) -> str:
    """The type under which values are compared: whole numbers and days are one, all of no fixed width another."""
    if isinstance(data_type, (T.IntegralType, T.DateType)):
        return "bigint"
    if isinstance(data_type, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.NullType)):
        return "binary"
    return data_type.simpleString()


def key(field: T.StructField) -> str:
    """The value as it travels. Strings and binaries of 32 bytes and more, and nested values, go as the SHA-256 of a
    canonical text, shorter ones as their bytes, which no digest can equal."""
    column, kind = identifier(field.name), field.dataType
    if isinstance(kind, T.NullType):
        return "cast(null AS binary)"
    if isinstance(kind, T.DateType):
        return f"cast(unix_date({column}) AS bigint)"
    if _family(kind) != "binary":
        return f"cast({column} AS {_family(kind)})"
    digest = f"unhex(sha2({canonical(column, kind)}, 256))"
    plain = isinstance(kind, T.BinaryType) or isinstance(kind, T.StringType) and kind.isUTF8BinaryCollation()
    short = f"WHEN octet_length({column}) < {SHORT} THEN cast({column} AS binary) " if plain else ""
    return f"CASE {short}WHEN {column} IS NOT NULL THEN {digest} END"


def stacked(df: DataFrame, fields: list[T.StructField]) -> list[tuple[str, DataFrame]]:
    """All values of all fields as (pos, value), pos counting through ``fields``: one frame per family of types.

    Rows are two cells wide however many columns the table has, equal values are those that Spark counts as one, and
    each frame scans only its columns. Long strings and nested values go as digests, so that their shuffle is
    as large as their number, not their length; that two of them are told apart rests on SHA-256.
    """
    families: dict[str, list[tuple[int, T.StructField]]] = {}
    for pos, field in enumerate(fields):
        families.setdefault(_family(field.dataType), []).append((pos, field))
    corrupt = df.sparkSession.conf.get("spark.sql.columnNameOfCorruptRecord")
    frames = []
    for family, members in families.items():
        cells = [f"{pos}, {key(field)}" for pos, field in members]
        other = next((c for c in df.columns if c != corrupt), None)
        if [field.name for _, field in members] == [corrupt] and other:
            # Spark doesn't read that column alone: a row of no field's takes in another one
            cells.append(f"-1, CASE WHEN {identifier(other)} IS NULL THEN unhex('') END")
        frame = df.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (pos, value)")
        frames.append((family, frame.where("pos >= 0") if len(cells) > len(members) else frame))
    return frames


def bitmaps(values: DataFrame) -> DataFrame:
    """(pos, word, bits) of whole numbers: 64 neighbours share a word, and a word's bits say which of them occur.

    What leaves a task is one row per word, so it grows with the range of the values, not with their number. Values
    that lie far apart have a word each, which is no more rows than the values themselves. Nulls make a word of null.
    """
    word = F.shiftright("value", 6).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("value").bitwiseAND(F.lit(63)).cast("int"))
    return values.groupBy("pos", word).agg(F.bit_or(bit).alias("bits"))


def exact_counts(df: DataFrame, fields: list[T.StructField], count_missing: bool = True) -> DataFrame:
    """(pos, distinct_count) of the fields that have a value; null and NaN count as values, or not at all.

    Duplicates go on the map side, so a value that fills a third of the table leaves a task as one row, and the
    remaining values are spread by position and value.
    """
    counts = []
    for family, values in stacked(df, fields):
        if not count_missing:
            values = values.where(present("value", values.schema["value"].dataType))
        if family == "bigint":
            number = F.sum(F.coalesce(F.bit_count("bits"), F.lit(1)))
            counts.append(bitmaps(values).groupBy("pos").agg(number.cast("bigint").alias("distinct_count")))
        else:
            counts.append(values.distinct().groupBy("pos").agg(F.count(F.lit(1)).alias("distinct_count")))
    return reduce(DataFrame.unionByName, counts)


def sketched_counts(df: DataFrame, fields: list[T.StructField], rsd: float) -> DataFrame:
    """(pos, distinct_count) estimated, null counting as a value: a task ships one sketch per field, no values."""
    has_null = F.max(F.col("value").isNull().cast("bigint"))
    estimate = F.approx_count_distinct("value", rsd) + has_null
    counts = [values.groupBy("pos").agg(estimate.alias("distinct_count")) for _, values in stacked(df, fields)]
    return reduce(DataFrame.unionByName, counts)


def _distinct_counts(df: DataFrame, rsd: float | None) -> DataFrame:
    """(pos, distinct_count) of every column of the table; null where the type cannot be compared."""
    comparable = [(pos, f) for pos, f in enumerate(df.schema.fields) if is_groupable(f.dataType)]
    positions = df.sparkSession.range(0, len(df.columns), 1, 1).select(F.col("id").cast("int").alias("pos"))
    if not comparable:
        return positions.withColumn("distinct_count", F.lit(None).cast("bigint"))
    fields = [f for _, f in comparable]
    counts = exact_counts(df, fields) if rsd is None else sketched_counts(df, fields, rsd)
    places = [pos for pos, _ in comparable]
    counts = counts.select(_at(places).alias("pos"), "distinct_count")
    known = F.array_contains(F.lit(places), F.col("pos"))
    # at most one row per column of the table on either side, so the broadcast is bounded by the schema
    return positions.join(F.broadcast(counts), "pos", "left").select(
        "pos", F.when(known, F.coalesce("distinct_count", F.lit(0))).alias("distinct_count"))


def distinct_profile(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """One row per column: distinct values, null counting as one and NaN as one; null for maps.

    Exact by default. ``rsd`` asks for a sketch of that relative error instead, which shuffles no values.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, distinct_count bigint")
    return _distinct_counts(df, rsd).select(_at(df.columns).alias("column"), "distinct_count")


def describe(df: DataFrame, file_type: str = "csv", exact_scale: int | None = None,
             rsd: float | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The whole profile, one row per column, in `PROFILE_SCHEMA`. ``stats`` are those of a scan taken already."""
    fields = df.schema.fields
    if not fields:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    if stats is None:
        stats = _stats(df, fields, nulls=True, numbers=True, exact_scale=exact_scale)
    distinct = _distinct_counts(df, rsd)
    # both sides hold one row per column of the table
    joined = stats.join(F.broadcast(distinct), "pos", "left")
    return joined.select(
        F.lit((file_type or "").strip().lower()).alias("file_type"), "rows", F.lit(len(fields)).alias("cols"),
        "pos", "column", "type", *_null_columns(), "distinct_count", "min", "max", "mean")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of one column, null included."""
    return df.select(quoted(column)).distinct()
