"""Profiles that grow with a table: the state of a set of files is kept, merged with others, and read as a profile.

A state is two tables. ``ranges`` has a row per column: counts, least and largest value, and sums that can be added.
``members`` has the distinct values: words of 64 neighbours for whole numbers and days, bytes or digests for all else.
Both are aggregates, so a state merged of parts is that of the whole, and new files cost a scan of these files only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import canonical, identifier, is_floating, is_groupable, is_numeric
from tableprobe.operators import profile

RANGES_SCHEMA = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("comparable", T.BooleanType()),
    T.StructField("cols", T.IntegerType()),
    T.StructField("rows", T.LongType()),
    T.StructField("present", T.LongType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("scale", T.IntegerType()),
    T.StructField("units", T.DecimalType(38, 0)),
    T.StructField("rest", T.DoubleType()),
])
MEMBERS_SCHEMA = "pos int, word bigint, value binary, bits bigint"


@dataclass(frozen=True)
class ProfileState:
    """What is known of some files, as two tables; see `RANGES_SCHEMA` and `MEMBERS_SCHEMA`."""

    ranges: DataFrame
    members: DataFrame


def _sums(field: T.StructField, exact_scale: int | None) -> tuple[int | None, str, str]:
    """(scale, SQL of the sum of whole units of 10^-scale, SQL of the sum as double of what is no such unit)."""
    column, kind = identifier(field.name), field.dataType
    if not is_numeric(kind):
        return None, "cast(null AS decimal(38, 0))", "double(null)"
    if exact_scale is None:
        return None, "cast(null AS decimal(38, 0))", f"sum(double({column}))"
    if isinstance(kind, T.DecimalType):
        unscaled = f"cast({column} * cast(1{'0' * kind.scale} AS decimal({kind.scale + 1}, 0)) AS decimal(38, 0))"
        return kind.scale, f"cast(sum({unscaled}) AS decimal(38, 0))", "double(null)"
    if not is_floating(kind):
        return 0, f"cast(sum(cast(bigint({column}) AS decimal(19, 0))) AS decimal(38, 0))", "double(null)"
    fits = f"abs(double({column}) * {10 ** exact_scale}D) < 9.2e18D"
    units = f"cast(bigint(rint(double({column}) * {10 ** exact_scale}D)) AS decimal(19, 0))"
    return (exact_scale, f"cast(sum(CASE WHEN {fits} THEN {units} END) AS decimal(38, 0))",
            f"sum(CASE WHEN NOT {fits} THEN double({column}) END)")


def _ranges(df: DataFrame, exact_scale: int | None) -> DataFrame:
    """One row per column, from one scan of columnar files and one row per task."""
    parts, size = [], profile.COLUMNS_PER_AGGREGATE
    fields = list(enumerate(df.schema.fields))
    for start in range(0, len(fields), size):
        measures, cells = ["count(1) AS rows"], []
        for pos, field in fields[start:start + size]:
            column = identifier(field.name)
            scale, units, rest = _sums(field, exact_scale)
            ends = [f"double(min({column}))", f"double(max({column}))"] if is_numeric(field.dataType) else [
                "double(null)"] * 2
            measures += [f"count({column}) AS n{pos}", f"{ends[0]} AS lo{pos}", f"{ends[1]} AS hi{pos}",
                         f"{units} AS u{pos}", f"{rest} AS r{pos}"]
            cells.append(f"{pos}, n{pos}, lo{pos}, hi{pos}, int({'null' if scale is None else scale}), u{pos}, r{pos}")
        turned = df.selectExpr(*measures).selectExpr(
            "rows", f"stack({len(cells)}, {', '.join(cells)}) AS (pos, present, min, max, scale, units, rest)")
        parts.append(turned)
    if not parts:
        return df.sparkSession.createDataFrame([], RANGES_SCHEMA)

    def at(values: list) -> Column:
        return F.element_at(F.lit(values), F.col("pos") + 1)

    types = [f.dataType for f in df.schema.fields]
    named = reduce(DataFrame.unionByName, parts).select(
        "*", F.lit(len(fields)).alias("cols"), at(df.columns).alias("column"), at([t.simpleString() for t in types]).alias("type"),
        at([is_groupable(t) for t in types]).alias("comparable"))
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RANGES_SCHEMA.fields])


def _members(df: DataFrame) -> DataFrame:
    """The distinct values of all columns that can be compared, nulls left out: the ranges count those."""
    places = [pos for pos, f in enumerate(df.schema.fields) if is_groupable(f.dataType)]
    fields = [df.schema.fields[pos] for pos in places]
    frames = [df.sparkSession.createDataFrame([], MEMBERS_SCHEMA)]
    for family, values in profile.stacked(df, fields) if fields else []:
        values = values.where("value IS NOT NULL")
        if family == "bigint":
            found = profile.bitmaps(values).select("pos", "word", F.lit(None).cast("binary").alias("value"), "bits")
        else:
            data_type = values.schema["value"].dataType
            text = "value" if family == "binary" else f"cast({canonical('value', data_type)} AS binary)"
            found = values.distinct().select("pos", F.lit(None).cast("bigint").alias("word"), F.expr(text).alias("value"),
                                             F.lit(None).cast("bigint").alias("bits"))
        frames.append(found.withColumn("pos", F.element_at(F.lit(places), F.col("pos") + 1)))
    return reduce(DataFrame.unionByName, frames)


def profile_state(df: DataFrame, exact_scale: int | None = None) -> ProfileState:
    """The state of a table. ``exact_scale`` makes sums independent of order and of how the table was cut."""
    return ProfileState(_ranges(df, exact_scale), _members(df))


def merge_states(states: list[ProfileState]) -> ProfileState:
    """The state of all the tables together. Their columns have to agree, which `check_ranges` tells.

    Words are or-ed and values made distinct on the map side first.
    """
    ranges = reduce(DataFrame.unionByName, [s.ranges for s in states])
    members = reduce(DataFrame.unionByName, [s.members for s in states])
    sums = [F.sum(c).alias(c) for c in ("rows", "present")]
    merged = ranges.groupBy("pos", "column", "type", "comparable", "cols", "scale").agg(
        *sums, F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("units").cast("decimal(38, 0)").alias("units"), F.sum("rest").alias("rest"))
    return ProfileState(
        merged.select(*RANGES_SCHEMA.fieldNames()),
        members.groupBy("pos", "word", "value").agg(F.bit_or("bits").alias("bits")))


def check_ranges(ranges: DataFrame) -> None:
    """Refuse states whose columns differ in number, name, type or scale: their sums would not be of one column."""
    shapes = ranges.groupBy("pos").agg(
        F.count_distinct(F.struct("column", "type", "cols", F.coalesce("scale", F.lit(-1)))).alias("kinds"),
        F.count(F.lit(1)).alias("parts"))
    odd = shapes.agg(F.max("kinds").alias("kinds"), F.min("parts").alias("least"), F.max("parts").alias("most")).first()
    if (odd["kinds"] or 1) > 1 or odd["least"] != odd["most"]:
        raise ValueError("the states are of tables with different columns")


def state_profile(state: ProfileState, file_type: str = "csv") -> DataFrame:
    """The profile a state amounts to, in `PROFILE_SCHEMA`: what `describe` gives for the whole table."""
    ranges, scale = state.ranges, F.coalesce("scale", F.lit(0))
    counts = state.members.groupBy("pos").agg(
        F.sum(F.coalesce(F.bit_count("bits").cast("bigint"), F.lit(1))).alias("found"))
    # one row per column of the table
    joined = ranges.join(F.broadcast(counts), "pos", "left")
    null_count = F.col("rows") - F.col("present")
    power = F.lit(None).cast("decimal(19, 0)")
    for digits in range(19):
        power = F.when(scale == digits, F.lit(10 ** digits).cast("decimal(19, 0)")).otherwise(power)
    exact = F.coalesce((F.col("units") / power).cast("double"), F.lit(0.0)) + F.coalesce("rest", F.lit(0.0))
    mean = F.when(F.col("scale").isNotNull(), exact / F.col("present")).otherwise(
        F.round(F.col("rest") / F.col("present"), 6))
    distinct = F.coalesce("found", F.lit(0)) + (null_count > 0).cast("bigint")
    values = {
        "file_type": F.lit((file_type or "").strip().lower()), "null_count": null_count,
        "missing_percent": F.round(F.when(F.col("rows") > 0, null_count * 100.0 / F.col("rows")).otherwise(0.0), 4),
        "distinct_count": F.when(F.col("comparable"), distinct),
        "mean": F.when((F.col("present") > 0) & F.col("min").isNotNull(), mean)}
    return joined.select(*[
        values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in profile.PROFILE_SCHEMA.fields])


def add_state(base: str, part: str, state: ProfileState) -> None:
    """Keep a state under ``base`` as a part of that name. A part counts once its ranges are written, which is last."""
    state.members.write.mode("overwrite").parquet(f"{base.rstrip('/')}/members/part={part}")
    state.ranges.write.mode("errorifexists").parquet(f"{base.rstrip('/')}/ranges/part={part}")


def read_state(spark: SparkSession, base: str) -> ProfileState:
    """The state of all parts kept under ``base``; raises if there is none, or if their columns differ."""
    def kept(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{name}")

    try:
        ranges = kept("ranges", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RANGES_SCHEMA) + ", part string")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"no state is kept under {base!r}") from None
        raise
    check_ranges(ranges)
    members = kept("members", MEMBERS_SCHEMA + ", part string")
    whole = members.join(F.broadcast(ranges.select("part").distinct()), "part", "left_semi")
    return merge_states([ProfileState(ranges.drop("part"), whole.drop("part"))])


def profile_increment(spark: SparkSession, base: str, part: str, df: DataFrame, file_type: str = "csv",
                      exact_scale: int | None = None) -> DataFrame:
    """Add a table to what is kept under ``base`` and return the profile of all of it. Only ``df`` is scanned."""
    add_state(base, part, profile_state(df, exact_scale))
    return state_profile(read_state(spark, base), file_type)
