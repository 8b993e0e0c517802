"""Copy a dataset into Parquet while it is read for the first time, types included.

A CSV file says nothing about its types. Instead of reading it once to infer them and again to use them, its cells are
written as text, and on the way every column gathers which kinds of values it has seen. Kinds form a lattice (whole
numbers under decimals under doubles, days under timestamps, all under text), so what parts of the table have seen is
or-ed together. The copy is then read with casts to the types found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import quoted
from tableprobe.sources.datasets import OPTIONS, read_dataset

INT, LONG, DECIMAL, DOUBLE, DATE, TIMESTAMP, BOOLEAN, TEXT = (1 << i for i in range(8))

# Reader options that change neither which cells there are nor how their types are told apart.
PLAIN_OPTIONS = {"sep", "delimiter", "quote", "escape", "comment", "encoding", "charset", "multiline", "header",
                 "nullvalue", "emptyvalue", "linesep", "maxcolumns", "maxcharspercolumn", "compression",
                 "recursivefilelookup", "pathglobfilter", "modifiedbefore", "modifiedafter"}

# What Spark's inference reads as a number: Java's syntax of doubles, and its own names for infinities.
WHOLE = r"^[+-]?[0-9]+\.?$"
NUMBER = (r"^([\x00-\x20]*[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?|"
          r"0[xX]([0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+[fFdD]?)[\x00-\x20]*|-?Inf)$")
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _digits(cell: Column) -> Column:
    """How many digits a whole number has, leading zeros not counted."""
    return F.greatest(F.lit(1), F.length(F.regexp_replace(cell, r"^[+-]?0*|\.$", "")))


def kind_of(cell: Column) -> Column:
    """The least kind a cell of text fits, as a bit; 0 for null."""
    whole = (F.when(~cell.contains(".") & cell.try_cast("int").isNotNull(), INT)
             .when(~cell.contains(".") & cell.try_cast("bigint").isNotNull(), LONG)
             .when(_digits(cell) <= 38, DECIMAL).otherwise(DOUBLE))
    return (F.when(cell.isNull(), 0).when(cell.rlike(WHOLE), whole).when(cell.rlike(NUMBER), DOUBLE)
            .when(cell.rlike(DAY) & cell.try_cast("date").isNotNull(), DATE)
            .when(cell.rlike("[0-9]") & cell.try_cast("timestamp").isNotNull(), TIMESTAMP)
            .when(F.lower(cell).isin("true", "false"), BOOLEAN).otherwise(TEXT))


def type_of(kinds: int, digits: int) -> T.DataType:
    """The least type that all kinds seen fit; ``digits`` is the most of any whole number beyond 64 bits."""
    if kinds and kinds <= INT | LONG | DECIMAL | DOUBLE:
        if kinds & DOUBLE:
            return T.DoubleType()
        if kinds & DECIMAL:
            return T.DecimalType(max(digits, 20 if kinds & LONG else 10 if kinds & INT else 1), 0)
        return T.LongType() if kinds & LONG else T.IntegerType()
    if kinds and not kinds & ~(DATE | TIMESTAMP):
        return T.TimestampType() if kinds & TIMESTAMP else T.DateType()
    return T.BooleanType() if kinds == BOOLEAN else T.StringType()


def reads_in_one_pass(spark: SparkSession, file_type: str, options: dict) -> bool:
    """Whether `stage_dataset` finds the types on the way; else Spark infers them in a scan of its own."""
    names = {name.lower() for name in options}
    zoned = spark.conf.get("spark.sql.timestampType", "TIMESTAMP_LTZ") == "TIMESTAMP_LTZ"
    return file_type.strip().lower() == "csv" and names <= PLAIN_OPTIONS and zoned


def _session_like(spark: SparkSession) -> SparkSession:
    """Another session on the same context with the same settings.

    A session that has observed a query can't be serialised any more, and summaries of MLlib's models are shipped
    with theirs; so queries are observed in a session of their own.
    """
    other = spark.newSession()
    for row in spark.sql("SET").collect():
        if row["key"].startswith("spark.sql.") and spark.conf.isModifiable(row["key"]):
            other.conf.set(row["key"], row["value"])
    return other


def stage_dataset(spark: SparkSession, path: str | list[str], file_type: str, staging: str, **options) -> DataFrame:
    """The dataset at ``path``, copied to Parquet at ``staging``, which must not exist.

    CSV without a ``schema`` and with common options is read once; its columns have the types that Spark infers (the
    wider decimal where Spark's depends on the order of the rows). Other datasets are read as by `read_dataset`. A dataset without columns is returned uncopied.
    """
    if not reads_in_one_pass(spark, file_type, options):
        df = read_dataset(spark, path, file_type, **options)
        if not df.columns:
            return df
        df.write.mode("errorifexists").parquet(staging)
        return spark.read.parquet(staging)
    cells = read_dataset(_session_like(spark), path, "csv", **{**OPTIONS["csv"], **options, "inferSchema": False})
    names = cells.columns
    if not names:
        return read_dataset(spark, path, "csv", **options)
    seen = Observation()
    measures = [m for c in names for m in (
        F.bit_or(kind_of(quoted(c))), F.max(F.when(kind_of(quoted(c)) == DECIMAL, _digits(quoted(c)))))]
    watched = cells.observe(seen, *[m.alias(f"m{i}") for i, m in enumerate(measures)])
    watched.toDF(*[f"c{i}" for i in range(len(names))]).write.mode("errorifexists").parquet(staging)
    found = seen.get
    copy = spark.read.schema(", ".join(f"c{i} string" for i in range(len(names)))).parquet(staging)
    return copy.select(*[
        F.col(f"c{i}").cast(type_of(found[f"m{2 * i}"] or 0, found[f"m{2 * i + 1}"] or 0)).alias(name)
        for i, name in enumerate(names)])
