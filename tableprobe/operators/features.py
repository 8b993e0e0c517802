"""Feature vectors, label indexing and the train/test split."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableprobe.functions.columns import drop_missing, identifier, quoted
from tableprobe.sources.scratch import scratch_directory

TRAIN_PERCENT = 80
SPLIT_SEED = 42


def clean_columns(df: DataFrame, features: list[str], label: str | None = None,
                  label_type: str = "double", extra: list[str] | None = None) -> DataFrame:
    """Features as doubles ``f0, f1, ...``, the label as ``label_type``, without rows that miss any of them.

    The private names keep clear of input columns called ``features`` or ``label``, and of dotted names.
    ``extra`` columns come along unchanged as ``x0, x1, ...``; they may be null.
    """
    wanted = features + ([label] if label else [])
    columns = [f"double({identifier(c)}) AS f{i}" for i, c in enumerate(features)]
    if label:
        columns.append(f"cast({identifier(label)} AS {label_type}) AS label")
    columns += [f"{identifier(c)} AS x{i}" for i, c in enumerate(extra or [])]
    return drop_missing(df, list(dict.fromkeys(wanted))).selectExpr(*columns)


def assemble(clean: DataFrame, n_features: int) -> DataFrame:
    """Add the ``features`` vector over ``f0..``."""
    inputs = [f"f{i}" for i in range(n_features)]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(clean)


def prepare_features(df: DataFrame, features: list[str]) -> DataFrame:
    """The ``features`` vector of every row that misses none of ``features``."""
    return assemble(clean_columns(df, features), len(features)).select("features")


def label_counts(df: DataFrame, column: str = "label") -> DataFrame:
    """(label, rows) of the values of a column as strings, missing ones left out."""
    labels = drop_missing(df, [column]).select(quoted(column).cast("string").alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def label_indexer(clean: DataFrame, output: str = "label_index") -> StringIndexerModel:
    """Number the values of ``label``, most frequent first, ties in alphabetical order, however many there are."""
    return StringIndexer(inputCol="label", outputCol=output, handleInvalid="skip",
                         stringOrderType="frequencyDesc").fit(clean)


def label_index(df: DataFrame, column: str) -> DataFrame:
    """(label, label_index, rows) for every value of a label column, numbered like `label_indexer` does.

    The counts are sorted by range and written to the shared folder; a label's number is its place in its partition
    after the sizes of the partitions before. The driver sees no label.
    """
    spark = df.sparkSession
    directory = scratch_directory(spark)
    part = F.spark_partition_id()
    (label_counts(df, column).orderBy(F.desc("rows"), "label")
     .select("label", "rows", part.alias("part"),
             (F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)).alias("place"))
     .write.parquet(directory))
    placed = spark.read.schema("label string, rows bigint, part int, place bigint").parquet(directory)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row per partition of the sort
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select(
        "label", (F.col("start") + F.col("place")).cast("double").alias("label_index"), "rows")


FREQUENT = 1000  # labels that are broadcast; any other has less than a thousandth of the rows


def with_label_index(df: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """Add ``label_index`` to rows that hold a ``label``, from the ``classes`` rows that `label_index` gives.

    Labels are numbered by falling frequency, so the first thousand are all that can be hot. These are broadcast, and
    the others joined by key, if there are others.
    """
    numbers = labels.select("label", "label_index")
    if classes <= FREQUENT:
        return df.join(F.broadcast(numbers), "label")
    frequent = F.broadcast(numbers.where(F.col("label_index") < FREQUENT))
    rest = numbers.where(F.col("label_index") >= FREQUENT)
    joined = df.join(frequent, "label")
    rare = df.join(frequent.select("label"), "label", "left_anti").join(rest.hint("merge"), "label")
    return joined.unionByName(rare)


def hash_bucket(columns: list[Column], portable: bool = False) -> Column:
    """A number in 0..99 that depends on the values only, not on partitioning.

    ``portable`` takes it from an MD5 digest of the values as text, which other engines can reproduce; the
    default hash is several times cheaper.
    """
    if not portable:
        return F.pmod(F.xxhash64(*columns), F.lit(100))
    text = F.concat_ws("\u001f", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100


def split(df: DataFrame, keys: list[str] | None = None, method: str = "hash",
          train_percent: int = TRAIN_PERCENT, seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test rows.

    ``hash`` (or ``md5``, its portable form) sends a row by its key columns, by default all columns: the same
    split whatever the partitioning, after a lost executor too, and copies of a row stay on one side. Name an
    identifier as key where copies make up much of the table. ``random`` draws every row on its own, by seed,
    and is repeatable only while the partitioning is.
    """
    if method == "random":
        train, test = df.randomSplit([train_percent / 100, 1 - train_percent / 100], seed)
        return train, test
    if method not in ("hash", "md5"):
        raise ValueError(f"unknown split method: {method}")
    columns = [quoted(k) for k in (df.columns if keys is None else keys)]
    in_train = hash_bucket(columns, portable=method == "md5") < train_percent
    return df.where(in_train), df.where(~in_train)
