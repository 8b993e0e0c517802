"""Helpers the text operators share: tables written to the shared folder, per-row work on Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.sources.scratch import scratch_directory

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ROWS_PER_BATCH = 512  # rows an operator holds at once in Python, beside the batch it reads


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package from where the driver has it."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def staged(df: DataFrame, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost executor costs nothing.

    The schema is given to the reader, so an empty table reads as well.
    """
    spark = df.sparkSession
    path = path or scratch_directory(spark)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text as a string, empty where it is null."""
    return F.coalesce(quoted(column).cast("string"), F.lit(""))


def map_rows(df: DataFrame, function: Callable[[pa.Table], pa.Table | pa.RecordBatch], schema: str,
             rows: int = ROWS_PER_BATCH) -> DataFrame:
    """Apply a function to slices of a few hundred rows; it returns columns of the schema, any number of rows."""
    ship(df.sparkSession)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, rows):
                result = function(batch.slice(start, rows))
                if isinstance(result, pa.Table):
                    yield from result.to_batches()
                else:
                    yield result

    return df.mapInArrow(batches, schema)


BITS_PER_KEY = 16
SIEVE_BITS = 1 << 26  # a million words of 64 bits are broadcast at most, whatever the data


def sieve_size(keys: int) -> int:
    """Bits of a sieve for so many listed keys, a power of two: at 16 bits a key it passes 6 % of the others."""
    return min(SIEVE_BITS, max(1 << 16, 1 << (BITS_PER_KEY * max(1, keys) - 1).bit_length()))


def sieved(df: DataFrame, key: Column, listed: DataFrame, listed_key: Column) -> DataFrame:
    """Add ``_hit``: false only where the bigint ``key`` is surely not among ``listed_key`` of ``listed``.

    Rows that aren't listed are told apart without a shuffle, by one bit per remainder of the key; those that are hit
    need an exact join. The listed rows are counted, and the sieve grows with them up to a fixed size: it passes 6 % of
    foreign rows up to 4 million keys, 12 % at 8 million and 63 % at 67 million, and stays right.
    """
    bits = sieve_size(listed.count())

    def place(c: Column) -> tuple[Column, Column]:
        slot = c.bitwiseAND(F.lit(bits - 1))
        return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                                      slot.bitwiseAND(F.lit(63)).cast("int"))

    word, bit = place(listed_key)
    sieve = listed.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    word, bit = place(key)
    joined = df.withColumn("_word", word).join(F.broadcast(sieve), "_word", "left")
    return joined.withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop(
        "_word", "_bits")


HOT_SHARE = 1000  # a group of over 1/1000 of the rows is hot; there are at most so many, whatever the data


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Join rows with their groups, of which ``count`` is the size and ``total`` the sum of all sizes.

    Hot groups are broadcast: there are at most ``HOT_SHARE`` of them. What is dealt by key then has no key with
    more than 1/HOT_SHARE of the rows.
    """
    limit = total // HOT_SHARE
    hot, cold = groups.where(F.col(count) > limit), groups.where(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), on).unionByName(
        rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.hint("merge"), on))
