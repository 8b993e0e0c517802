"""How often a dataset is read, and so whether to read it again, copy it to Parquet, or hold it on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableprobe.functions.columns import is_groupable, is_numeric
from tableprobe.operators.profile import COLUMNS_PER_AGGREGATE

HOLD, STAGE, REREAD = "hold", "stage", "reread"

# Costs of a byte of text, in units of parsing it once. Rough figures: what matters is which is many times another.
WRITE, READ_COPY, READ_HELD = 1.0, 0.15, 0.05
EXPANSION = 1.5  # bytes held for a byte of text
SHARE = 0.5  # of the memory for storage that is free, which the table may take
MODEL_SCANS = 9  # empty checks, label screen, split checks, and one each for three fits, their scores, and the days


def scans_of(df: DataFrame, typed: bool = True) -> int:
    """How many times the profile and the jobs scan a table of these columns; without types, as if all jobs ran."""
    kinds = {type(f.dataType) for f in df.schema.fields if is_groupable(f.dataType)}
    profile = -(-len(df.columns) // COLUMNS_PER_AGGREGATE) + len(kinds)
    modelled = not typed or any(is_numeric(f.dataType) for f in df.schema.fields)
    return profile + MODEL_SCANS * modelled


def storage_memory(spark: SparkSession) -> int:
    """Bytes that are free for storage on the executors, or on the driver where it is the only one."""
    status = spark._jsc.sc().getExecutorMemoryStatus().values().toSeq()
    free = [status.apply(i)._2() for i in range(status.size())]
    return int(sum(free[1:] if len(free) > 1 else free))


def choose(size: int, scans: int, memory: int, may_stage: bool = True) -> str:
    """The cheapest way to scan a text dataset of ``size`` bytes so many times.

    Holding is first, if half of the free memory holds all of it: what doesn't fit would be parsed again in each scan.
    """
    costs = {REREAD: float(scans)}
    if size * EXPANSION <= memory * SHARE:
        costs[HOLD] = 1 + scans * READ_HELD
    if may_stage:
        costs[STAGE] = 1 + WRITE + scans * READ_COPY
    return min(costs, key=lambda way: (costs[way], way))
