"""Where intermediate tables may be written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def _shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def has_shared_folder(spark: SparkSession) -> bool:
    """Whether the session names a folder for intermediate tables."""
    return bool(_shared_folder(spark))


def scratch_directory(spark: SparkSession) -> str:
    """A new path under the shared folder named by ``spark.checkpoint.dir``, or set on the session's context."""
    shared = _shared_folder(spark)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared.rstrip('/')}/{uuid4().hex}"


def own_folder(spark: SparkSession) -> None:
    """Give a session on one machine that names no folder one of its own, removed when Python ends.

    For entry points, tests and the bench; the operators only ever use what the session names.
    """
    context = spark.sparkContext
    if has_shared_folder(spark):
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tableprobe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
