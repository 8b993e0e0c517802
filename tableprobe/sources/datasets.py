"""Read a CSV, JSON-lines or text dataset from any path Spark can reach."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared formats and the file extension each one goes with.
EXTENSIONS = {"csv": ".csv", "json": ".json", "text": ".txt"}
COMPRESSED = r"\.(gz|bz2|zst|xz|lz4|snappy|deflate)"
OPTIONS = {"csv": {"header": True, "inferSchema": True}, "json": {}, "text": {}}


def _normal(file_type: str | None) -> str:
    return (file_type or "").strip().lower()


def is_allowed(file_name: str | None, file_type: str | None) -> bool:
    """Whether a file's name ends, in any case, like those of the declared format."""
    suffix = EXTENSIONS.get(_normal(file_type))
    return suffix is not None and (file_name or "").lower().endswith(suffix)


def read_dataset(spark: SparkSession, path: str | list[str], file_type: str,
                 schema: T.StructType | str | None = None, **options) -> DataFrame:
    """The dataset at ``path``: a file, directory, glob or list of them.

    CSV has a header. Types are inferred, which reads CSV and JSON one extra time; on large data pass ``schema``
    or, as a reader option, ``samplingRatio``. Further options go to Spark's reader (``multiLine``, ``sep``, ...).
    """
    fmt = _normal(file_type)
    if fmt not in OPTIONS:
        raise ValueError(f"unsupported file type: {file_type!r}; one of {', '.join(OPTIONS)}")
    settings = dict(OPTIONS[fmt])
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
        settings.pop("inferSchema", None)
    return reader.options(**{**settings, **options}).load(path)


def check_dataset(df: DataFrame, path: str | list[str], file_type: str) -> int:
    """Refuse files named like another format, and a dataset without a byte; a lone CSV header may pass. The bytes.

    The files themselves are checked, whatever their directories are called: a file's name has the format's extension,
    before that of a compression if there is one, or no extension at all. They are listed as a table of names and
    lengths, and neither their content nor their number comes to the driver.
    """
    suffix = EXTENSIONS[_normal(file_type)]
    name = F.regexp_extract("path", "([^/]*)$", 1)
    fits = F.lower(name).rlike(rf"{re.escape(suffix)}({COMPRESSED})?$") | ~name.contains(".")
    files = df.sparkSession.read.format("binaryFile").load(path)
    found = files.agg(F.max(F.when(~fits, F.col("path"))).alias("other"), F.sum("length").alias("bytes")).first()
    if found["other"]:
        raise ValueError(f"{found['other']!r} is not named like a {_normal(file_type)} file")
    if not df.columns or not found["bytes"]:
        raise ValueError(f"{path!r} is empty")
    return found["bytes"]
