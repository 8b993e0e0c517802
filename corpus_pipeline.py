"""The corpus pipeline: documents are filtered, thinned, deduplicated, cleaned of secrets and packed into sequences.

Each stage is a function of (session, documents, directory of the tables). Its input is what the stage before it wrote;
all but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.llm import quality
from tableprobe.llm.common import sieved, staged
from tableprobe.llm.line_dedup import line_dedup
from tableprobe.llm.packing import pack_documents
from tableprobe.llm.queries import BYTE_BPE, fold
from tableprobe.llm.secret_scan import redact_secrets
from tableprobe.llm.simhash import simhash_groups
from tableprobe.plans.tables import table
from tableprobe.sources.scratch import own_folder


def with_new_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``changed``, with the length of the text brought up to date."""
    return changed.select(*[
        F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of at least a half, by a model of the labelled rows outside the held-out third."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = quality.score(docs, model, output="_score")
    return scored.where("_score >= 0.5").select(*docs.columns)


def thin_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of passages of three lines and more; those covered whole go."""
    thinned = line_dedup(docs)
    first = F.get("spans", F.lit(0))
    whole = (F.size("spans") == 1) & (first["end"] - first["start"] == F.col("n_lines"))
    return with_new_text(docs, thinned.where(~whole))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id (null is largest), one of them if rows repeat it.

    Rows are told apart by doc_id and text. Only rows that go, or that stay once of several, are shuffled with their
    text; a sieve of fixed size lets the others through.
    """
    keyed = docs.withColumn("_id", F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("doc_id", "text").alias("key"),
        F.xxhash64(F.lit(1), "doc_id", "text").alias("other")))
    groups = simhash_groups(keyed.select("_id", "text"), key="_id", words=3, distance=3)
    decided = staged(
        groups.groupBy("_id").agg(F.max("component_id").alias("first"), F.count(F.lit(1)).alias("rows"))
        .select("_id.key", "_id.other", (F.col("_id") == F.col("first")).alias("stays"), "rows")
        .where("NOT stays OR rows > 1"))
    marked = sieved(keyed.withColumn("_key", F.col("_id.key")).withColumn("_other", F.col("_id.other")).drop("_id"),
                    F.col("_key"), decided, F.col("key"))
    hits = marked.where("_hit").join(
        decided.select(F.col("key").alias("_key"), F.col("other").alias("_other"), F.col("stays").alias("_stays"))
        .hint("merge"), ["_key", "_other"], "left")
    kept = [marked.where("NOT _hit"), hits.where("_stays IS NULL"),
            hits.where("_stays").dropDuplicates(["_key", "_other"])]
    return reduce(DataFrame.unionByName, [k.select(*docs.columns) for k in kept])


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of every secret."""
    return with_new_text(docs, redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their places in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path(BYTE_BPE))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def entry(stage: Stage) -> Stage:
    """The stage, on a session that names a shared folder or, on one machine, is given one."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own_folder(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", entry(filter_quality)),
    ("line_dedup", entry(thin_lines)),
    ("simhash_near_dedup", entry(drop_near_copies)),
    ("secret_scans", entry(remove_secrets)),
    ("best_fit_packing", entry(pack)),
]

# Fitted scores, bit counts of hashes and token ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; what each returns is written to the shared folder and read again."""
    own_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
