"""Repeated passages by overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import join_groups, sieved, staged

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id", lines: int = LINES) -> DataFrame:
    """(key, digest, spans): the line ranges [start, end) of each text that later occurrences cover, merged.

    A window is ``lines`` consecutive lines; of equal windows the first by key (nulls first), then text digest, then
    position stays, the others are covered. Rows without a covered line are left out.
    """
    texts = df.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))
    parts = _lines(F.col("text"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("lines") - lines),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*[F.get("lines", i + k) for k in range(lines)]).alias("h1"),
            F.xxhash64(F.lit(lines), *[F.get("lines", i + k) for k in range(lines)]).alias("h2")))
    found = staged(
        texts.where(F.size(parts) >= lines)
        .select("key", F.xxhash64("text").alias("digest"), parts.alias("lines"))
        .select("key", "digest", F.explode(windows).alias("w"))
        .select("key", "digest", "w.at", "w.h1", "w.h2"))
    place = F.struct("key", "digest", "at")
    repeated = staged(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                      .where("n > 1"))
    later = (
        join_groups(found, repeated, ["h1", "h2"], "n", found.count())
        .where(~place.eqNullSafe(F.col("first"))).select("key", "digest", "at").distinct())
    return (
        later.groupBy("key", "digest").agg(F.sort_array(F.collect_list("at")).alias("starts"))
        .select("key", "digest", F.expr(f"""
            transform(filter(sequence(0, size(starts) - 1),
                             i -> i = 0 OR get(starts, i) > get(starts, i - 1) + {lines}), i -> get(starts, i))
            """).alias("begins"), F.expr(f"""
            transform(filter(sequence(0, size(starts) - 1),
                             i -> i = size(starts) - 1 OR get(starts, i + 1) > get(starts, i) + {lines}),
                      i -> get(starts, i) + {lines})""").alias("ends"))
        .select("key", "digest", F.arrays_zip(F.col("begins").alias("start"), F.col("ends").alias("end"))
                .alias("spans")))


def line_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", lines: int = LINES) -> DataFrame:
    """The rows of ``df`` with their text less the covered lines, and ``n_lines``, ``spans`` (start, end) added.

    Lines end at each newline. Texts of fewer than ``lines`` lines, null and empty ones stay as they are (null has 0
    lines, an empty text one). A text that is covered whole becomes empty; its row stays. Rows that agree in key and
    text are one document that is listed twice: they get the same result. Input columns called ``n_lines`` or
    ``spans`` are replaced.
    """
    rest = df.drop("n_lines", "spans")
    body = quoted(text).cast("string")
    covered = staged(repeated_spans(rest, text, key, lines)).select(
        F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    marked = sieved(rest.withColumn("_place", F.xxhash64(quoted(key), F.xxhash64(body))), F.col("_place"),
                    covered, F.xxhash64("_key", "_digest"))
    same = quoted(key).eqNullSafe(F.col("_key")) & (F.xxhash64(body) == F.col("_digest"))
    hits = marked.where("_hit").join(covered.hint("merge"), same, "left")
    split = _lines(body)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_spans")), lambda j: F.slice(
        split, F.coalesce(F.get("_spans", j - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get("_spans", j)["start"], F.size(split)) - F.coalesce(F.get("_spans", j - 1)["end"], F.lit(0)))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    count = F.when(body.isNull(), F.lit(0)).otherwise(F.size(split)).cast("bigint").alias("n_lines")
    thinned = hits.select(
        *[F.when(F.col("_spans").isNull(), quoted(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text
          else quoted(c) for c in rest.columns], count, F.coalesce(F.col("_spans"), none).alias("spans"))
    return thinned.unionByName(
        marked.where("NOT _hit").select(*[quoted(c) for c in rest.columns], count, none.alias("spans")))
