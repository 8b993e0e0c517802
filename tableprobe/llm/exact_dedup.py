"""Exact duplicates by a compressed exchange of fingerprints.

Each partition sorts short fingerprints of its texts and sends every owner of a fingerprint range one Golomb-Rice coded
message, in which a fingerprint stands once however many rows share it. Owners decode the messages, mark fingerprints
that came in two of them, and send back a bitmap per message. Only texts that are marked, or repeated within their
partition, are shuffled: they are grouped by their bytes, which undoes chance agreement of fingerprints. Partitions
tell suspects by a sieve of bounded size, one bit per remainder of the fingerprint; texts that pass by chance form
groups of one, which nothing refers to. The places of a text that very many rows share are told by a broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import join_groups, ship, sieved, staged, text_of

FINGERPRINT_BITS = 48  # sent per distinct text before coding; 3e10 texts then give one false suspect in 10,000
MESSAGE_ROWS = 400_000  # rows a partition sorts at once; a longer one sends several messages to an owner


def rice_encode(values: np.ndarray) -> bytes:
    """Ascending distinct integers as gaps: quotients in unary, then remainders in binary."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, int(np.log2(max(1.0, 0.69 * gaps.mean()))))
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    head = np.array([len(gaps), k, len(unary)], np.int64)
    return head.tobytes() + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    n, k, length = np.frombuffer(code, np.int64, 3).tolist()
    bits = np.frombuffer(code, np.uint8, offset=24)
    unary = np.unpackbits(bits[:(length + 7) // 8], count=length)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    rest = np.unpackbits(bits[(length + 7) // 8:], count=n * k).reshape(n, k)
    gaps = (quotients << k) + rest @ (1 << np.arange(k, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id",
                fingerprint_bits: int = FINGERPRINT_BITS) -> DataFrame:
    """One row per row of ``df``: (key, keep_id, group_size, kept, text_sha256).

    Of rows with equal text (a null text is empty) the one with the largest key stays; null keys count as smallest, and
    of rows that repeat the largest key one stays. ``keep_id`` is the key of that row. Rows of equal text are told
    apart by nothing else, so their other columns play no part. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    owner_bits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    value_bits = max(1, fingerprint_bits - owner_bits)
    shift = 64 - owner_bits - value_bits
    texts = df.select(quoted(key).alias("key"), text_of(text).alias("text")).withColumn("fp", F.xxhash64("text"))
    key_type = texts.schema["key"].dataType.simpleString()

    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in stream:
            held.append(batch)
            n += batch.num_rows
            if n >= MESSAGE_ROWS:
                yield from messages(held)
                held, n = [], 0
        if n:
            yield from messages(held)

    def messages(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        short = rows.column(1).to_numpy().view(np.uint64) >> np.uint64(shift)
        order = np.argsort(short, kind="stable")
        rows, short = rows.take(pa.array(order)), short[order]
        owners = (short >> np.uint64(value_bits)).astype(np.int64)
        values = (short & np.uint64((1 << value_bits) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        ends = np.append(starts[1:], len(owners))
        cells = pa.StructArray.from_arrays(rows.columns, ["key", "fp", "sha"])
        name = uuid.uuid4().hex
        yield pa.RecordBatch.from_arrays([
            pa.array([name] * len(starts)), pa.array(owners[starts], pa.int32()),
            pa.array([rice_encode(np.unique(values[a:b])) for a, b in zip(starts, ends)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.append(starts, len(owners)).astype(np.int32)), cells),
        ], ["message", "owner", "code", "rows"])

    def mark(messages: pa.Table) -> pa.Table:
        lists = [rice_decode(c) for c in messages.column("code").to_pylist()]
        _, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        marks = np.split(counts[back] > 1, np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"message": messages.column("message"), "owner": messages.column("owner"),
                         "bitmap": pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())})

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                cells = batch.column(1)[i].values
                fps, shas = cells.field("fp").to_numpy().view(np.uint64), cells.field("sha").to_pylist()
                _, short, counts = np.unique(fps >> np.uint64(shift), return_inverse=True, return_counts=True)
                marked = np.unpackbits(np.frombuffer(batch.column(2)[i].as_py(), np.uint8), count=len(counts))
                suspect = ((marked > 0) | (counts > 1))[short]
                groups: dict[bytes, list[int]] = {}
                for at, sha in enumerate(shas):
                    groups.setdefault(sha, []).append(at)
                take = np.concatenate([np.array(g) for g in groups.values()])
                first = np.array([g[0] for g in groups.values()])
                sizes = np.cumsum([0] + [len(g) for g in groups.values()])
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()] * len(first)),
                    pa.array(list(groups), pa.binary()), pa.array(fps[first].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)),
                                             cells.field("key").take(pa.array(take))),
                    pa.array(suspect[first]),
                ], ["message", "sha", "fp", "keys", "suspect"])

    sent = staged(texts.select("key", "fp", F.unhex(F.sha2("text", 256)).alias("sha")).mapInArrow(
        send, f"message string, owner int, code binary, rows array<struct<key:{key_type},fp:bigint,sha:binary>>"))
    bitmaps = sent.select("message", "owner", "code").groupBy("owner").applyInArrow(
        mark, "message string, owner int, bitmap binary")
    judged = staged(sent.select("message", "owner", "rows").join(bitmaps, ["message", "owner"]).select(
        "message", "rows", "bitmap").mapInArrow(
        judge, f"message string, sha binary, fp bigint, keys array<{key_type}>, suspect boolean"))

    suspects = judged.where("suspect")
    classes = (
        sieved(texts, F.col("fp"), suspects, F.col("fp")).where("_hit")
        .groupBy("text").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    keepers = suspects.groupBy("sha").agg(
        F.max(F.struct(F.array_max("keys").alias("top"), "message"))["message"].alias("keeper"))
    repeated = staged(classes.join(keepers, "sha"))
    rows = suspects.agg(F.sum(F.size("keys"))).first()[0] or 0
    found = join_groups(suspects.select("sha", "keys", "message"), repeated, ["sha"], "group_size", rows).select(
        "sha", "keys", "keep_id", "group_size",
        F.when(F.col("message") == F.col("keeper"),
               F.coalesce(F.array_position("keys", F.array_max("keys")), F.lit(1)) - 1).alias("at"))
    single = judged.where("NOT suspect").select(
        "sha", "keys", F.get("keys", F.lit(0)).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(0).cast("bigint").alias("at"))
    return (
        found.unionByName(single)
        .select("*", F.posexplode("keys").alias("pos", "key"))
        .select(F.col("key").alias(key), "keep_id", "group_size",
                F.coalesce(F.col("pos") == F.col("at"), F.lit(False)).alias("kept"),
                F.lower(F.hex("sha")).alias("text_sha256")))
