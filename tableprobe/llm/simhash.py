"""SimHash near-duplicates, compared bit by bit over many fingerprints at once.

Fingerprints within d bits agree on two of d + 2 blocks of bits, whichever two are chosen, so they are dealt by every
pair of blocks. Among those that agree, bit planes are stored vertically: word b of a block holds bit b of 64
fingerprints. A fingerprint is compared with 64 others by XOR of its bits with the planes, carry-save counters hold the
64 distances, and a block is abandoned once all of them have passed the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import join_groups, map_rows, ship, staged, text_of
from tableprobe.llm.graph import components, roots

SEED = 42
BLOCK = 4096  # fingerprints of one bucket compared in one go; larger buckets are compared block by block
CHUNK = 16_384  # rows a task gathers before it compares them
PIECE = 1 << 18  # bytes of a text, and those up to the next white space, whose shingles are listed at once
WHITE = re.compile(rb"[\x20\t-\r]")
UNITS = 1 << 19  # comparisons with 64 fingerprints each, held at once


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, by pieces of the text that end at white space; a piece takes over the last words."""
    raw = text.encode("utf-8", "replace")
    digest = xxhash.xxh64_intdigest
    at, parts, some = 0, [], False
    while at < len(raw):
        gap = WHITE.search(raw, at + PIECE)
        end = gap.end() if gap else len(raw)
        parts += raw[at:end].lower().split()  # bytes: A-Z and ASCII white space only
        at = end
        if len(parts) < words and (at < len(raw) or some or not parts):
            continue
        some = True
        joined = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = max(1, len(parts) - words + 1)
        yield np.array([digest(joined[a:b], SEED) for a, b in
                        zip(starts[:last].tolist(), ends[min(words, len(parts)) - 1:].tolist())], np.uint64)
        parts = parts[last:]


def fingerprint(hashes: Iterable[np.ndarray]) -> int:
    """Bit i is 1 if over half of the hashes have it; 0 without hashes. Long texts are counted in parts."""
    ones, total = np.zeros(64, np.int64), 0
    for piece in hashes:
        total += len(piece)
        for at in range(0, len(piece), 8192):
            part = piece[at:at + 8192]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """(key, fp) of every row; fp is a bigint with the 64 bits of the fingerprint."""
    plain = df.select(quoted(key).alias("key"), text_of(text).alias("text"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["key", "fp"])

    return map_rows(plain, rows, f"key {plain.schema['key'].dataType.simpleString()}, fp bigint")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: row k, column b holds bit b of the values 64k .. 64k+63."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def close_pairs(values: np.ndarray, group_end: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j < group_end[i], of values that differ in at most ``distance`` bits."""
    n = len(values)
    planes = planes_of(values)
    at = np.arange(n)
    per_row = np.where(group_end - 1 > at, (group_end - 1) // 64 - at // 64 + 1, 0)
    ends = np.cumsum(per_row)
    width = distance.bit_length()
    spare = (1 << width) - 1 - distance  # counters start here, so that they overflow past the limit
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + UNITS, "right")))
        count = per_row[start:stop]
        row = np.repeat(at[start:stop], count)
        block = row // 64 + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        low = np.clip(row + 1 - block * 64, 0, 64)
        high = np.clip(group_end[row] - block * 64, 0, 64)
        everything = np.uint64(0xFFFFFFFFFFFFFFFF)
        upto = lambda k: np.where(k > 0, everything >> (64 - np.maximum(k, 1)).astype(np.uint64), np.uint64(0))
        alive = upto(high) & ~upto(low)
        counters = [np.full(len(row), everything if spare >> w & 1 else 0, np.uint64) for w in range(width)]
        for b in range(64):
            if b % 6 == 0:
                keep = np.flatnonzero(alive)
                if len(keep) < 0.9 * len(alive):
                    row, block, alive = row[keep], block[keep], alive[keep]
                    counters = [c[keep] for c in counters]
                if not len(row):
                    break
            carry = planes[block, b] ^ (np.uint64(0) - (values[row] >> np.uint64(b) & np.uint64(1)))
            for w, counter in enumerate(counters):
                counters[w], carry = counter ^ carry, counter & carry
            alive &= ~carry
        keep = np.flatnonzero(alive)
        lanes = np.unpackbits(alive[keep].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        unit, lane = np.nonzero(lanes)
        yield row[keep][unit], block[keep][unit] * 64 + lane
        start = stop


def group_ends(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows, the position after the last row of each row's group."""
    changed = np.zeros(len(keys[0]), bool)
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    bounds = np.append(np.flatnonzero(changed), len(changed))
    return bounds[np.searchsorted(bounds, np.arange(len(changed)), "right")]


def links_within(stream: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, i, j, fp) sorted by unit, in; a spanning forest of the links of each chunk of whole units, out."""
    held: list[pa.RecordBatch] = []

    def solve(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        keys = [rows.column(c).to_numpy() for c in ("unit", "i", "j")]
        ends = group_ends(*keys)
        n = rows.num_rows
        done = n if last else int(np.flatnonzero(ends == n)[0])
        values = rows.column("fp").to_numpy()[:done].view(np.uint64)
        label = np.arange(done)
        for a, b in close_pairs(values, ends[:done], distance) if done else ():
            label = roots(done, np.concatenate([a, np.arange(done)]), np.concatenate([b, label]))
        child = np.flatnonzero(label != np.arange(done))
        out = pa.RecordBatch.from_arrays([pa.array(values[child].view(np.int64)),
                                          pa.array(values[label[child]].view(np.int64))], ["a", "b"])
        return out, rows.slice(done)

    size = 0
    for batch in stream:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            out, rest = solve(pa.Table.from_batches(held).combine_chunks(), False)
            yield out
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield solve(pa.Table.from_batches(held).combine_chunks(), True)[0]


def bucket_keys(distance: int) -> list:
    """A key for every pair of distance + 2 blocks of bits; the pair's number is part of it."""
    n = distance + 2
    bounds = [64 * i // n for i in range(n + 1)]
    bits = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(bounds, bounds[1:])]
    return [F.shiftleft(bits[x], bounds[y + 1] - bounds[y]).bitwiseOR(bits[y]) + F.lit(number << 48)
            for number, (x, y) in enumerate(combinations(range(n), 2))]


def split_hot(rows: DataFrame, unit: list[str], member: str, block: int) -> DataFrame:
    """Add (own, i, j): buckets of more than ``block`` members are cut into blocks, and every two meet in a unit.

    ``own`` is the block of the row, (i, j) the blocks that meet. The sizes are counted first; buckets within the limit
    are one unit and their rows stay single.
    """
    large = staged(rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") > block)
                   .select(*unit, F.ceil(F.col("n_members") / block).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    return (
        rows.join(large, unit, "left")
        .withColumn("own", F.pmod(F.xxhash64(member), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*rows.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))


def simhash_groups(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3,
                   distance: int = 3) -> DataFrame:
    """One row per row of ``df``: (key, fp bigint, component_id).

    Shingles of ``words`` words, repeats included, are hashed with XXH64; texts with fewer words have one shingle, and
    null or empty ones the fingerprint 0, which is linked like any other. Fingerprints within ``distance`` bits are
    linked, and ``component_id`` is the smallest key reachable (null keys don't count). Equal fingerprints are compared
    once. No rows give no rows.
    """
    ship(df.sparkSession)
    marked = staged(fingerprints(df, text, key, words))
    distinct = staged(marked.groupBy("fp").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")))
    probes = distinct.select("fp", F.explode(F.array(*bucket_keys(distance))).alias("unit"))
    units = split_hot(probes, ["unit"], "fp", BLOCK).repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    links = units.select("unit", "i", "j", "fp").mapInArrow(
        lambda stream: links_within(stream, distance), "a bigint, b bigint")
    whole = components(links)
    label = F.coalesce("component", "fp")
    joined = distinct.join(whole, distinct.fp == whole.node, "left").select("fp", "first", "n", label.alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(joined.join(lowest, "root").select("fp", "component_id", "n"))
    return join_groups(marked, named, ["fp"], "n", marked.count()).select(F.col("key").alias(key), "fp", "component_id")
