"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every window of 200 bytes is filed under the least hash of its 32-byte strings, which its content alone decides; equal
windows so meet under one anchor wherever they stand. Consecutive windows under one anchor form a run, and runs of equal
bytes are compared once, with their number as weight. Anchors with a single run, seen once, are done.

The different runs under an anchor are sorted in small shards, and the shards' transforms are merged: an interleave, the
sequence of shard numbers of all suffixes in order, is refined until it is right for 200 bytes. Each round takes the
symbols in front of the suffixes, here strings of 40 bytes, in the order of the interleave, and deals the suffixes by
them without disturbing that order, which sorts by 40 bytes more. Where neighbours differ in symbol or in the block they
came from, their common prefix ends; what is one block after the last round is one repeated interval. No suffixes of
different shards are ever compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.bpe import slices
from tableprobe.llm.common import join_groups, map_rows, ship, sieved, staged, text_of
from tableprobe.llm.simhash import group_ends

LENGTH = 200
ANCHOR = 32  # bytes whose hashes are compared to find a window's anchor
SYMBOL = 40  # bytes by which a round of refinement moves; divides LENGTH
LONGEST_RUN = 400  # windows of a run; longer stretches of one anchor are cut
PIECE_WINDOWS = 1 << 19  # windows of one text whose anchors are found at once; longer texts are read piece by piece
SHARD_BYTES = 1 << 17
CHUNK_BYTES = 1 << 20  # bytes of runs merged in one go, whole anchors only
WIDE = 4096  # different runs under one anchor; wider anchors are settled window by window

RUNS = "array<struct<at:int,span:int,anchor:bigint,twice:boolean,digest:binary>>"
STARTS = "array<struct<start:int,end:int>>"


def string_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position of an array."""
    n = len(data)
    word = np.zeros(n + 64, np.uint64)
    word[:n] = data
    for step in (1, 2, 4):
        word[:n + 32] |= word[step:n + 32 + step] << np.uint64(8 * step)
    count = n - ANCHOR + 1
    mixed = np.zeros(count, np.uint64)
    for at, factor in zip(range(0, ANCHOR, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                0xD6E8FEB86659FD93)):
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xFF51AFD7ED558CCD) + word[at:at + count] * np.uint64(factor)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, from running ones within and across blocks of that size."""
    padded = np.full(-(-len(values) // width) * width, np.uint64(fill))
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    forward = best.accumulate(rows, axis=1).ravel()
    backward = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    places = len(values) - width + 1
    return best(backward[:places], forward[width - 1:width - 1 + places])


def runs_of(texts: list[bytes]) -> tuple[list[int], tuple]:
    """How many runs each text has, and (at, span, anchor, twice, digest) of all of them."""
    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    counts = [0] * len(texts)
    if not long:
        return counts, ([], [], [], [], [])
    data = b"".join(texts[i] for i in long)
    sizes = np.array([len(texts[i]) for i in long])
    offsets = np.cumsum(sizes) - sizes
    hashes = string_hashes(np.frombuffer(data, np.uint8))
    width = LENGTH - ANCHOR + 1
    least = sliding(hashes, width, np.minimum, (1 << 64) - 1)
    windows = sizes - LENGTH + 1
    doc = np.repeat(np.arange(len(long)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[doc]
    value = least[at]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
    within = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    begin = np.flatnonzero(within % LONGEST_RUN == 0)
    span = np.diff(np.append(begin, len(at)))
    # A run can repeat within itself only if its anchor stands in it twice.
    fence = np.zeros(width - 1, np.uint64)
    used = np.flatnonzero(sliding(np.concatenate([fence, least, fence]), width, np.maximum, 0) == hashes)
    _, value_of = np.unique(np.concatenate([hashes[used], value[begin]]), return_inverse=True)
    places = np.sort(value_of[:len(used)] * len(data) + used)
    low = value_of[len(used):] * len(data) + at[begin]
    twice = np.searchsorted(places, low + span + width - 1) - np.searchsorted(places, low) > 1
    digest = [hashlib.blake2b(data[a:b], digest_size=16).digest()
              for a, b in zip(at[begin].tolist(), (at[begin] + span + LENGTH - 1).tolist())]
    for i, n in zip(long, np.bincount(doc[begin], minlength=len(long)).tolist()):
        counts[i] = n
    return counts, (at[begin] - offsets[doc[begin]], span, value[begin].view(np.int64), twice, digest)


def runs_by_piece(texts: list[bytes]) -> tuple[list[int], tuple]:
    """`runs_of` texts of any length, in memory that does not grow with the longest.

    A piece holds all bytes of its windows and every window is in one piece, so pieces overlap by a window less one.
    """
    pieces = [(i, at, t[at:at + PIECE_WINDOWS + LENGTH - 1]) for i, t in enumerate(texts)
              for at in range(0, max(1, len(t) - LENGTH + 1), PIECE_WINDOWS)]
    counts, columns = [0] * len(texts), []
    for part in slices([body for _, _, body in pieces], PIECE_WINDOWS):
        done, pieces = pieces[:len(part)], pieces[len(part):]
        each, (at, *others, digest) = runs_of(part)
        for (i, _, _), n in zip(done, each):
            counts[i] += n
        if digest:
            columns.append((at + np.repeat([shift for _, shift, _ in done], each), *others, digest))
    if not columns:
        return counts, ([], [], [], [], [])
    *arrays, digests = zip(*columns)
    return counts, (*map(np.concatenate, arrays), [d for part in digests for d in part])


def find_runs(docs: DataFrame) -> DataFrame:
    """(sha, runs) of texts (sha, text); texts shorter than a window have none and are left out."""
    def rows(batch: pa.RecordBatch) -> pa.Table:
        found, at = [], 0
        for part in slices(batch.column(1).to_pylist(), 1_000_000):
            counts, (begin, span, anchor, twice, digest) = runs_by_piece([t.encode("utf-8", "replace") for t in part])
            cells = pa.StructArray.from_arrays(
                [pa.array(begin, pa.int32()), pa.array(span, pa.int32()), pa.array(anchor, pa.int64()),
                 pa.array(twice, pa.bool_()), pa.array(digest, pa.binary())], ["at", "span", "anchor", "twice", "digest"])
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            found.append(pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(ends, cells)], ["sha", "runs"]))
            at += len(part)
        return pa.Table.from_batches(found)

    return map_rows(docs.where(F.octet_length("text") >= LENGTH), rows, f"sha binary, runs {RUNS}")


def counted_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys, dealt out by counts of 16 bits at a time: linear in their number."""
    order, done = None, 0
    most = int(keys.max(initial=0))
    while order is None or most >> done:
        digit = (keys >> done & 0xFFFF).astype(np.uint16)
        order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
        done += 16
    return order


def ranked(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys from 0, equal keys alike."""
    order = np.argsort(keys)
    in_order = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.append(0, in_order[1:] != in_order[:-1]))
    return ranks


def merged_blocks(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, block) of all suffixes of some byte strings: one block, same first LENGTH bytes."""
    sizes = np.array([len(b) for b in bodies])
    room = sizes + SYMBOL  # each text ends with SYMBOL end marks, which are suffixes without a byte
    first = np.cumsum(room) - room
    total = int(room.sum())
    text = np.repeat(np.arange(len(bodies)), room)
    offset = np.arange(total) - first[text]
    real = offset < sizes[text]
    codes = np.zeros(total + LENGTH, np.int64)
    codes[:total][real] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 1

    # The symbol at a position: the rank of its SYMBOL bytes; 0 stands for an end mark.
    packed = codes[:total + SYMBOL].copy()
    for k in range(1, 5):
        packed[:total] = packed[:total] << 9 | codes[k:total + k]
    symbol, width = ranked(packed[:total]) + 1, 5
    while width < SYMBOL:
        after = np.zeros(total, np.int64)
        after[:total - width] = symbol[width:]
        symbol, width = ranked(symbol << 32 | after) + 1, width * 2
    symbol[~real] = 0

    # Shards: each sorts its own suffixes, symbol by symbol, and keeps the symbol in front of each.
    shard_of_text = np.cumsum(room) // SHARD_BYTES
    bounds = np.append(first[np.flatnonzero(np.diff(shard_of_text, prepend=-1))], total)
    suffixes, fronts, marks = [], [], []
    for a, b in zip(bounds, bounds[1:]):
        at = np.arange(a, b)
        own = at[real[a:b]]
        keys = []
        for k in range(0, LENGTH, SYMBOL):
            inside = offset[own] + k < sizes[text[own]]
            keys.append(np.where(inside, symbol[np.minimum(own + k, total - 1)], 0))
        order = np.lexsort((keys[4], keys[2] << 32 | keys[3], keys[0] << 32 | keys[1]))
        sorted_own = np.concatenate([at[~real[a:b]], own[order]])
        suffixes.append(sorted_own)
        fronts.append(np.where(offset[sorted_own] >= SYMBOL, symbol[np.maximum(sorted_own - SYMBOL, 0)], 0))
        marks.append(int((~real[a:b]).sum()))
    front = np.concatenate(fronts)
    count = len(suffixes)
    number = np.arange(count, dtype=np.uint16)
    empty = np.repeat(number, marks)
    interleave = np.concatenate([empty, np.repeat(number, [len(s) - m for s, m in zip(suffixes, marks)])])
    block = np.zeros(total, np.int64)  # before the first round nothing is told apart
    for _ in range(LENGTH // SYMBOL):
        by_shard = np.argsort(interleave, kind="stable")
        in_order = np.empty(total, np.int64)
        in_order[by_shard] = front
        slots = np.flatnonzero(in_order)
        dealt = slots[counted_order(in_order[slots])]
        marked, came = in_order[dealt], block[dealt]
        apart = np.append(True, (marked[1:] != marked[:-1]) | (came[1:] != came[:-1]))
        interleave = np.concatenate([empty, interleave[dealt]])
        block = np.concatenate([np.zeros(len(empty), np.int64), np.cumsum(apart)])
    by_shard = np.argsort(interleave, kind="stable")
    where = np.empty(total, np.int64)
    where[np.concatenate(suffixes)] = block[by_shard]
    return text[real], offset[real], where[real]


def repeated_windows(bodies: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    """For each run, which of its windows occur at least twice, runs counted with their weights."""
    text, offset, block = merged_blocks(bodies)
    windows = np.array([len(b) - LENGTH + 1 for b in bodies])
    whole = offset < windows[text]
    text, block = text[whole], block[whole]
    times = np.bincount(block, weights=weights[text])
    return np.split(times[block] > 1, np.cumsum(windows)[:-1])


def intervals(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def settle(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (anchor, digest, n, body) sorted by anchor, in; (anchor, digest, starts) of those met once, out."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def merged(rows: pa.Table) -> pa.RecordBatch:
        n = rows.column("n").to_numpy()
        flags = repeated_windows(rows.column("body").to_pylist(), n)
        take = np.flatnonzero(n == 1)
        return pa.RecordBatch.from_arrays(
            [rows.column("anchor").combine_chunks().take(pa.array(take)),
             rows.column("digest").combine_chunks().take(pa.array(take)),
             pa.array([intervals(flags[i]) for i in take], kind)], ["anchor", "digest", "starts"])

    held: pa.Table | None = None
    for batch in stream:
        new = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, new]).combine_chunks() if held is not None else new
        while held.num_rows:
            ends = group_ends(held.column("anchor").to_numpy())
            sizes = np.cumsum(np.fromiter((len(b) + SYMBOL for b in held.column("body").to_pylist()), np.int64))
            full = ends[min(int(np.searchsorted(sizes, CHUNK_BYTES)), len(ends) - 1)]
            if sizes[-1] < CHUNK_BYTES or full == held.num_rows:
                break
            yield merged(held.slice(0, full))
            held = held.slice(full).combine_chunks()
    if held is not None and held.num_rows:
        yield merged(held)


def settle_wide(runs: DataFrame) -> DataFrame:
    """The same for anchors with very many different runs: every window by its digest, counted by a group-by."""
    windows = staged(
        runs.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("span") - 1)))
        .select("anchor", "digest", "n", "at", F.unhex(F.sha2(F.substring("body", F.col("at") + 1, F.lit(LENGTH)), 256))
                .alias("window")))
    repeated = windows.groupBy("window").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("rows")).where(
        "times > 1").select("window", "rows")
    found = join_groups(windows.where("n = 1").select("anchor", "digest", "at", "window"), staged(repeated), ["window"],
                        "rows", windows.count())
    last = "size(ats) - 1"
    return (
        found.groupBy("anchor", "digest").agg(F.sort_array(F.collect_list("at")).alias("ats"))
        .select("anchor", "digest", F.arrays_zip(
            F.expr("filter(ats, (x, i) -> i = 0 OR get(ats, i - 1) <> x - 1)").alias("start"),
            F.expr(f"transform(filter(ats, (x, i) -> i = {last} OR get(ats, i + 1) <> x + 1), x -> x + 1)").alias("end"))
            .cast(STARTS).alias("starts")))


def cut_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(anchor, digest, n, kinds, span, body) of every run wanted of some texts (text binary, wanted)."""
    texts, wanted = batch.column(0).to_pylist(), batch.column(1)
    runs = wanted.flatten()
    cells = dict(zip((f.name for f in runs.type), runs.flatten()))
    owner = np.repeat(np.arange(len(texts)), wanted.value_lengths().to_numpy(zero_copy_only=False))
    bodies = [texts[o][a:a + n + LENGTH - 1]
              for o, a, n in zip(owner.tolist(), cells["at"].to_pylist(), cells["span"].to_pylist())]
    names = ["anchor", "digest", "n", "kinds", "span"]
    return pa.RecordBatch.from_arrays([*[cells[c] for c in names], pa.array(bodies, pa.binary())], [*names, "body"])


def first_bytes(sha: str = "sha") -> Column:
    """A bigint of the digest's first bytes, for sieves."""
    return F.xxhash64(sha)


def repeated_ranges(df: DataFrame, text: str = "text") -> DataFrame:
    """(sha, spans): the byte ranges of each different text that repeated strings cover, merged and in order."""
    docs = df.select(text_of(text).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    by_text = staged(find_runs(docs.select("sha", "text")))
    often = staged(
        by_text.select(F.explode(F.arrays_zip("runs.anchor", "runs.twice")).alias("r")).groupBy("r.anchor").agg(
            F.sum(F.when(F.col("r.twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("anchor"))
    every = by_text.select("sha", F.explode("runs").alias("run")).select("sha", "run.*")
    sifted = sieved(every, F.col("anchor"), often, F.col("anchor")).where("_hit").drop("_hit")
    copies = staged(sifted.groupBy("sha", "at", "span", "anchor", "twice", "digest").agg(F.count(F.lit(1)).alias("n"))
                    .join(often.hint("merge"), "anchor", "left_semi"))
    contents = staged(copies.groupBy("anchor", "digest").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("twice").alias("twice"),
        F.min(F.struct("sha", "at", "span")).alias("place")))
    several = staged(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("twice"))
                     .where("kinds > 1 OR twice").select("anchor", "kinds"))

    wanted = contents.join(several, "anchor").select(
        "place.sha", F.struct("anchor", "digest", "n", "kinds", "place.at", "place.span").alias("run"))
    by_sha = staged(wanted.groupBy("sha").agg(F.collect_list("run").alias("wanted")))
    hits = sieved(docs, first_bytes(), by_sha, first_bytes()).where("_hit").select("sha", "text").distinct()
    runs = staged(map_rows(
        hits.join(by_sha.hint("merge"), "sha").select(F.col("text").cast("binary").alias("text"), "wanted"), cut_runs,
        "anchor bigint, digest binary, n bigint, kinds bigint, span int, body binary"))
    narrow = runs.where(F.col("kinds") <= WIDE).select("anchor", "digest", "n", "body").repartition(
        "anchor").sortWithinPartitions("anchor").mapInArrow(settle, f"anchor bigint, digest binary, starts {STARTS}")
    wide = settle_wide(runs.where(F.col("kinds") > WIDE))
    whole = contents.where("n > 1").select("anchor", "digest", "rows", F.array(F.struct(
        F.lit(0).alias("start"), F.col("place.span").alias("end"))).cast(STARTS).alias("starts"))
    partly = narrow.unionByName(wide).where(F.size("starts") > 0).select(
        "anchor", "digest", F.lit(1).cast("bigint").alias("rows"), "starts")
    known = staged(whole.unionByName(partly))
    found = join_groups(copies.select("sha", "at", "anchor", "digest"), known, ["anchor", "digest"], "rows",
                        copies.count())
    ranges = found.select("sha", F.explode(F.transform("starts", lambda s: F.struct(
        (F.col("at") + s["start"]).alias("start"), (F.col("at") + s["end"] - 1 + LENGTH).alias("end")))).alias("r"))
    last = "size(rs) - 1"
    return (
        ranges.groupBy("sha").agg(F.sort_array(F.collect_list("r")).alias("rs"))
        .select("sha", F.arrays_zip(
            F.expr("transform(filter(rs, (x, i) -> i = 0 OR x.start > get(rs, i - 1).end), x -> x.start)").alias("start"),
            F.expr(f"transform(filter(rs, (x, i) -> i = {last} OR get(rs, i + 1).start > x.end), x -> x.end)")
            .alias("end")).cast(STARTS).alias("spans")))


def suffix_dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: (key, n_bytes, spans, kept binary, sha binary).

    ``spans`` are the byte ranges [start, end) of the text in UTF-8 that are covered by strings of 200 bytes which also
    start anywhere else, in the same text or another, judged on the input; ``kept`` is what is left, which need not be
    valid UTF-8. A null text is empty; texts under 200 bytes keep everything. Equal texts all lose what they share.
    """
    ship(df.sparkSession)
    ranges = staged(repeated_ranges(df, text))
    docs = df.select(quoted(key).alias("key"), text_of(text).alias("text")).withColumn(
        "sha", F.unhex(F.sha2("text", 256)))
    marked = sieved(docs, first_bytes(), ranges, first_bytes())
    none = F.array().cast(STARTS)
    hits = marked.where("_hit").join(ranges.hint("merge"), "sha", "left").select(
        "key", F.col("text").cast("binary").alias("text"), F.coalesce("spans", none).alias("spans"), "sha")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(body)]
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(b) for b in batch.column(1).to_pylist()], pa.int64()), batch.column(2),
             pa.array(kept, pa.binary()), batch.column(3)], ["key", "n_bytes", "spans", "kept", "sha"])

    kind = docs.schema["key"].dataType.simpleString()
    cleaned = map_rows(hits, rows, f"key {kind}, n_bytes bigint, spans {STARTS}, kept binary, sha binary")
    clean = marked.where("NOT _hit").select(
        "key", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("spans"),
        F.col("text").cast("binary").alias("kept"), "sha")
    return cleaned.unionByName(clean).withColumnRenamed("key", key)
