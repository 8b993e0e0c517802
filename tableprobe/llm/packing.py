"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces, and only pieces shorter than a sequence need packing. They are dealt into shards of a few
thousand. For each shard several islands evolve packings, starting from best-fit decreasing: crossover injects whole
well-filled bins of one parent into another, bins that would hold a piece twice are dissolved, and what they held is
placed by best fit. Between rounds islands of a shard exchange their elite. An island stops early only when it needs
no more bins than the pieces' total length proves necessary. Bins that stay loose are dissolved once and packed anew
with those of other shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.bpe import SPACE, byte_alphabet, read_tokenizer, slices
from tableprobe.llm.common import map_rows, ship, staged, text_of

CAPACITY = 1024
END_ID = 2
SHARD_PIECES = 4096
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2, 2, 12, 5
LOOSE = 0.97  # bins filled less than this are packed once more, together with other shards'

# Fixed value: the words of byte-level vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# tiktoken backtracks through white space and gives up on about a million characters; runs from here on are cut out.
LONG_RUN = 100_000
RUN = regex.compile(rf"(?<![{SPACE}])[{SPACE}]{{{LONG_RUN},}}+")

_tokenizers: dict[int, tiktoken.Encoding] = {}


def tokenizer_of(content: bytes) -> tiktoken.Encoding:
    """A byte-level tokenizer file (ids in the order of its merges) as an encoding, made once in a worker."""
    key = zlib.crc32(content)
    if key not in _tokenizers:
        spec = json.loads(content)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        _tokenizers[key] = tiktoken.Encoding(
            "file", pat_str=WORDS, mergeable_ranks=ranks,
            special_tokens={t["content"]: t["id"] for t in spec.get("added_tokens", [])})
    return _tokenizers[key]


def encode_text(own: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text, special tokens as their own; white space may be of any length.

    A run of white space is one word up to the character that the next word may begin with, or up to the end of its
    stretch; no word before it reaches into it. So a long run is taken out and its word encoded without the pattern.
    """
    if len(text) < LONG_RUN or not RUN.search(text):
        return own.encode(text, allowed_special="all")
    special = own.special_tokens_set
    stretches = regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if special else [text]
    ids = []
    for stretch in stretches:
        if stretch in special:
            ids += own.encode(stretch, allowed_special="all")
            continue
        done = 0
        for run in RUN.finditer(stretch):
            end = run.end() - (run.end() < len(stretch))
            ids += own.encode_ordinary(stretch[done:run.start()])
            ids += own._encode_single_piece(stretch[run.start():end])
            done = end
        ids += own.encode_ordinary(stretch[done:])
    return ids


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but the first, which may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


def pieces_of(df: DataFrame, tokenizer: str, text: str, key: str, capacity: int, end_id: int,
              keep_ids: bool) -> DataFrame:
    """(row, key, piece, start, length, ids_crc32[, ids]) of every document, ``end_id`` included."""
    content = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    plain = df.select(F.monotonically_increasing_id().alias("row"), quoted(key).alias("key"),
                      text_of(text).alias("text"))
    names = ["row", "key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = tokenizer_of(content.value)
        found, source, cells = [], [], []
        at = 0
        for part in slices(batch.column(2).to_pylist()):
            for value in part:
                ids = np.array([*encode_text(own, value), end_id], np.uint32)
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own_ids = ids[start:start + length]
                    found.append((piece, start, length, zlib.crc32(own_ids.tobytes())))
                    source.append(at)
                    if keep_ids:
                        cells.append(own_ids.view(np.int32))
                at += 1
        take = pa.array(source, pa.int64())
        piece, start, length, crc = zip(*found)
        arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()),
                  pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(
            arrays + ([pa.array(cells, pa.list_(pa.int32()))] if keep_ids else []), names)

    kind = plain.schema["key"].dataType.simpleString()
    schema = f"row bigint, key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return staged(map_rows(plain, rows, schema + ", ids array<int>" * keep_ids))


class Packing:
    """Bins of piece numbers with their room; the chromosome whose genes are whole bins."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def copy_bins(self, chosen: list[list[int]]) -> None:
        for pieces in chosen:
            self.bins.append(pieces)
            self.room.append(self.capacity - sum(self.sizes[p] for p in pieces))

    def best_fit(self, pieces: list[int]) -> None:
        """Put each piece, in the order given, where it leaves the least room; open a bin if it fits nowhere."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_rooms = 0  # bit r is set if some bin has room r
        for number, room in enumerate(self.room):
            by_room[room].append(number)
            open_rooms |= 1 << room
        touched = set()
        for p in pieces:
            size = self.sizes[p]
            fitting = open_rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                number = by_room[room].pop()
                if not by_room[room]:
                    open_rooms ^= 1 << room
            else:
                room, number = self.capacity, len(self.bins)
                self.bins.append([])
                self.room.append(room)
                touched.add(number)
            if number not in touched:
                self.bins[number] = list(self.bins[number])  # bins are shared between chromosomes until changed
                touched.add(number)
            self.bins[number].append(p)
            self.room[number] = left = room - size
            by_room[left].append(number)
            open_rooms |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the mean of squared fill, which prefers full bins beside nearly empty ones."""
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.room)


def crossover(host: Packing, donor: Packing, rng: np.random.Generator) -> Packing:
    """A child of the host with some of the donor's best-filled bins in it."""
    order = np.argsort(donor.room, kind="stable")[:max(1, len(donor.bins) // 2)]
    injected = [donor.bins[i] for i in order[rng.random(len(order)) < rng.uniform(0.2, 0.6)]] or [donor.bins[order[0]]]
    taken = {p for pieces in injected for p in pieces}
    child = Packing(host.sizes, host.capacity)
    child.copy_bins(injected)
    room = np.array(host.room)
    limit = np.quantile(room, 0.97) if rng.random() < 0.7 else host.capacity + 1  # mutation: loosest bins go too
    kept, displaced = [], []
    for pieces, left in zip(host.bins, host.room):
        if left >= max(1, limit) or not taken.isdisjoint(pieces):
            displaced += [p for p in pieces if p not in taken]
        else:
            kept.append(pieces)
    child.copy_bins(kept)
    child.best_fit(sorted(displaced, key=host.sizes.__getitem__, reverse=True))
    return child


def packed(sizes: list[int], capacity: int, order: np.ndarray) -> Packing:
    result = Packing(sizes, capacity)
    result.best_fit(order.tolist())
    return result


def of_bins(sizes: list[int], capacity: int, numbers: np.ndarray) -> Packing:
    """The packing that an array of bin numbers describes."""
    order = np.argsort(numbers, kind="stable")
    result = Packing(sizes, capacity)
    result.copy_bins([g.tolist() for g in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)])
    return result


def evolve(sizes: np.ndarray, elite: list[np.ndarray], capacity: int, seed: int) -> np.ndarray:
    """Bin numbers of the best packing after some generations, from given elite or from best-fit decreasing."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    own = sizes.tolist()
    population = [of_bins(own, capacity, e) for e in elite] or [
        packed(own, capacity, np.argsort(-sizes, kind="stable"))]
    best = max(population, key=Packing.fitness)
    if len(best.bins) > least:
        while len(population) < POPULATION:
            noise = sizes * rng.uniform(0.8, 1.2, len(sizes))
            population.append(packed(own, capacity, np.argsort(-noise, kind="stable")))
        for _ in range(GENERATIONS):
            population.sort(key=Packing.fitness, reverse=True)
            best = population[0]
            if len(best.bins) <= least:
                break
            pairs = [rng.choice(POPULATION, 2, replace=False) for _ in range(2)]
            population[-2:] = [crossover(population[min(p)], population[max(p)], rng) for p in pairs]
        best = max(population, key=Packing.fitness)
    numbers = np.empty(len(sizes), np.int64)
    for number, pieces in enumerate(best.bins):
        numbers[pieces] = number
    return numbers


def pack_shards(pieces: DataFrame, capacity: int) -> DataFrame:
    """(shard, bin, room, row, piece, offset) for pieces (row, piece, length) shorter than a sequence."""
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    schema = ("shard int, island int, rows array<bigint>, pieces array<int>, sizes array<int>, bins array<int>, "
              "used int, fill double")

    def state(shard: int, island: int, rows: list, pieces: list, sizes: np.ndarray, bins: np.ndarray) -> dict:
        fill = np.bincount(bins, weights=sizes)
        return {"shard": shard, "island": island, "rows": rows, "pieces": pieces, "sizes": sizes, "bins": bins,
                "used": len(fill), "fill": float((fill ** 2).sum())}

    kinds = pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("rows", pa.list_(pa.int64())),
                       ("pieces", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
                       ("bins", pa.list_(pa.int32())), ("used", pa.int32()), ("fill", pa.float64())])

    def begin(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("piece", "ascending")])
        shard, island = (k.as_py() for k in key)
        sizes = group.column("length").to_numpy().astype(np.int64)
        bins = evolve(sizes, [], capacity, shard * ISLANDS + island)
        return pa.Table.from_pylist([state(shard, island, group.column("row").to_pylist(),
                                           group.column("piece").to_pylist(), sizes, bins)], kinds)

    def further(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                bins = evolve(sizes, [np.array(r["bins"]), np.array(r["migrant"])], capacity,
                              7919 * (r["shard"] + 1) + r["island"])
                yield from pa.Table.from_pylist([state(r["shard"], r["island"], r["rows"], r["pieces"], sizes, bins)],
                                                kinds).to_batches()

    islands = staged(
        pieces.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), shards).cast("int").alias("shard"),
                      F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
        .groupBy("shard", "island").applyInArrow(begin, schema))
    for _ in range(ROUNDS - 1):
        migrants = islands.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"),
                                  F.col("bins").alias("migrant"))
        islands = staged(islands.join(migrants, ["shard", "island"]).mapInArrow(further, schema))
    best = islands.groupBy("shard").agg(F.min(F.struct("used", -F.col("fill"), "island")).alias("b"))
    chosen = islands.join(best.select("shard", F.col("b.island").alias("island")), ["shard", "island"])

    def lay_out(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for r in batch.to_pylist():
                bins, sizes = np.array(r["bins"]), np.array(r["sizes"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.searchsorted(bins[order], bins[order])
                offset = ends - sizes[order] - (ends[first] - sizes[order][first])
                room = capacity - np.bincount(bins, weights=sizes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(bins), r["shard"], np.int32)), pa.array(bins[order].astype(np.int32)),
                    pa.array(room[bins[order]]), pa.array(np.array(r["rows"], np.int64)[order]),
                    pa.array(np.array(r["pieces"], np.int32)[order]), pa.array(offset)],
                    ["shard", "bin", "room", "row", "piece", "offset"])

    return staged(chosen.select("shard", "rows", "pieces", "sizes", "bins").mapInArrow(
        lay_out, "shard int, bin int, room bigint, row bigint, piece int, offset bigint"))


def pack_documents(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
                   end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (key, piece, start, length, ids_crc32, sequence_id, offset), and ``ids`` if asked for.

    A document is the ids of its text (a null text is empty) and ``end_id``. Longer ones than ``capacity`` are cut, so
    that all pieces but the first are full. Within a sequence the pieces lie one after another from offset 0. Keys may
    repeat or be null: every row is a document of its own. No rows give no pieces.
    """
    ship(df.sparkSession)
    pieces = pieces_of(df, tokenizer, text, key, capacity, end_id, keep_ids)
    short = pieces.where(F.col("length") < capacity).select("row", "piece", "length")
    first = pack_shards(short, capacity)
    loose = (F.col("room") > int(capacity * (1 - LOOSE)))
    again = pack_shards(first.where(loose).select("row", "piece").join(short, ["row", "piece"]), capacity)

    def numbered(level: int, placed: DataFrame) -> DataFrame:
        number = (F.col("shard").cast("bigint") * SHARD_PIECES * 4 + F.col("bin")) * 2 + level
        return placed.select("row", "piece", number.alias("sequence_id"), "offset")

    places = numbered(0, first.where(~loose)).unionByName(numbered(1, again))
    rest = pieces.columns[2:]
    full = pieces.where(F.col("length") == capacity).select(
        "key", *rest, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    packed_ones = pieces.where(F.col("length") < capacity).join(places, ["row", "piece"]).select(
        "key", *rest, "sequence_id", "offset")
    return full.unionByName(packed_ones).withColumnRenamed("key", key)
