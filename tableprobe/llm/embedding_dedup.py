"""Embedding near-duplicates by a pigeonhole join over subspaces.

Unit vectors within distance t are, after any rotation, within t * sqrt(k / d) in at least one of their blocks of k
dimensions: were every block over its share of the squared distance, the sum would be over the whole. So each block is
range-joined under its own budget. Its coordinates, as whole numbers, are cut at zero in as many dimensions as the number
of vectors calls for; a vector is posted to every cell that the ball of half the budget around it touches, and two
vectors in budget share the cell of their midpoint.

Cells first see only ids and the block's coordinates, and say who has a partner in budget there. These few vectors are
then fetched, compared in the same cells, taken in the first block that finds them, and verified by their exact cosine.
No pair leaves a task: a cell returns numbers of links and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import join_groups, map_rows, ship, staged
from tableprobe.llm.graph import components, roots
from tableprobe.llm.simhash import group_ends

COSINE = 0.98
BLOCK_DIMENSIONS = 32 / 3
CELL = 64  # vectors of one label a cell should hold, before those that are posted to it from its neighbours
BLOCK = 4096  # vectors of one cell compared in one go; fuller cells are compared block by block
POSTED = 4096  # vectors whose postings are put together, cell by cell
PAIRS = 1 << 18  # pairs compared at once
SMALL = 100_000  # cells over BLOCK, up to which their sizes are broadcast
UNITS = 16000  # coordinates of unit vectors are rounded to 1 / UNITS
SLACK = 1e-9  # relative, for rounding in rotations; candidates are verified, so it costs nothing


class Subspaces:
    """The rotation of a dimension, its blocks, and each block's budget for a least cosine, in squared units."""

    _made: dict[tuple[int, float], "Subspaces"] = {}

    def __init__(self, dimension: int, cosine: float):
        gaussian = np.random.default_rng(7).normal(size=(dimension, dimension))
        self.rotation = np.linalg.qr(gaussian)[0]
        parts = max(1, round(dimension / BLOCK_DIMENSIONS))
        bounds = [dimension * i // parts for i in range(parts + 1)]
        self.blocks = list(zip(bounds, bounds[1:]))
        squared = max(0.0, 2 - 2 * cosine) * (1 + SLACK) + SLACK
        # rounding moves each coordinate of a difference by one at most
        self.budgets = [int(((squared * (b - a) / dimension) ** 0.5 * UNITS + (b - a) ** 0.5) ** 2) + 1
                        for a, b in self.blocks]

    @classmethod
    def of(cls, dimension: int, cosine: float) -> "Subspaces":
        if (dimension, cosine) not in cls._made:
            cls._made[dimension, cosine] = cls(dimension, cosine)
        return cls._made[dimension, cosine]

    def coordinates(self, raw: np.ndarray) -> np.ndarray:
        """Rotated unit vectors in whole units; row by row the same, whatever other rows are there."""
        unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
        return np.rint(np.einsum("ij,jk->ik", unit, self.rotation) * UNITS).astype(np.int64)

    def cuts(self, block: int, n: int) -> int:
        """How many dimensions of a block are cut for ``n`` vectors; one is left to sweep along."""
        a, b = self.blocks[block]
        return min(b - a - 1, max(0, int(np.ceil(np.log2(max(1, n) / CELL)))))

    def posts(self, q: np.ndarray, block: int, cuts: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells of a block that the ball of half the budget around a row touches."""
        x = q[:, self.blocks[block][0]:][:, :cuts]
        rows, used = np.arange(len(x)), np.zeros(len(x), np.int64)
        cells = (x > 0) @ (1 << np.arange(cuts))
        for k in range(cuts):
            more = used + 4 * x[rows, k] ** 2
            near = more <= self.budgets[block]
            rows, cells, used = (np.concatenate([old, new[near]]) for old, new in (
                (rows, rows), (cells, cells ^ (1 << k)), (used, more)))
        return rows, cells

    def near(self, x: np.ndarray, block: int, cuts: int, cell: int,
             apart: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Pairs (i, j) of a cell's vectors whose block is in budget and whose midpoint is in the cell, and how many
        were compared. ``x`` has the block's coordinates. With ``apart``, only pairs of different values of it.

        Vectors are sorted along a dimension that isn't cut, and compared with those within the budget there.
        """
        budget = self.budgets[block]
        order = np.argsort(x[:, cuts], kind="stable")
        x = x[order].astype(np.int64)
        along = x[:, cuts]
        ahead = np.searchsorted(along, along + int(budget ** 0.5) + 1, "right") - np.arange(1, len(x) + 1)
        total = np.cumsum(ahead)
        start = 0
        while start < len(x):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")))
            counts = ahead[start:stop]
            i = np.repeat(np.arange(start, stop), counts)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
            compared = len(i)
            gap = np.zeros(len(i), np.int64)
            for k in range(x.shape[1]):
                gap += (x[i, k] - x[j, k]) ** 2
                if k % 3 == 2:
                    keep = gap <= budget
                    i, j, gap = i[keep], j[keep], gap[keep]
            middle = (x[i, :cuts] + x[j, :cuts] > 0) @ (1 << np.arange(cuts))
            keep = (gap <= budget) & (middle == cell)
            i, j = order[i[keep]], order[j[keep]]
            if apart is not None:
                keep = apart[i] != apart[j]
                i, j = i[keep], j[keep]
            yield i, j, compared
            start = stop

    def found_before(self, q: np.ndarray, i: np.ndarray, j: np.ndarray, block: int) -> np.ndarray:
        """Whether an earlier block has the pair in budget."""
        found = np.zeros(len(i), bool)
        for earlier in range(block):
            a, b = self.blocks[earlier]
            found |= ((q[i, a:b] - q[j, a:b]) ** 2).sum(axis=1) <= self.budgets[earlier]
        return found


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that nothing overflows; no digit changes."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _scaled(values.reshape(len(column), -1))


def usable_vector(embedding: str, label: str) -> Column:
    """Labelled, no null or non-finite component, and not zero."""
    vector = quoted(embedding)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(quoted(label).isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


UNIT = ["group", "unit", "i", "j"]
POSTING = "group bigint, unit bigint, dim int, cuts int, n int, ids binary, coordinates binary"
PARTNER = "group bigint, unit bigint, i int, j int, dim int, cuts int, own int, id bigint"
CELL_BITS = 40  # a unit's number is that of its block, then of its cell


def _postings(members: DataFrame, cosine: float) -> DataFrame:
    """For each task and cell the ids posted to it, with their coordinates in the cell's block."""
    def post(batch: pa.RecordBatch) -> pa.Table:
        ids, groups, counts = (batch.column(c).to_numpy() for c in ("id", "group", "members"))
        dims, out = batch.column("dim").to_numpy(), []
        for dim in np.unique(dims).tolist():
            own = Subspaces.of(dim, cosine)
            at = np.flatnonzero(dims == dim)
            q = own.coordinates(_matrix(batch.column("vector").take(pa.array(at))))
            for block, (a, b) in enumerate(own.blocks):
                cuts = np.array([own.cuts(block, n) for n in counts[at].tolist()])
                for cut in np.unique(cuts).tolist():
                    rows = np.flatnonzero(cuts == cut)
                    row, cell = own.posts(q[rows], block, cut)
                    row = rows[row]
                    order = np.lexsort((cell, groups[at[row]]))
                    row, cell = row[order], cell[order]
                    group = groups[at[row]]
                    starts = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(cell) != 0)))
                    sizes = np.diff(np.append(starts, len(row)))
                    named = np.ascontiguousarray(ids[at[row]].astype(np.int64)).tobytes()
                    placed = np.ascontiguousarray(q[row, a:b].astype(np.int16)).tobytes()
                    n, wide = len(starts), 2 * (b - a)
                    out.append(pa.RecordBatch.from_arrays(
                        [pa.array(group[starts]), pa.array(cell[starts] | block << CELL_BITS),
                         pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, cut, np.int32)),
                         pa.array(sizes.astype(np.int32)),
                         pa.array([named[8 * s:8 * (s + k)] for s, k in zip(starts, sizes)], pa.binary()),
                         pa.array([placed[wide * s:wide * (s + k)] for s, k in zip(starts, sizes)], pa.binary())],
                        ["group", "unit", "dim", "cuts", "n", "ids", "coordinates"]))
        return pa.Table.from_batches(out)

    return map_rows(members.select("id", "group", "members", "dim", "vector"), post, POSTING, rows=POSTED)


def _split(postings: DataFrame) -> DataFrame:
    """Add (own, i, j) and deal by unit: cells of over BLOCK members are cut into blocks, and every two meet."""
    sizes = postings.groupBy("group", "unit").agg(F.sum("n").alias("size")).where(F.col("size") > BLOCK)
    large = staged(sizes.select("group", "unit", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    few = large.count() <= SMALL
    blocks = F.coalesce("blocks", F.lit(1))
    return (postings.join(F.broadcast(large) if few else large.hint("merge"), ["group", "unit"], "left")
            .withColumn("own", F.pmod(F.xxhash64("ids"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select(*postings.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
            .repartition(*UNIT).sortWithinPartitions(*UNIT))


def _units(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit, from batches sorted by unit."""
    held: list[pa.Table] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        ends = group_ends(*(batch.column(c).to_numpy() for c in UNIT))
        start = 0
        while start < batch.num_rows:
            end = int(ends[start])
            part = pa.Table.from_batches([batch.slice(start, end - start)])
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in UNIT):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
            start = end
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _unit_of(rows: pa.Table, cosine: float) -> tuple[Subspaces, int, int, int, np.ndarray | None]:
    """(subspaces, block, cuts, cell, what tells two blocks of a full cell apart)."""
    unit, i, j, dim, cuts = (rows.column(c)[0].as_py() for c in ("unit", "i", "j", "dim", "cuts"))
    apart = rows.column("own").to_numpy() if i != j else None
    return Subspaces.of(dim, cosine), unit >> CELL_BITS, cuts, unit & (1 << CELL_BITS) - 1, apart


def _partners(stream: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Per unit the ids that have a partner in budget there."""
    names = [f.split()[0] for f in PARTNER.split(", ")]
    for rows in _units(stream):
        if sum(rows.column("n").to_pylist()) < 2:
            continue
        own, block, cuts, cell, apart = _unit_of(rows, cosine)
        a, b = own.blocks[block]
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), np.int64)
        x = np.frombuffer(b"".join(rows.column("coordinates").to_pylist()), np.int16).reshape(-1, b - a)
        blocks = np.repeat(rows.column("own").to_numpy(), rows.column("n").to_numpy())
        has = np.zeros(len(ids), bool)
        for i, j, _ in own.near(x, block, cuts, cell, blocks if apart is not None else None):
            has[i] = has[j] = True
        if has.any():
            first = [rows.column(c)[0].as_py() for c in names[:6]]
            n = int(has.sum())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v] * n, t) for v, t in zip(first, [pa.int64()] * 2 + [pa.int32()] * 4)),
                 pa.array(blocks[has].astype(np.int32)), pa.array(ids[has])], names)


def _links(stream: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Of each unit, for every vector with a link that is the unit's to report: (id, root in the unit, its links)."""
    for rows in _units(stream):
        own, block, cuts, cell, apart = _unit_of(rows, cosine)
        raw = _matrix(rows.column("vector").combine_chunks())
        ids, weight = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        q = own.coordinates(raw)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j, _ in own.near(q[:, slice(*own.blocks[block])], block, cuts, cell, apart):
            new = ~own.found_before(q, i, j, block)
            i, j = i[new], j[new]
            linked = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= cosine
            i, j = i[linked], j[linked]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            label = roots(len(label), np.concatenate([i, np.arange(len(label))]), np.concatenate([j, label]))
        on = np.flatnonzero(links)
        if len(on):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[on]), pa.array(ids[label[on]]), pa.array(links[on])], ["a", "b", "links"])


def embedding_groups(df: DataFrame, embedding: str = "embedding", label: str = "label", key: str = "vec_id",
                     cosine: float = COSINE) -> DataFrame:
    """One row per row of ``df``: (key, n_links, component_id, kept).

    Vectors of equal label (and length) are linked if their cosine is at least ``cosine``. Those that are null, empty,
    zero, unlabelled or hold a null, NaN or infinite component link with nothing. ``n_links`` counts other rows, equal
    vectors included; ``component_id`` is the smallest key reachable (null keys don't count); ``kept`` says that the
    two keys agree. Equal vectors are compared once, with their number as weight. No rows give no rows.
    """
    ship(df.sparkSession)
    rows = staged(df.select(quoted(key).alias("key"), quoted(label).alias("label"),
                            quoted(embedding).alias("vector"), usable_vector(embedding, label).alias("usable")))
    usable = rows.where("usable").select("key", "label", "vector")
    classes = staged(usable.groupBy("label", "vector").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
                     .withColumn("id", F.monotonically_increasing_id()))
    sized = classes.select("id", "n", "label", "vector", F.size("vector").alias("dim"))
    of_label = staged(sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("members"))
                      .withColumn("group", F.monotonically_increasing_id()))
    members = staged(join_groups(sized, of_label, ["label", "dim"], "members", classes.count())
                     .select("id", "n", "group", "members", "dim", "vector"))
    cells = _split(_postings(members, cosine))
    partners = staged(cells.mapInArrow(lambda stream: _partners(stream, cosine), PARTNER))
    fetched = (partners.hint("merge").join(members.select("id", "n", "vector"), "id")
               .repartition(*UNIT).sortWithinPartitions(*UNIT))
    found = staged(fetched.select(*UNIT, "dim", "cuts", "own", "id", "n", "vector").mapInArrow(
        lambda stream: _links(stream, cosine), "a bigint, b bigint, links bigint"))

    linked = found.groupBy("a").agg(F.sum("links").alias("links"))
    whole = components(found.select("a", "b"))
    named = (classes.select("id", "first", "n", "label", "vector")
             .join(linked.withColumnRenamed("a", "id"), "id", "left")
             .join(whole.withColumnRenamed("node", "id"), "id", "left")
             .select("label", "vector", "first", "n", F.coalesce("component", "id").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    result = staged(named.join(lowest, "root").select("label", "vector", "n", "n_links", "component_id"))
    joined = join_groups(usable, result, ["label", "vector"], "n", rows.count())
    alone = rows.where("NOT usable").select(
        "key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    return joined.select("key", "n_links", "component_id").unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
