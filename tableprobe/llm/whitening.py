"""Embedding whitening: principal components by spectral divide and conquer, then one broadcast projection.

Sums and second moments are gathered on Spark; the covariance, as wide as a vector, is taken apart on the driver. The
polar factor of the covariance minus a shift has the signs of the shifted eigenvalues, so it gives the projectors onto
the components above and below the shift. Each side is an invariant subspace, in which the smaller covariance is split
again, down to single components. The polar factor comes from QDWH, the dynamically weighted Halley iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import map_rows, ship, staged

SCALE, OFFSET = 64, 1_000_000  # an entry c is the whole number floor(64 c) + 1000000
LARGEST = 1 << 61  # entries beyond are taken for this
COMPONENTS = 32
EPS = np.finfo(float).eps
NOTHING = 1e-11  # components of less than this share of the largest variance can't be told from rounding


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH."""
    eye = np.eye(len(a))
    x = a / np.abs(a).sum(axis=0).max()
    try:
        least = 1 / np.abs(np.linalg.inv(x)).sum(axis=0).max()
    except np.linalg.LinAlgError:
        least = 0.0
    low = min(1.0, max(least if np.isfinite(least) else 0.0, EPS / 4))
    for _ in range(40):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        p = np.sqrt(1 + d) + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d)))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > 100:
            top, bottom = np.split(np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0], 2)
            x = q / r * x + (p - q / r) / np.sqrt(r) * top @ bottom.T
        else:
            x = q / r * x + (p - q / r) * np.linalg.solve(eye + r * x.T @ x, x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low ** 2) / (1 + r * low ** 2))
        if 1 - low <= 10 * EPS and np.linalg.norm(x - before) <= EPS ** (1 / 3):
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis of a projector's range: a random start, projected twice."""
    q = rng.normal(size=(len(projector), rank))
    for _ in range(3):
        q = np.linalg.qr(projector @ q)[0]
    return q


def _shifts(v: np.ndarray) -> Iterator[float]:
    """Shifts inside the spectrum: the widest gap of the middle half of the diagonal, then near the mean."""
    diagonal = np.sort(np.diag(v))
    n = len(v)
    inner = diagonal[n // 4:max(n // 4 + 2, n - n // 4)]
    at = int(np.argmax(np.diff(inner)))
    yield (inner[at] + inner[at + 1]) / 2
    mean = diagonal.mean()
    spread = np.linalg.norm(v - mean * np.eye(n)) / n ** 0.5
    yield from (mean + t * spread for t in (0, 0.07, -0.07, 0.21, -0.21, 0.43, -0.43, 0.77, -0.77))


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns (largest entry positive) of a symmetric matrix."""
    rng = np.random.default_rng(11)
    scale = np.linalg.norm(v)

    def split(part: np.ndarray) -> np.ndarray:
        n = len(part)
        eye = np.eye(n)
        if n == 1 or np.linalg.norm(part - np.trace(part) / n * eye) <= 2 * EPS * scale:
            return eye
        best = None
        for shift in _shifts(part):
            sign = polar(part - shift * eye)
            above = (sign + eye) / 2
            rank = round(np.trace(above)) if np.isfinite(sign).all() else 0
            if not 0 < rank < n:
                continue
            q = np.linalg.qr(np.hstack([_basis(above, rank, rng), _basis(eye - above, n - rank, rng)]))[0]
            turned = q.T @ part @ q
            left = np.linalg.norm(turned[:rank, rank:])
            if best is None or left < best[0]:
                best = left, rank, q, (turned + turned.T) / 2
            if left <= 4 * n * EPS * scale:
                break
        if best is None:
            return eye
        _, rank, q, turned = best
        return np.hstack([q[:, :rank] @ split(turned[:rank, :rank]), q[:, rank:] @ split(turned[rank:, rank:])])

    vectors = split((v + v.T) / 2)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    at = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.where(vectors[at, np.arange(len(at))] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """What is broadcast: the mean as whole parts and a rest, and the projection; ``explained`` by component."""

    n: int
    near: np.ndarray  # the means, rounded
    rest: tuple[int, ...]  # the sums minus n times that
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return (whole - self.near).astype(float) - np.array(self.rest, float) / max(1, self.n)

    def whitened(self, whole: np.ndarray) -> np.ndarray:
        """Row by row the same, whatever other rows are there."""
        return np.einsum("ij,jk->ik", self.centred(whole), self.projection)

    def deviations(self, whole: np.ndarray) -> list[int | None]:
        """Sums of the squares of n x - S, exact; None beyond 64 bits."""
        off = whole - self.near
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most ** 2 * max(1, off.shape[1]) < 1 << 63:
            off = off * self.n - np.array(self.rest, np.int64)
            return np.einsum("ij,ij->i", off, off).tolist()
        sums = ((off.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [int(s) if s < 1 << 63 else None for s in sums]


def whole_numbers(column: pa.ListArray, dimension: int) -> np.ndarray:
    """Vectors of doubles as rows of floor(64 c) + 1000000."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return np.clip(np.floor(np.clip(c, -LARGEST, LARGEST) * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def usable_vector(embedding: str) -> Column:
    """Not null, and every entry a finite number."""
    finite = F.forall(quoted(embedding), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def _sums(rows: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums. A task ships two halves of a sum per dimension."""
    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, halves = 0, np.zeros((2, dimension), np.int64)
        for batch in stream:
            whole = whole_numbers(batch.column(1), dimension)
            n += len(whole)
            halves += np.stack([(whole >> 32).sum(axis=0), (whole & 0xFFFFFFFF).sum(axis=0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dimension)), pa.array(np.full(dimension, n)), *map(pa.array, halves)],
            ["place", "n", "high", "low"])

    def total(name: str) -> Column:
        return F.sum(F.col(name).cast("decimal(20,0)")).alias(name)

    found = (rows.mapInArrow(add, "place bigint, n bigint, high bigint, low bigint").groupBy("place")
             .agg(total("n"), total("high"), total("low")).orderBy("place").collect())
    return int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def _covariance(rows: DataFrame, dimension: int, width: int, n: int,
                values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The covariance of ``values`` of the vectors, ``width`` wide. Tasks ship one row per dimension, added up as they
    come where the rows of a dimension meet."""
    size = width + 1

    def multiply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in stream:
            y = values(whole_numbers(batch.column(1), dimension))
            y = np.hstack([y, np.ones((len(y), 1))])
            total += y.T @ y
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["place", "row"])

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in stream:
            for place, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[place] = total.get(place, 0.0) + row.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], ["place", "row"])

    kind = "place bigint, row array<double>"
    found = rows.mapInArrow(multiply, kind).repartition("place").mapInArrow(add, kind).collect()
    moments = np.array([r["row"] for r in sorted(found, key=lambda r: r["place"])]) / n
    mean = moments[-1, :-1]
    return moments[:-1, :-1] - np.outer(mean, mean)


def _fit(rows: DataFrame, dimension: int, components: int) -> Whitening:
    n, sums = _sums(rows, dimension)
    near = [round(s / n) for s in sums]
    model = Whitening(n, np.array(near, np.int64), tuple(s - n * r for s, r in zip(sums, near)),
                      np.zeros((dimension, 0)), np.zeros(0))
    covariance = _covariance(rows, dimension, dimension, n, model.centred)
    values, vectors = spectrum(covariance)
    count = int((values > NOTHING * max(values[0], 0)).sum()) if values[0] > 0 else 0
    count = min(count, components)
    if not count:
        return model
    model = Whitening(n, model.near, model.rest, vectors[:, :count] / np.sqrt(values[:count]),
                      values[:count] / np.trace(covariance))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    found = _covariance(rows, dimension, count, n, lambda whole: shared.value.whitened(whole))
    return Whitening(n, model.near, model.rest, model.projection, model.explained,
                     float(np.abs(found - np.eye(count)).max()))


def whiten(df: DataFrame, embedding: str = "embedding", key: str = "vec_id",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable row: (key, n, deviation, whitened, explained, identity_error).

    An entry c counts as x = floor(64 c) + 1000000; all usable rows are fitted, repeated ones as often as they are
    there. ``whitened`` and ``explained`` hold a number per component, by falling variance, ``components`` at most;
    directions without variance are no components, so a single row, or rows that are all equal, have none.
    ``deviation`` is the sum of (n x - S)^2 over the entries, null beyond 64 bits. ``identity_error`` is measured on
    the whitened rows, 0 if they are empty.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out, and so are those of another length
    than most (of equally many the longer). Entries beyond 2^61 / 64 count as that. Keys may be null or repeat; other
    columns are left out. An empty table gives no rows.
    """
    ship(df.sparkSession)
    rows = staged(df.where(usable_vector(embedding)).select(
        quoted(key).alias("key"), quoted(embedding).cast("array<double>").alias("vector")))
    size = F.size("vector").alias("size")
    most = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    dimension = most["size"] if most else 0
    rows = rows.where(F.size("vector") == dimension)
    if dimension:
        model = _fit(rows, dimension, components)
    else:
        model = Whitening(most["count"] if most else 0, np.zeros(0, np.int64), (), np.zeros((0, 0)), np.zeros(0))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        whole = whole_numbers(batch.column(1), dimension) if dimension else np.zeros((batch.num_rows, 0), np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(own.deviations(whole), pa.int64()),
             pa.array(list(own.whitened(whole)), pa.list_(pa.float64()))], ["key", "deviation", "whitened"])

    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, project, f"key {kind}, deviation bigint, whitened array<double>").select(
        F.col("key").alias(key), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.lit(model.explained.tolist()).cast("array<double>").alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
