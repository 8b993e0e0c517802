import math

import numpy as np
import pytest

from tableprobe.llm import queries
from tableprobe.llm.whitening import polar, spectrum, whiten
from tests.llm import cases

KINDS = {
    "random": lambda rng, n: np.cov(rng.normal(size=(n, 3 * n))),
    "graded": lambda rng, n: _of(rng, 10.0 ** -np.arange(n)),
    "clusters": lambda rng, n: _of(rng, np.repeat([5.0, 1.0, 1.0 + 1e-9], -(-n // 3))[:n]),
    "few": lambda rng, n: np.cov(rng.normal(size=(n, n // 2 + 1))),
    "diagonal": lambda rng, n: np.diag(rng.integers(1, 6, n).astype(float)),
    "equal": lambda rng, n: 7.0 * np.eye(n),
    "ones": lambda rng, n: np.ones((n, n)),
    "zero": lambda rng, n: np.zeros((n, n)),
    "swap": lambda rng, n: np.eye(n)[::-1],
}


def _of(rng, values):
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    return q * values @ q.T


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [2, 3, 17, 64])
def test_spectrum(kind, n):
    v = KINDS[kind](np.random.default_rng(n), n)
    v = (v + v.T) / 2
    values, vectors = spectrum(v)
    size = max(np.linalg.norm(v), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.linalg.norm(vectors.T @ v @ vectors - np.diag(values)) < 1e-13 * n * size
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() < 1e-14 * n * size
    assert (np.diff(values) <= 0).all()


def test_polar_factor_has_the_signs():
    rng = np.random.default_rng(1)
    a = _of(rng, np.array([3.0, 1e-7, -1e-7, -2.0, 5.0]))
    values, vectors = np.linalg.eigh(a)
    assert np.abs(polar(a) - vectors * np.sign(values) @ vectors.T).max() < 1e-7


def plain(vectors, components=32):
    """n, deviations, whitened rows and shares, from exact sums and LAPACK."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    covariance = centred.T @ centred / n
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1], found[:, ::-1]
    count = min(components, int((values > 1e-11 * values[0]).sum())) if values[0] > 0 else 0
    return n, deviation, centred @ found[:, :count] / np.sqrt(values[:count]), values[:count] / np.trace(covariance)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows],
                                 "vec_id bigint, embedding array<float>, whitened string, key string").repartition(3)


def check(result, vectors):
    n, deviation, whitened, shares = plain(vectors)
    rows = sorted(result.collect(), key=lambda r: r["vec_id"])
    assert [r["n"] for r in rows] == [n] * len(vectors) and [r["deviation"] for r in rows] == deviation
    got = np.array([r["whitened"] for r in rows])
    assert got.shape == whitened.shape
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * signs).max(initial=0) < 1e-7
    assert np.allclose(rows[0]["explained"], shares, rtol=1e-8)
    assert all(r["identity_error"] < 1e-8 for r in rows)


def test_whitened_rows(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(60, 5)) * [9, 4, 2, 1, 0.3]]
    rows = [*enumerate(vectors), (60, vectors[7]), (61, vectors[7])]
    unusable = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5),
                (104, [1.0, 2.0]), (105, [])]
    result = whiten(frame(spark, rows + unusable))
    assert result.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    check(result, [v for _, v in rows])


def test_edges(spark):
    assert whiten(frame(spark, [])).count() == 0
    one = whiten(frame(spark, [(None, [1.0, -2.0])])).first()
    assert one.asDict() == {"vec_id": None, "n": 1, "deviation": 0, "whitened": [], "explained": [], "identity_error": 0.0}
    same = whiten(frame(spark, [(i, [0.5, 0.5]) for i in range(9)])).collect()
    assert len(same) == 9 and all(r["whitened"] == [] and r["deviation"] == 0 for r in same)
    assert whiten(frame(spark, [(1, []), (2, [])])).first()["n"] == 2
    line = [[float(t), 2.0 * t, -float(t)] for t in range(8)]
    check(whiten(frame(spark, list(enumerate(line)))), line)
    huge = whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [3e8, 1.0])])).collect()
    assert all(len(r["whitened"]) == 1 and r["deviation"] is None for r in huge if r["vec_id"] < 3)
    big = [[3e8, 1.0], [-3e8, 2.0], [2e8, -5.0]]
    rows = sorted(whiten(frame(spark, list(enumerate(big)))).collect(), key=lambda r: r["vec_id"])
    assert [r["deviation"] for r in rows] == [d if d < 2 ** 63 else None for d in plain(big)[1]]


def test_query(spark):
    rows = queries.QUERIES["op11_whitening"](spark, cases.SF_DIR).collect()
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{cases.SF_DIR}/embeddings.parquet").collect()}
    ids = sorted(table)
    n, deviation, whitened, shares = plain([table[i] for i in ids])
    assert sorted((r["vec_id"], r["component"]) for r in rows) == [(i, c) for i in ids for c in range(1, 33)]
    got = np.zeros(whitened.shape)
    place = {i: p for p, i in enumerate(ids)}
    for r in rows:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[place[r["vec_id"]]]
        assert abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-8
    assert np.abs(np.abs(got) - np.abs(whitened)).max() < 1e-7
