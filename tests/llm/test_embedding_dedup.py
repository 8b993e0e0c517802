import numpy as np
import pytest

from tableprobe.llm import embedding_dedup
from tableprobe.llm.embedding_dedup import embedding_groups
from tests.llm import cases

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, id string, unit string"


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for cluster in range(6):
        center = rng.normal(size=16)
        for i in range(12):
            noise = rng.normal(size=16) * (0.02 * (i % 6))
            rows.append((cluster * 20 + i, (center + noise * np.linalg.norm(center) / 4).tolist(), cluster % 2))
    copy = rows[0][1]
    rows += [(500 + i, copy, 0) for i in range(5)] + [(510, copy, 1), (511, copy, None), (512, [2 * v for v in copy], 0)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None] * 16, 0), (604, [], 0),
             (605, [float("inf")] + [0.0] * 15, 0), (606, [1.0, 2.0], 0), (607, [1.0, 2.01], 0), (None, copy, 0),
             (608, [1e30] + [0.0] * 15, 0), (609, [1e-30] + [0.0] * 15, 0), (700, copy, 0), (700, copy, 0)]
    return rows


def plain(rows, cosine):
    def usable(v, label):
        return v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = np.zeros((n, n), bool)
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a == b and usable(v, a) and usable(w, b) and len(v) == len(w):
                x, y = (np.array(u, np.float32).astype(float) for u in (v, w))
                links[i, j] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine
    label = cases.components(range(n), lambda i, j: links[i, j])
    lowest = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            lowest[label[i]] = min(lowest.get(label[i], key), key)
    return sorted((str(key), int(links[i].sum()), str(lowest.get(label[i])), key is not None and key == lowest.get(label[i]))
                  for i, (key, _, _) in enumerate(rows))


@pytest.mark.parametrize("block, cosine", [(1024, 0.98), (8, 0.98), (1024, 0.9)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block, cosine):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    found = embedding_groups(df, cosine=cosine).collect()
    expected = plain(rows, cosine)
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in found) == expected
    assert sum(e[1] for e in expected) > 100


def test_no_rows(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("cuts", [0, 3, 9])
def test_every_pair_in_budget_shares_the_cell_of_its_midpoint(cuts):
    own = embedding_dedup.Subspaces.of(64, 0.98)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 64))
    y = x + rng.normal(size=(300, 64)) * 0.02
    p, q = own.coordinates(x), own.coordinates(y)
    for block, (a, b) in enumerate(own.blocks):
        posts = [set(zip(*(v.tolist() for v in own.posts(c, block, cuts)))) for c in (p, q)]
        near = np.flatnonzero(((p[:, a:b] - q[:, a:b]) ** 2).sum(axis=1) <= own.budgets[block])
        middle = ((p + q)[:, a:a + cuts] > 0) @ (1 << np.arange(cuts))
        assert len(near) and all((int(i), int(middle[i])) in posts[0] & posts[1] for i in near)


def test_a_linked_pair_is_in_budget_in_some_block():
    own = embedding_dedup.Subspaces.of(64, 0.98)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = 0.98 * x + (1 - 0.98 ** 2) ** 0.5 * away  # at the very limit
    p, q = own.coordinates(x), own.coordinates(y)
    assert own.found_before(np.concatenate([p, q]), np.arange(4000), np.arange(4000, 8000), len(own.blocks)).all()


def test_sweep_finds_all_pairs_of_a_cell(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PAIRS", 500)
    own = embedding_dedup.Subspaces.of(64, 0.8)
    q = own.coordinates(np.random.default_rng(3).normal(size=(400, 64)))
    apart = np.arange(400) % 3
    for block, (a, b) in enumerate(own.blocks[:2]):
        x = q[:, a:b]
        gap = ((x[:, None] - x[None]) ** 2).sum(-1)
        middle = ((x[:, None, :2] + x[None, :, :2]) > 0) @ np.array([1, 2])
        for cell in range(4):
            expected = {(i, j) for i, j in zip(*np.nonzero((gap <= own.budgets[block]) & (middle == cell))) if i < j}
            found = [tuple(sorted(p)) for i, j, _ in own.near(x, block, 2, cell) for p in zip(i.tolist(), j.tolist())]
            assert len(found) == len(set(found)) and set(found) == expected and expected
            found = {tuple(sorted(p)) for i, j, _ in own.near(x, block, 2, cell, apart) for p in zip(i.tolist(), j.tolist())}
            assert found == {(i, j) for i, j in expected if apart[i] != apart[j]}


def test_the_share_of_pairs_compared_falls():
    """Random vectors of one label: the share of all pairs that any cell compares, by the size of the table."""
    own, shares, bytes_posted = embedding_dedup.Subspaces.of(64, 0.98), [], 0
    for n in (2000, 8000, 32000):
        q = own.coordinates(np.random.default_rng(n).normal(size=(n, 64)))
        compared = bytes_posted = 0
        for block, (a, b) in enumerate(own.blocks):
            cuts = own.cuts(block, n)
            rows, cells = own.posts(q, block, cuts)
            bytes_posted += len(rows) * (8 + 2 * (b - a))
            for cell in np.unique(cells)[::7]:
                compared += 7 * sum(c for *_, c in own.near(q[rows[cells == cell], a:b], block, cuts, int(cell)))
        shares.append(compared / (n * (n - 1) / 2))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.2, shares
    assert bytes_posted < 6 * n * 64 * 4, bytes_posted / (n * 64 * 4)
