from collections import Counter

import numpy as np
import pytest

from tableprobe.llm import suffix_dedup
from tests.llm import cases

N = suffix_dedup.LENGTH


def times(bodies, weights=None):
    counts = Counter()
    for body, w in zip(bodies, weights if weights is not None else [1] * len(bodies)):
        for i in range(len(body) - N + 1):
            counts[body[i:i + N]] += w
    return counts


@pytest.mark.parametrize("shard", [1 << 17, 900])
def test_merged_transforms_find_the_repeated_windows(monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = np.random.default_rng(0)
    base = rng.integers(97, 101, 1500).astype(np.uint8).tobytes()
    bodies = [base[:500], base[100:600], b"a" * 420, base[90:400] + b"x" * 100 + base[700:1000], bytes(300), b"ab" * 150,
              base[300:500], base[1000:1300], base[1010:1350], rng.integers(0, 256, 260).astype(np.uint8).tobytes()]
    weights = np.array([1] * 9 + [2])
    counts = times(bodies, weights)
    for body, flags in zip(bodies, suffix_dedup.repeated_windows(bodies, weights)):
        assert flags.tolist() == [counts[body[i:i + N]] > 1 for i in range(len(body) - N + 1)]


def test_equal_windows_share_an_anchor_and_runs_cover_all_windows():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 2000).astype(np.uint8).tobytes()
    texts = [base, b"zz" + base[300:900] + b"yy", b"short", b"The " * 400, base[:N]]
    counts, (at, span, anchor, twice, digest) = suffix_dedup.runs_of(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    of_window, covered = {}, Counter()
    for d, a, s, h in zip(owner, at, span, anchor):
        for i in range(a, a + s):
            covered[d, i] += 1
            assert of_window.setdefault(texts[d][i:i + N], h) == h
    assert covered == Counter((d, i) for d, t in enumerate(texts) for i in range(len(t) - N + 1))
    assert twice[owner == 3].all()


@pytest.mark.parametrize("wide", [4096, 1])  # with 1 every anchor of several runs is settled window by window
def test_rows(spark, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rng = __import__("random").Random(8)
    passage = cases.sentence(rng, 60)
    documents = cases.texts() + [
        (300 + i, cases.sentence(rng, 30) + (passage if i % 2 else passage[40:]) + cases.sentence(rng, 30)) for i in range(12)
    ] + [(400, "The " * 300), (401, "é" * 150), (402, cases.sentence(rng, 200))]
    bodies = [(t or "").encode() for _, t in documents]
    counts = times(bodies)
    expected = []
    for (i, _), body in zip(documents, bodies):
        gone = np.zeros(len(body), bool)
        for at in range(len(body) - N + 1):
            if counts[body[at:at + N]] > 1:
                gone[at:at + N] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        expected.append((str(i), len(body), list(zip(edges[::2].tolist(), edges[1::2].tolist())), kept))
    rows = suffix_dedup.suffix_dedup(cases.frame(spark, documents)).collect()
    got = [(str(r["doc_id"]), r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows]
    assert sorted(got) == sorted(expected)
    assert sum(bool(e[2]) for e in expected) > 15
    assert suffix_dedup.suffix_dedup(cases.frame(spark, [])).count() == 0
