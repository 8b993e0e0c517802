import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tableprobe.llm import simhash
from tableprobe.llm.graph import components
from tests.llm import cases


def fingerprint(text, words=3):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
@pytest.mark.parametrize("n", [1, 64, 65, 400])
def test_bit_planes_find_every_close_pair(n, distance):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n, np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, n)).astype(np.uint64), axis=0)
    values = np.concatenate([base, base ^ flips, base ^ np.uint64(7)])
    ends = simhash.group_ends(np.sort(rng.integers(0, 3, len(values))))
    got = sorted((int(i), int(j)) for a, b in simhash.close_pairs(values, ends, distance) for i, j in zip(a, b))
    assert got == [(i, j) for i in range(len(values)) for j in range(i + 1, ends[i])
                   if int(values[i] ^ values[j]).bit_count() <= distance]


@pytest.mark.parametrize("block", [4096, 8])  # with 8 the larger buckets are compared block by block
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = cases.sentence(__import__("random").Random(9), 300).split()
    near = []
    for i in range(40):
        words = list(base)
        for at in rng.integers(0, 300, i % 5):
            words[at] = f"w{i}"
        near.append((200 + i, " ".join(words)))
    documents = cases.texts() + near
    rows = simhash.simhash_groups(cases.frame(spark, documents)).collect()
    marks = {t: fingerprint(t) for _, t in documents}
    nodes = sorted(set(marks.values()))
    label = components_of(nodes)
    lowest = {}
    for i, t in documents:
        if i is not None:
            lowest[label[marks[t]]] = min(lowest.get(label[marks[t]], i), i)
    want = Counter((i, marks[t], lowest.get(label[marks[t]])) for i, t in documents)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows) == want
    assert simhash.simhash_groups(cases.frame(spark, [])).count() == 0


def components_of(nodes):
    return cases.components(nodes, lambda a, b: (a ^ b).bit_count() <= 3)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 500)] + [(1, 1), (2, 3), (3, 2), (2, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(300, 500)}, 2: 2, 3: 2}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
