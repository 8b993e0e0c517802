import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableprobe.llm import packing
from tests.llm import cases
from tests.llm.test_bpe import noise

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("length, pieces", [
    (1, [(0, 1)]), (9, [(0, 9)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]),
    (25, [(0, 5), (5, 10), (15, 10)])])
def test_cuts(length, pieces):
    assert packing.cut(length, 10) == pieces


def test_ids_are_the_librarys():
    own, reference = packing.tokenizer_of(packing.read_tokenizer(PATH)), Tokenizer.from_file(PATH)
    for value in [t or "" for _, t in cases.texts()] + noise(300):
        assert own.encode(value, allowed_special="all") == reference.encode(value, add_special_tokens=False).ids


def test_long_white_space(spark, monkeypatch):
    own = packing.tokenizer_of(packing.read_tokenizer(PATH))
    blanks, lines = " " * 3_000_000, "\n" * 3_000_000
    long = [f"a{blanks}b c{lines}d", f"a b{blanks}", f"a{lines}<|endoftext|>{blanks}", f"{lines}\u3000x", blanks + lines]
    rows = packing.pack_documents(cases.frame(spark, list(enumerate(long))), PATH).collect()
    for i, value in enumerate(long):
        ids = packing.encode_text(own, value)
        assert own.decode(ids) == value
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(ids) + 1
    reference = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "LONG_RUN", 4)
    monkeypatch.setattr(packing, "RUN", packing.regex.compile(packing.RUN.pattern.replace("100000", "4")))
    for value in [v.replace(blanks, " " * 9).replace(lines, "\n" * 9) for v in long] + noise(100):
        for spaced in (value, value.replace(" ", " \t\n  ") + " " * 5):
            assert packing.encode_text(own, spaced) == reference.encode(spaced, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [50, 1024])
def test_evolution_never_breaks_a_packing(capacity):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, capacity, 400)
    first = packing.evolve(sizes, [], capacity, 1)
    better = packing.evolve(sizes, [first, packing.evolve(sizes, [], capacity, 2)], capacity, 3)
    for bins in (first, better):
        assert np.bincount(bins, weights=sizes).max() <= capacity
    assert better.max() <= first.max() <= 1.03 * sizes.sum() / capacity + 1


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 200).tolist()
    parents = [packing.packed(sizes, 100, rng.permutation(200)) for _ in range(2)]
    for _ in range(20):
        child = packing.crossover(*parents, rng)
        assert sorted(p for b in child.bins for p in b) == list(range(200))
        assert all(sum(sizes[p] for p in b) == 100 - r >= 0 for b, r in zip(child.bins, child.room))
        parents = [child, parents[0]]


@pytest.mark.parametrize("capacity, shard", [(1024, 4096), (64, 16)])
def test_pieces(spark, monkeypatch, capacity, shard):
    monkeypatch.setattr(packing, "SHARD_PIECES", shard)
    reference = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(cases.frame(spark), PATH, capacity=capacity, keep_ids=True).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        documents[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for placed in sequences.values():
        placed.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in placed] == np.cumsum([0] + [r["length"] for r in placed[:-1]]).tolist()
        assert sum(r["length"] for r in placed) <= capacity
    expected = Counter()
    for i, t in cases.texts():
        ids = reference.encode(t or "", add_special_tokens=False).ids + [2]
        for piece, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            expected[i, piece, start, tuple(ids[start:start + length])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in rows) == expected
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // capacity) + (1 if shard > 1000 else len(rows) // shard + 2)
    assert packing.pack_documents(cases.frame(spark, []), PATH).count() == 0
