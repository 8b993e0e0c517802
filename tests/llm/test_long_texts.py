"""Texts of several megabytes: read piece by piece, with the results of one piece, in memory that does not grow."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tableprobe.llm import bpe, exact_dedup, language_id, line_dedup, quality, simhash, suffix_dedup
from tests.llm import cases
from tests.llm.test_language_id import plain_ngrams
from tests.llm.test_quality import random_model

MEGABYTE = 1_000_000


def edges():
    """Texts whose words, blanks and line ends fall on the edges of small pieces in many ways."""
    rng = random.Random(3)
    drawn = ["".join(rng.choice("ab .\n\tÉ1İΣ") for _ in range(n)) for n in range(1, 60)]
    gaps = [" " * 40 + "word", "word" + "\n" * 70, "a" * 90 + " b " + "c" * 90, " ".join("abcdefghi" * 3)]
    return [t or "" for _, t in cases.texts()] + drawn + gaps + [cases.sentence(rng, 400) + "\n " * 30 + "x"]


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_ngrams_by_blocks(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    for text in edges():
        keys, n = language_id.counted(text[:3000])
        assert dict(zip(keys.tolist(), n.tolist())) == plain_ngrams(text[:3000])


@pytest.mark.parametrize("words", [1, 3, 5])
@pytest.mark.parametrize("piece", [0, 1, 9, 50])
def test_shingles_by_pieces(monkeypatch, words, piece):
    whole = [np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(t, words)]) for t in edges()]
    marks = [simhash.fingerprint(simhash.shingle_hashes(t, words)) for t in edges()]
    monkeypatch.setattr(simhash, "PIECE", piece)
    for text, hashes, mark in zip(edges(), whole, marks):
        assert np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(text, words)]).tolist() == hashes.tolist()
        assert simhash.fingerprint(simhash.shingle_hashes(text, words)) == mark


@pytest.mark.parametrize("size", [1, 33, 500])
def test_passages_by_pieces(monkeypatch, size):
    features, passages = quality.passage_features(edges())
    monkeypatch.setattr(quality, "PIECE_BYTES", size)
    cut, counts = quality.passage_features(edges())
    assert counts.tolist() == passages.tolist() and np.array_equal(cut, features)
    for text in edges():
        body = text.encode()
        assert b"".join(quality.whole_passages(body + b" ")) == body + b" "


@pytest.mark.parametrize("windows", [1, 90, 450])
def test_runs_by_pieces_cover_every_window_once(monkeypatch, windows):
    """Pieces may cut runs, but not change a window's anchor, leave one out or list one twice."""
    texts = [t.encode()[:4000] for t in edges()]

    def anchors(counts, runs):
        owner = np.repeat(np.arange(len(texts)), counts).tolist()
        return sorted((o, w, int(h)) for o, a, n, h in zip(owner, *runs[:3]) for w in range(a, a + n))

    whole = anchors(*suffix_dedup.runs_of(texts))
    monkeypatch.setattr(suffix_dedup, "PIECE_WINDOWS", windows)
    counts, runs = suffix_dedup.runs_by_piece(texts)
    assert anchors(counts, runs) == whole
    owner = np.repeat(np.arange(len(texts)), counts)
    for i, at, span, digest in zip(owner, runs[0], runs[1], runs[4]):
        body = texts[i][at:at + span + suffix_dedup.LENGTH - 1]
        assert hashlib.blake2b(body, digest_size=16).digest() == digest
    assert suffix_dedup.runs_by_piece([b"", b"short"]) == ([0, 0], ([], [], [], [], []))


def long_text(size):
    rng = random.Random(11)
    known = [cases.sentence(rng, 1) for _ in range(4000)]
    return "\n".join(" ".join(rng.choices(known, k=12)) for _ in range(size // 75))


@pytest.mark.parametrize("reader", ["runs", "ngrams", "shingles", "passages"])
def test_memory_does_not_grow_with_a_text(reader):
    text = long_text(4 * MEGABYTE)
    body = text.encode()
    read = {"runs": lambda: suffix_dedup.runs_by_piece([body]), "ngrams": lambda: language_id.counted(text),
            "shingles": lambda: simhash.fingerprint(simhash.shingle_hashes(text, 3)),
            "passages": lambda: quality.passage_features([text])}[reader]
    tracemalloc.start()
    read()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(body)  # in one piece it is 37 times the text (shingles) to 75 times (runs)


@pytest.fixture(scope="module")
def long_table(spark):
    """A text of 2 MB, one that holds it, a copy, one without white space, and a short one."""
    text = long_text(2 * MEGABYTE)
    rows = [(1, text), (2, "Before.\n" + text + "\nAfter."), (3, text), (4, "x" * (2 * MEGABYTE)), (5, "a short text")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_long_texts_are_encoded_and_decoded(long_table):
    rows, df = long_table
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = bpe.decode_ids(bpe.encode_texts(df.where("doc_id IN (1, 5)"), path), path).collect()
    for r in got:
        ids = library.encode(dict(rows)[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert len(got) == 2


def test_long_texts_are_deduplicated(long_table):
    rows, df = long_table
    kept = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()}
    assert kept == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1)}
    lines = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()}
    assert lines == {1: dict(rows)[1], 2: "Before.\nAfter.", 3: "", 4: dict(rows)[4], 5: "a short text"}
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    got = {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"]))
           for r in suffix_dedup.suffix_dedup(df).collect()}
    n = len(rows[0][1])
    assert got == {1: (n, [(0, n)], b""), 2: (n + 15, [(8, n + 8)], b"Before.\n\nAfter."), 3: (n, [(0, n)], b""),
                   4: (2 * MEGABYTE, [(0, 2 * MEGABYTE)], b""), 5: (12, [], b"a short text")}


def test_long_texts_are_scored(long_table):
    rows, df = long_table
    learn = df.where("doc_id IN (1, 5)").withColumn("lang", F.when(F.col("doc_id") == 1, "aa").otherwise("bb"))
    profiles = language_id.learn_profiles(learn, F.lit(True))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_language(df, profiles).collect()}
    assert {found[1], found[2], found[3]} == {"aa"} and found[5] == "bb"
    model = random_model(np.random.default_rng(zlib.crc32(b"model")), quality.STATISTICS + quality.HASHED)
    scores = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    for i, text in rows:
        assert abs(scores[i] - quality._forward(model, *quality.passage_features([text]))["p"][0]) < 1e-9
