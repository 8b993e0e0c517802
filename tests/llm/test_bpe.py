import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableprobe.llm import bpe
from tableprobe.llm.queries import QUERIES
from tests.llm import cases

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def noise(n):
    rng = random.Random(3)
    ranges = [(32, 127), (1, 0x250), (0x400, 0x530), (0x4e00, 0x4fff), (0x1f300, 0x1f600), (97, 123)]
    return ["".join(chr(rng.randrange(*rng.choice(ranges))) if rng.random() < 0.8 else " " for _ in range(rng.randint(1, 40)))
            for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_text_are_the_librarys(name):
    own, reference = bpe.encoder(bpe.read_tokenizer(public_tokenizers.path(name))), library(name)
    values = [t or "" for _, t in cases.texts()] + noise(400) + ["aaaa" * 100, "don't I'll we've'S", "<|startoftext|>x"]
    for value, packed in zip(values, own.encode(values)):
        ids = reference.encode(value, add_special_tokens=False).ids
        assert np.frombuffer(packed, np.int32).tolist() == ids
        assert own.decode(np.array(ids, np.int64)) == reference.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_pair_checks_agree_with_merging(name):
    own = bpe.encoder(bpe.read_tokenizer(public_tokenizers.path(name)))
    tokens = [(t, i) for t, i in list(own.proposals.items())[::97] if bpe.END not in t]
    rng = random.Random(1)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    bad = own.conflicts(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    for (a, b), conflict in zip(pairs, bad):
        assert (own.merge(a[0] + b[0]) != [a[1], b[1]]) == conflict
    long = ["".join(rng.choice("abcdeth") for _ in range(n)) for n in (41, 90, 300)]
    for word in long:  # the queue and the plain scan give the same
        assert own.merge(word) == own._merge_short([own.vocab[c] for c in word])


def test_rows(spark):
    path = public_tokenizers.path(FILES[0])
    encoded = bpe.encode_texts(cases.frame(spark), path)
    assert encoded.columns == ["doc_id", "ids"]
    rows = bpe.decode_ids(encoded, path).collect()
    reference = library(FILES[0])
    expected = sorted((str(i), reference.encode(t or "", add_special_tokens=False).ids) for i, t in cases.texts())
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == expected
    assert bpe.encode_texts(cases.frame(spark, []), path).count() == 0


def test_query(spark):
    reference = library(FILES[0])
    rows = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, cases.SF_DIR).collect()}
    documents = spark.read.parquet(f"{cases.SF_DIR}/documents.parquet").collect()
    assert len(rows) == len(documents)
    for d in documents:
        ids = reference.encode(d["text"] or "", add_special_tokens=False).ids
        row = rows[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = reference.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
