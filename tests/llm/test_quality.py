import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tableprobe.llm import quality
from tableprobe.llm.queries import QUERIES
from tests.llm import cases


def test_gradient_is_the_slope_of_the_loss():
    """A few steps of training must bring the loss down on bags that one passage decides."""
    rng = np.random.default_rng(1)
    passages = rng.integers(1, 9, 300)
    features = rng.normal(size=(passages.sum(), 6)).astype(np.float32)
    label = np.maximum.reduceat(features[:, 0], np.cumsum(passages) - passages) > 1.0
    model = quality.fit(features, passages, label.astype(float))
    p = quality._forward(model, features, passages)["p"]
    assert ((p > 0.5) == label).mean() > 0.95


def test_passages_cover_the_whole_text():
    values = [t or "" for _, t in cases.texts()]
    features, passages = quality.passage_features(values)
    assert passages.tolist() == [max(1, -(-len(v.encode().split()) // quality.PASSAGE_WORDS)) for v in values]
    assert len(features) == passages.sum() and np.isfinite(features).all()
    alone = [quality.passage_features([v])[0] for v in values]  # a text's features don't depend on its neighbours
    assert np.allclose(np.concatenate(alone), features, atol=1e-6)
    assert quality.passage_features([""])[0].sum() == 0


def test_rows(spark):
    documents = [(i, cases.sentence(random.Random(i), 80) if i % 2 else "SPAM!! " * 80) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    df = cases.frame(spark, documents)
    model = quality.train(df, labels, F.col("doc_id") < 40)
    scored = quality.score(df, model)
    assert scored.columns == [c for c in df.columns if c != "score"] + ["score"]
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in scored.collect())
    edges = quality.score(cases.frame(spark), model).collect()
    assert len(edges) == len(cases.texts()) and all(0 <= r["score"] <= 1 for r in edges)
    assert quality.train(df, labels.where("false"), F.lit(True)) is None
    assert {r["score"] for r in quality.score(df, None).collect()} == {0.5}
    assert quality.score(cases.frame(spark, []), model).count() == 0


def test_repeated_keys_take_no_places(spark, monkeypatch):
    """Every labelled document is fitted on once, however often others are repeated, and with the same text each time."""
    seen = []
    monkeypatch.setattr(quality, "_fit_on_spark", lambda bags: seen.append(sorted(map(tuple, bags.collect()))) or {})
    documents = [(0, f"copy {i % 7} " * 9) for i in range(2000)] + [(i, f"word {i} " * 20) for i in range(1, 20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    for rows in (documents, documents[::-1]):
        quality.train(cases.frame(spark, rows), labels, F.lit(True), documents=20)
    for bags in seen:
        assert [y for y, _, _ in bags] == [0] * 10 + [1] * 10 and all(n == 1 for _, _, n in bags)
    assert seen[0] == seen[1]


def plain_forward(model, features):
    """The score of one bag, passage by passage."""
    hidden, weights = [], []
    for x in features:
        x = [(float(v) - m) / s for v, m, s in zip(x, model["mean"], model["scale"])]
        h = [math.tanh(sum(x[i] * model["W"][i][j] for i in range(len(x))) + model["b"][j]) for j in range(quality.HIDDEN)]
        gate = 0.0
        for g in range(quality.GATES):
            t = math.tanh(sum(h[j] * model["V"][j][g] for j in range(quality.HIDDEN)))
            u = sum(h[j] * model["U"][j][g] for j in range(quality.HIDDEN))
            gate += t / (1 + math.exp(-u)) * model["w"][g]
        hidden.append(h)
        weights.append(math.exp(gate))
    z = [sum(w * h[j] for w, h in zip(weights, hidden)) / sum(weights) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, model["c"])) + float(model["d"]))))


def random_model(rng, width):
    weights = quality.start(0.4, width)
    return quality.unpacked(weights + rng.normal(0, 0.2, len(weights)), width) | {
        "mean": rng.normal(size=width), "scale": rng.uniform(0.5, 2, width)}


def test_forward_pass_against_a_plain_one():
    rng = np.random.default_rng(4)
    passages = rng.integers(1, 6, 20)
    features = rng.normal(size=(passages.sum(), 7))
    model = random_model(rng, 7)
    expected = [plain_forward(model, bag) for bag in np.split(features, np.cumsum(passages)[:-1])]
    assert np.allclose(quality._forward(model, features, passages)["p"], expected)


def test_slope_against_differences():
    rng = np.random.default_rng(5)
    passages, label = rng.integers(1, 6, 12), rng.integers(0, 2, 12).astype(float)
    features = rng.normal(size=(passages.sum(), 4))
    fixed = {"mean": np.zeros(4), "scale": np.ones(4)}
    weights = quality.packed(random_model(rng, 4))

    def loss(w):
        return quality.slope(quality.unpacked(w, 4) | fixed, features, passages, label)

    found = loss(weights)
    for at in rng.choice(len(weights), 60, replace=False):
        step = np.zeros(len(weights))
        step[at] = 1e-5
        assert abs((loss(weights + step)[0] - loss(weights - step)[0]) / 2e-5 - found[1 + at]) < 1e-5


def plain_features(text):
    """The countable features of every passage: words, shares of byte classes, repeats."""
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text.encode("utf-8", "replace") + b" ")
    found = []
    for at in range(0, max(1, len(words)), quality.PASSAGE_WORDS):
        part = words[at:at + quality.PASSAGE_WORDS]
        bare = [w.rstrip(b" \t\n\x0b\x0c\r") for w in part]
        n = max(1, len(part))
        lower = sum(sum(97 <= c < 123 for c in w) / len(w) for w in part) / n
        length = sum(map(len, bare)) / n / 10
        same = sum(a == b for a, b in zip(bare, bare[1:])) / n
        kinds = 1 - len(set(bare)) / n if part else 0
        digits = sum(any(48 <= c < 58 for c in w) for w in bare) / n
        found.append([math.log1p(len(part)) / 4, lower, length, same, kinds, digits])
    return found


def test_features_against_plain_counts():
    for text in [t or "" for _, t in cases.texts()] + ["ab ab cd 12 ab\n\nab  x9 " * 30]:
        features, passages = quality.passage_features([text])
        expected = plain_features(text)
        assert len(expected) == passages[0]
        assert np.allclose(features[:, [0, 2, 8, 10, 12, 15]], expected, atol=1e-5), text[:80]


def test_one_passage_of_many_decides(spark):
    """Documents of 130 passages, equal but for one somewhere: nothing is left out of the fit."""
    rng = random.Random(8)

    def document(i):
        parts = [cases.sentence(rng, quality.PASSAGE_WORDS) for _ in range(130)]
        if i % 2:
            parts[rng.randrange(130)] = " ".join(["$$$ 99 !!"] * (quality.PASSAGE_WORDS // 3) + ["x"])
        return " ".join(parts)

    df = cases.frame(spark, [(i, document(i)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    model = quality.train(df, labels, F.col("doc_id") < 40)
    rows = quality.score(df, model).select("doc_id", "score").collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in rows if r["doc_id"] >= 40)


def test_labels_of_one_class(spark):
    df = cases.frame(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    rows = quality.score(df, quality.train(df, labels, F.lit(True))).collect()
    assert len(rows) == len(cases.texts()) and all(0.5 <= r["score"] <= 1 for r in rows if r["doc_id"] in range(20))


def test_the_fit_on_spark_is_that_in_place(spark):
    df = cases.frame(spark, [(i, cases.sentence(random.Random(i), 40 + i * 9) + " 77 !!" * (i % 3)) for i in range(40)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id bigint, quality int")
    rows = df.select("doc_id", "text").collect()
    features, passages = quality.passage_features([r["text"] for r in rows])
    here = quality.fit(features.astype(float), passages, np.array([r["doc_id"] % 3 == 0 for r in rows], float))
    there = quality.train(df, labels, F.lit(True))
    assert np.allclose(here["mean"], there["mean"]) and np.allclose(here["scale"], there["scale"])
    a, b = (quality._forward(m, features, passages)["p"] for m in (here, there))
    assert (np.abs(a - b) < 0.05).all()


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{cases.SF_DIR}/labels.parquet").collect()}
    rows = QUERIES["op8_quality"](spark, cases.SF_DIR).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = [r for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in known) >= 0.9 * len(known)
