"""Document quality by attention-based multiple-instance learning: a document is a bag of passages.

Every passage of a text is encoded; gated attention, learned from document labels alone, weighs the passages, and the
weighted mean of their representations is scored. The model is a few thousand numbers fitted on a bounded sample of
labelled documents, whole ones: their encoded passages lie in a table, and each step of the fit sums the gradient over
that table on Spark. Scoring reads every passage of every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.bpe import slices
from tableprobe.llm.common import map_rows, staged, text_of

PASSAGE_WORDS = 64
FIT_DOCUMENTS = 6000  # labelled documents the model is fitted on, at most; those of least hash are taken
STATISTICS, HASHED, HIDDEN, GATES = 19, 32, 16, 8
STEPS, HISTORY, DECAY = 60, 10, 1e-4
PIECE_BYTES = 1 << 19  # bytes of a text that are read at once
PASSAGES = 1 << 12  # passages of whole bags whose gradient is taken at once

# Byte classes: 0 space, 1 line end, 2 lower, 3 upper, 4 digit, 5 punctuation of prose, 6 other symbol, 7 beyond ASCII.
CLASSES = np.full(256, 6, np.uint8)
CLASSES[[9, 11, 12, 32]], CLASSES[[10, 13]] = 0, 1
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 2, 3, 4, 7
CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_RANDOM = np.random.default_rng(8)
BYTE_KEYS = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
PLACE_KEYS = _RANDOM.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def whole_passages(body: bytes) -> Iterator[bytes]:
    """A long text by pieces of whole passages, of one to two `PIECE_BYTES` but for huge words; white space ends each."""
    words, cut, gap = 0, 0, True
    for at in range(0, len(body), PIECE_BYTES):
        white = CLASSES[np.frombuffer(body[at:at + PIECE_BYTES], np.uint8)] < 2
        starts = at + np.flatnonzero(~white & np.append(gap, white[:-1]))
        gap = bool(white[-1])
        edges = starts[-words % PASSAGE_WORDS::PASSAGE_WORDS]
        words += len(starts)
        if len(edges) and words > len(starts):
            yield body[cut:edges[-1]]
            cut = int(edges[-1])
    yield body[cut:]


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of some texts, and how many passages each text has: one at least, of zeros if empty."""
    bodies = [t.encode("utf-8", "replace") + b" " for t in texts]
    owners, pieces = zip(*[(i, p) for i, b in enumerate(bodies) for p in whole_passages(b)])
    found = [_piece_features(part) for part in slices(pieces, 2 * PIECE_BYTES)]
    passages = np.bincount(owners, np.concatenate([n for _, n in found])).astype(np.int64)
    return np.concatenate([f for f, _ in found]), passages


def _piece_features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for pieces that end with white space."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    kind = CLASSES[data]
    gap = kind < 2
    begins = ~gap
    begins[1:] &= gap[:-1]
    starts = np.flatnonzero(begins)
    doc_starts = np.cumsum([0] + [len(r) for r in raw[:-1]])
    doc = np.searchsorted(doc_starts, starts, "right") - 1
    words = np.bincount(doc, minlength=len(raw))
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    total = int(passages.sum())
    features = np.zeros((total, STATISTICS + HASHED), np.float32)
    if not len(starts):
        return features, passages
    passage = (np.cumsum(passages) - passages)[doc] + (
        np.arange(len(starts)) - (np.cumsum(words) - words)[doc]) // PASSAGE_WORDS
    cuts = np.union1d(starts, doc_starts)  # white space after a word counts with it, up to the end of its text
    own = np.searchsorted(cuts, starts)
    counts = [np.add.reduceat(kind == k, cuts, dtype=np.int32)[own] for k in range(8)]
    length = sum(counts[2:])
    place = np.arange(len(data)) - np.maximum.accumulate(np.where(begins, np.arange(len(data)), 0))
    keys = np.where(gap, np.uint64(0), BYTE_KEYS[data] * PLACE_KEYS[place & 63])
    keys ^= keys >> np.uint64(29)
    word = np.add.reduceat(keys, starts)
    word *= np.uint64(0x9E3779B97F4A7C15)
    word ^= word >> np.uint64(32)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=values, minlength=total) / n

    size = np.bincount(passage, minlength=total)
    n = np.maximum(1, size)
    same = np.zeros((2, len(word)), bool)
    for back in (1, 2):
        same[back - 1, back:] = (word[back:] == word[:-back]) & (passage[back:] == passage[:-back])
    _, first = np.unique(word ^ (passage.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    kinds = np.bincount(passage[first], minlength=total)
    letters = counts[2] + counts[3] + counts[7]
    columns = [
        np.log1p(size) / 4, *[mean(c / (length + counts[0] + counts[1])) for c in counts[1:]],
        mean(length) / 10, np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - mean(length) ** 2)) / 10,
        mean(same[0]), mean(same[1]), np.where(size > 0, 1 - kinds / n, 0),
        mean((counts[3] > 1) & (counts[2] == 0)), mean(counts[6] > 0), mean(counts[4] > 0), mean(counts[5] > 1),
        mean(letters == 0), mean(length == 1),
    ]
    features[:, :STATISTICS] = np.stack(columns, axis=1)
    slot = (word >> np.uint64(59)).astype(np.int64)
    sign = np.where(word >> np.uint64(58) & np.uint64(1), 1.0, -1.0)
    features[:, STATISTICS:] = np.bincount(
        passage * HASHED + slot, weights=sign, minlength=total * HASHED).reshape(total, HASHED) / np.sqrt(n)[:, None]
    return features, passages


def _forward(model: dict, features: np.ndarray, passages: np.ndarray) -> dict:
    first = np.cumsum(passages) - passages
    h = np.tanh(((features - model["mean"]) / model["scale"]) @ model["W"] + model["b"])
    t, s = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (t * s) @ model["w"]
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), passages))
    a /= np.repeat(np.add.reduceat(a, first), passages)
    z = np.add.reduceat(a[:, None] * h, first)
    logit = np.clip(z @ model["c"] + model["d"], -30, 30)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "first": first, "p": 1 / (1 + np.exp(-logit))}


def _shapes(width: int) -> dict[str, tuple[int, ...]]:
    return {"W": (width, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,),
            "c": (HIDDEN,), "d": ()}


def unpacked(weights: np.ndarray, width: int) -> dict:
    """The arrays of a model of ``width`` features from one vector."""
    model, at = {}, 0
    for name, shape in _shapes(width).items():
        size = int(np.prod(shape))
        model[name] = weights[at:at + size].reshape(shape)
        at += size
    return model


def packed(model: dict) -> np.ndarray:
    return np.concatenate([np.ravel(model[name]) for name in _shapes(0)])


def slope(model: dict, features: np.ndarray, passages: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The summed log loss of some bags and, after it, its gradient by every weight."""
    x = (features - model["mean"]) / model["scale"]
    out = _forward(model | {"mean": 0.0, "scale": 1.0}, x, passages)
    h, t, s, a = (out[k] for k in "htsa")
    error = out["p"] - label
    back = np.repeat(error, passages)[:, None] * model["c"]
    on_a = (back * h).sum(1)
    on_e = a * (on_a - np.repeat(np.add.reduceat(a * on_a, out["first"]), passages))
    on_gate = on_e[:, None] * model["w"]
    on_t, on_s = on_gate * s * (1 - t * t), on_gate * t * s * (1 - s)
    on_h = (a[:, None] * back + on_t @ model["V"].T + on_s @ model["U"].T) * (1 - h * h)
    loss = -np.log(np.where(label > 0.5, out["p"], 1 - out["p"])).sum()
    return np.concatenate([[loss], packed({
        "W": x.T @ on_h, "b": on_h.sum(0), "V": h.T @ on_t, "U": h.T @ on_s, "w": (t * s).T @ on_e,
        "c": out["z"].T @ error, "d": error.sum()})])


def start(share: float, width: int) -> np.ndarray:
    """The weights that a fit begins with, for a share of label 1."""
    rng = np.random.default_rng(3)
    share = np.clip(share, 0.01, 0.99)
    return packed({
        "W": rng.normal(0, width ** -0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.25, (HIDDEN, GATES)), "U": rng.normal(0, 0.25, (HIDDEN, GATES)),
        "w": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "d": np.log(share / (1 - share))})


def descend(evaluate: Callable[[np.ndarray], np.ndarray], weights: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of less loss by limited-memory BFGS; ``evaluate`` gives the loss and, after it, its gradient."""
    found = evaluate(weights)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        loss, g = found[0], found[1:]
        way, factors = g.copy(), []
        for move, turn in reversed(moves):
            factors.append(move @ way / (move @ turn))
            way -= factors[-1] * turn
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else min(1, 1 / np.linalg.norm(g))
        for (move, turn), factor in zip(moves, reversed(factors)):
            way += (factor - turn @ way / (move @ turn)) * move
        length, fall = 1.0, g @ way
        while length > 1e-4:
            tried = evaluate(weights - length * way)
            if tried[0] <= loss - 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        moves = [*moves, (-length * way, tried[1:] - g)][-HISTORY:]
        if moves[-1][0] @ moves[-1][1] <= 1e-12:
            moves.pop()
        weights, found = weights - length * way, tried
        if loss - tried[0] < 1e-6 * max(1e-2, loss) or np.abs(tried[1:]).max() < 1e-6:
            break
    return weights


def _penalised(sums: np.ndarray, bags: int, weights: np.ndarray) -> np.ndarray:
    """The mean loss and its gradient, with the penalty on large weights."""
    found = sums / bags
    found[0] += DECAY / 2 * weights @ weights
    found[1:] += DECAY * weights
    return found


def fit(features: np.ndarray, passages: np.ndarray, label: np.ndarray) -> dict:
    """The model that fits bags of passages to labels of 0 and 1, here and now."""
    width = features.shape[1]
    fixed = {"mean": features.mean(0), "scale": features.std(0) + 0.05}

    def evaluate(weights: np.ndarray) -> np.ndarray:
        return _penalised(slope(unpacked(weights, width) | fixed, features, passages, label), len(label), weights)

    return unpacked(descend(evaluate, start(label.mean(), width)), width) | fixed


def _bags(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, passages, label) of whole bags, some thousand passages at once."""
    for batch in stream:
        label, counts = batch.column("y").to_numpy(), batch.column("n").to_numpy()
        raw = batch.column("bag")
        parts = np.cumsum(counts) // PASSAGES
        for part in np.unique(parts):
            rows = np.flatnonzero(parts == part)
            features = np.frombuffer(b"".join(raw[int(i)].as_py() for i in rows), np.float32)
            yield features.reshape(-1, STATISTICS + HASHED), counts[rows], label[rows].astype(float)


def _summed(bags: DataFrame, function: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a function's arrays over all bags. A task adds up its own, so a short row per task comes back."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _bags(stream):
            found = function(*part)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return np.sum([r["sums"] for r in bags.mapInArrow(run, "sums array<double>").collect()], axis=0)


def _fit_on_spark(bags: DataFrame) -> dict:
    """`fit`, with every sum over the bags taken on Spark."""
    width = STATISTICS + HASHED

    def count(features: np.ndarray, passages: np.ndarray, label: np.ndarray) -> np.ndarray:
        x = features.astype(float)
        return np.concatenate([[len(label), label.sum(), len(x)], x.sum(0), (x * x).sum(0)])

    total, ones, n, *sums = _summed(bags, count)
    mean = np.array(sums[:width]) / n
    spread = np.sqrt(np.maximum(0, np.array(sums[width:]) / n - mean * mean))
    fixed = {"mean": mean, "scale": spread + 0.05}

    def evaluate(weights: np.ndarray) -> np.ndarray:
        shared = bags.sparkSession.sparkContext.broadcast(unpacked(weights, width) | fixed)
        sums = _summed(bags, lambda features, passages, label: slope(shared.value, features, passages, label))
        shared.destroy()
        return _penalised(sums, total, weights)

    return unpacked(descend(evaluate, start(ones / total, width)), width) | fixed


BAG = pa.schema([("y", pa.int32()), ("bag", pa.binary()), ("n", pa.int32())])


def train(df: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id",
          label: str = "quality", documents: int = FIT_DOCUMENTS) -> dict | None:
    """Fit on labelled rows of ``df`` for which ``usable`` holds; it may use the column ``key`` only.

    At most ``documents`` are taken, those whose keys hash lowest, so the sample doesn't depend on partitions; of each
    every passage is read. A key with several labels has the largest, one with several rows the text of least digest:
    copies are reduced within tasks. Encoded passages are written to the shared folder, 200 bytes for 64 words, and the
    driver gets sums of them only. Null texts are empty ones. None if no usable row has a label.
    """
    known = (labels.where(quoted(label).isNotNull() & quoted(key).isNotNull() & usable)
             .groupBy(quoted(key).alias("key")).agg((F.max(quoted(label)) > 0).cast("int").alias("y"))
             .orderBy(F.xxhash64("key"), "key").limit(documents))
    sample = (df.select(quoted(key).alias("key"), text_of(text).alias("text")).join(F.broadcast(known), "key")
              .groupBy("key", "y").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("least"))
              .select("y", F.col("least.text").alias("text")))

    def rows(batch: pa.RecordBatch) -> pa.Table:
        found = []
        labels, at = batch.column("y"), 0
        for part in slices(batch.column("text").to_pylist()):
            features, passages = passage_features(part)
            bags = [bag.tobytes() for bag in np.split(features, np.cumsum(passages)[:-1])]
            found.append(pa.RecordBatch.from_arrays(
                [labels.slice(at, len(part)), pa.array(bags, pa.binary()), pa.array(passages.astype(np.int32))],
                ["y", "bag", "n"]))
            at += len(part)
        return pa.Table.from_batches(found, BAG)

    bags = staged(map_rows(sample, rows, "y int, bag binary, n int"))
    return None if bags.isEmpty() else _fit_on_spark(bags)


def score(df: DataFrame, model: dict | None, text: str = "text", output: str = "score") -> DataFrame:
    """Add ``output``, the probability of label 1, to the rows; 0.5 without a model. A null text is an empty one.

    A column already called ``output`` is replaced. Texts without a word have one passage of zeros, and a score.
    """
    rest = df.drop(output)
    if model is None:
        return rest.withColumn(output, F.lit(0.5))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = rest.withColumn(output, F.lit(0.0)).schema
    filled = rest.withColumn("_passages_of", text_of(text))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for part in slices(batch.column(batch.num_columns - 1).to_pylist()):
            features, passages = passage_features(part)
            found.append(_forward(shared.value, features, passages)["p"])
        p = np.concatenate(found) if found else np.empty(0)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], schema.fieldNames())

    return map_rows(filled, rows, schema)
