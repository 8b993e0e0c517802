"""Languages by rank-order profiles: a text's most frequent letter n-grams against those of each language.

A profile lists n-grams by falling frequency. The distance of a text to a language is the sum, over the text's n-grams,
of how far each is out of place in the language's list; one that isn't there counts as far as can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import map_rows, ship, text_of

PROFILE = 400  # n-grams of a language's profile and of a text's
BLOCK = 1 << 19  # characters of a text whose n-grams are listed at once
FLUSH = 1_000_000  # n-grams a task counts before it hands its counts on
CODE_BITS = 21  # of a code point; three fit in a key
UNKNOWN = "und"
LANGUAGES = 10_000  # profiles that are broadcast at most, 3 KB each

_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][codes]


def ngram_blocks(text: str) -> Iterator[np.ndarray]:
    """Keys of all letter n-grams of 1 to 3 characters, repeats included, by blocks of the text.

    The text is put in lower case; whatever is no letter separates words, and a word's n-grams take in one blank before
    and after it. The code points of an n-gram lie side by side in its key. A block starts with the last two characters
    of the one before it, so none is lost where blocks meet.
    """
    text = text.lower()
    before, blank = np.array([32]), np.array([32])
    for at in range(0, len(text) + 1, BLOCK):
        codes = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        codes = np.where(_is_letter(codes), codes, 32)
        codes = np.concatenate([before[-1:], codes, blank[at + BLOCK <= len(text):]])  # a blank after the last block
        codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
        pairs = codes[:-1] << CODE_BITS | codes[1:]
        whole = np.concatenate([before[:-1], codes])
        triples = (whole[:-2] << 2 * CODE_BITS | whole[1:-1] << CODE_BITS | whole[2:])[whole[1:-1] != 32]
        yield np.concatenate([codes[1:][codes[1:] != 32], pairs, triples])
        before = whole[-2:]


def ngrams(text: str) -> np.ndarray:
    return np.concatenate(list(ngram_blocks(text)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (keys, counts) of several, keys in order."""
    if len(parts) == 1:
        return parts[0]
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text in order, and how often each occurs; blocks are counted one by one."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for grams in ngram_blocks(text):
        parts.append(np.unique(grams, return_counts=True))
        if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > len(parts[0][0]):
            parts = [merged(parts)]
    return merged(parts)


def count_ngrams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows; tasks count first and send a row per language and n-gram."""
    ship(df.sparkSession)

    def emit(counts: dict) -> Iterator[pa.RecordBatch]:
        for name, (keys, n) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(n)],
                                             ["lang", "gram", "n"])

    def rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0

        def settle() -> None:
            nonlocal held
            for name, lists in waiting.items():
                keys, n = np.unique(np.concatenate(lists), return_counts=True)
                counts[name] = merged([counts[name], (keys, n)]) if name in counts else (keys, n)
            waiting.clear()
            held = 0

        for batch in stream:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for grams in ngram_blocks(value):
                    waiting.setdefault(name, []).append(grams)
                    held += len(grams)
                    if held > 4 * FLUSH:
                        settle()
                        if sum(len(k) for k, _ in counts.values()) > FLUSH:
                            yield from emit(counts)
                            counts.clear()
        settle()
        yield from emit(counts)

    plain = df.select(quoted(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    return plain.mapInArrow(rows, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def learn_profiles(df: DataFrame, usable: Column, text: str = "text", lang: str = "lang",
                   size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of every language, of all rows for which ``usable`` holds.

    Rows of a null language teach nothing. What comes to the driver is one list of bounded length per language; more than
    `LANGUAGES` of them, as when the column holds something else, are refused by a ValueError before anything is counted.
    """
    taught = df.where(usable & quoted(lang).isNotNull())
    if taught.select(quoted(lang)).distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"{lang!r} has more than {LANGUAGES} different values")
    counts = count_ngrams(taught, text, lang)
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranker:
    """All profiles as one table of ranks by n-gram and language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.names = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)  # the last row: in no profile
        for i, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), i] = np.arange(len(profiles[name]))

    def predict(self, text: str) -> tuple[str, float]:
        grams, counts = counted(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        grams = grams[np.argsort(-counts, kind="stable")[:self.size]]  # ties by key
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == grams, at, len(self.grams))]
        out_of_place = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))[:, None]))
        distance = out_of_place.sum(axis=0)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.size * len(grams)))


def predict_language(df: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, 1 for a text whose ranks are a language's and 0 for one that shares none.

    A text that is null or has no letter is ``und`` with score 0, as is any text without profiles; on a tie of
    distances the first name wins. Columns already called so are replaced.
    """
    rest = df.drop("lang_pred", "score")
    schema = rest.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = df.sparkSession.sparkContext.broadcast(Ranker(profiles))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([n for n, _ in found], pa.string()),
             pa.array([s for _, s in found], pa.float64())], schema.fieldNames())

    return map_rows(rest.withColumn("_read", text_of(text)), rows, schema)
