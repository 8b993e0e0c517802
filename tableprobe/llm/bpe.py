"""Byte-pair encoding by speculation: greedy proposals, vectorised checks of adjacent tokens, merges only on failure.

A sequence of tokens is what the merge rules give for a word exactly if every token is what they give for its own
characters, and no adjacent pair would have merged across its boundary. The second part can be decided for two tokens
alone: going back in time from the finished pair, the token at the boundary that was made last is split again, until
only characters are left. Each pair of pieces met on the way stood side by side between the merge that made the
younger one and the merge that used up either; a rule for that pair which comes in that span would have been
applied. So a word is proposed by longest match, all adjacent pairs of a batch are checked with array operations, and
only words with a failing pair are merged rule by rule.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import map_rows, text_of

NEVER = 1 << 60
SHORT_WORD = 40
CACHED_WORDS = 600_000  # encoded words a worker keeps; beyond it starts over, results are the same
END = "\0"  # stands for the end-of-word mark inside this module; no byte is written as this character
SPACE = r"\t-\r \x85\xa0  -     　"
NOT_SPACE = regex.compile(rf"[^{SPACE}]")


def byte_alphabet() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """One tokenizer file of the byte-level kind, with or without end-of-word marks, ready to encode and decode."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(spec.get("normalizer"))
        own = (lambda t: t[:-len(self.suffix)] + END if t.endswith(self.suffix) else t) if self.suffix else str
        self.vocab = {own(t): i for t, i in model["vocab"].items()}
        size = max(self.vocab.values()) + 1
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.specials = {t: np.int32(i).tobytes() for t, i in specials.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in specials.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], object)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.vocab[own(a)] for a, _ in merges], np.int64)
        right = np.array([self.vocab[own(b)] for _, b in merges], np.int64)
        made = np.array([self.vocab[own(a + b)] for a, b in merges], np.int64)
        self.size = size
        self.made_at = np.full(size, -1, np.int64)
        self.made_at[made] = np.arange(len(made))
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made] = left, right
        keys = left * size + right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.rules = dict(zip(keys.tolist(), zip(range(len(made)), made.tolist())))
        self.bytes_to_own = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.own_to_bytes = {c: b for b, c in byte_alphabet().items()}
        letters = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
        spaced = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
                  rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.word_pattern = regex.compile(letters if self.lower else spaced)
        self.proposals = self._sound_tokens()
        self.longest = max(map(len, self.proposals))
        self.known: dict[str, bytes] = {}

    def _sound_tokens(self) -> dict[str, int]:
        """Tokens that the rules give for their own characters; only these are proposed."""
        ids = np.flatnonzero(self.made_at >= 0)
        at = self.made_at[ids]
        sound = np.ones(self.size, bool)
        sound[ids] = ~self.conflicts(self.left[ids], self.right[ids], at)
        for t in ids[np.argsort(at)]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        return {t: i for t, i in self.vocab.items() if sound[i]}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def conflicts(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether a rule earlier than ``before`` would have merged across the boundary of each pair of tokens.

        Equal rules are applied from the left: at the same rank a pair across the boundary loses to the left
        token's own merge and wins over the right token's.
        """
        p, q = a.astype(np.int64), b.astype(np.int64)
        until_p = np.broadcast_to(np.asarray(before, np.int64), p.shape).copy()
        until_q = until_p.copy()
        bad = np.zeros(len(p), bool)
        left = np.arange(len(p))
        while len(left):
            rank = self.pair_rank(p, q)
            hit = (rank < until_p) & (rank <= until_q)
            bad[left[hit]] = True
            at_p, at_q = self.made_at[p], self.made_at[q]
            go = ~hit & ((at_p >= 0) | (at_q >= 0))
            left, p, q, at_p, at_q, until_p, until_q = (x[go] for x in (left, p, q, at_p, at_q, until_p, until_q))
            younger_p = at_p > at_q
            until_p, until_q = np.where(younger_p, at_p, until_p), np.where(younger_p, until_q, at_q)
            p, q = np.where(younger_p, self.right[p], p), np.where(younger_p, q, self.left[q])
        return bad

    def propose(self, word: str) -> list[int]:
        """Longest match from the left. The end mark is never left alone: it belongs to the last character."""
        proposals, longest, found, at, n = self.proposals, self.longest, [], 0, len(word)
        marked = word[-1] == END
        while at < n:
            end = min(n, at + longest)
            while True:
                token = proposals.get(word[at:end]) if end < n - 1 or end == n or not marked else None
                if token is not None:
                    break
                end -= 1
            found.append(token)
            at = end
        return found

    def merge(self, word: str) -> list[int]:
        """The rules applied one by one, lowest rank first, from the left."""
        symbols = list(word[:-2]) + [word[-2:]] if word[-1] == END else list(word)
        ids = [self.vocab[s] for s in symbols]
        n = len(ids)
        if n <= SHORT_WORD:
            return self._merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rule := self.rules.get(ids[i] * self.size + ids[j])):
                heapq.heappush(queue, (rule[0], i, ids[i], ids[j], rule[1]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same on plain lists, quicker where a scan for the lowest rank is short."""
        size, rules, none = self.size, self.rules, (NEVER, -1)
        ranks = [rules.get(a * size + b, none)[0] for a, b in zip(ids, ids[1:])]
        while ranks and (lowest := min(ranks)) < NEVER:
            i = ranks.index(lowest)
            ids[i:i + 2] = [rules[ids[i] * size + ids[i + 1]][1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rules.get(ids[i - 1] * size + ids[i], none)[0]
            if i < len(ranks):
                ranks[i] = rules.get(ids[i] * size + ids[i + 1], none)[0]
        return ids

    def learn(self, words: set[str]) -> None:
        """Encode words not met before, all together, into ``known``."""
        words = list(words)
        own = [w.encode("utf-8", "replace").decode("latin-1").translate(self.bytes_to_own) for w in words]
        if self.suffix:
            own = [w + END for w in own]
        proposed = [self.propose(w) for w in own]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad = self.conflicts(pairs // self.size, pairs % self.size)[back]
        for i in np.unique(owner[inner[bad]]).tolist():
            proposed[i] = self.merge(own[i])
        for word, ids in zip(words, proposed):
            self.known[word] = np.array(ids, np.int32).tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a stretch without special tokens, normalised as the file says."""
        if self.lower:
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()  # each character on its own: no final sigma
        return self.word_pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian 32-bit integers."""
        stretches = []
        for text in texts:
            parts = self.special_pattern.split(text) if self.special_pattern and "<" in text else [text]
            stretches.append([p if p in self.specials else self.words(p) for p in parts if p])
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = {w for parts in stretches for p in parts if isinstance(p, list) for w in p} - self.known.keys()
        if new:
            self.learn(new)
        known = self.known.__getitem__
        return [b"".join(self.specials[p] if isinstance(p, str) else b"".join(map(known, p)) for p in parts)
                for parts in stretches]

    def decode(self, ids: np.ndarray) -> str:
        """Word vocabularies without a decoder: the tokens, joined by spaces. Byte-level ones: the bytes as UTF-8."""
        if self.suffix:
            return " ".join(self.names[ids].tolist())
        text = "".join(self.names[ids].tolist())
        return bytes(self.own_to_bytes[c] for c in text).decode("utf-8", "replace")


_loaded: dict[str, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """The encoder of a tokenizer file, made once in a worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded[key] = Encoder(content)
    return _loaded[key]


def read_tokenizer(path: str) -> bytes:
    """The file's content, to be broadcast: a few MB, whatever the data."""
    with open(path, "rb") as file:
        return file.read()


def slices(texts: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together, so that long ones don't pile up."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: (key, ids array<int>). A null text is empty and has no ids; keys may repeat or be null.

    ``tokenizer`` is the path of a tokenizer file in JSON, read on the driver.
    """
    content = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for part in slices(batch.column(1).to_pylist()):
            packed += encoder(content.value).encode(part)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], ["key", "ids"])

    plain = df.select(quoted(key).alias("key"), text_of(text).alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    return map_rows(plain, rows, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` to the rows: the text of the ids, special tokens included; empty for null or no ids."""
    content = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    rest = df.drop("decoded")
    at = rest.columns.index(ids)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(at)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        own = encoder(content.value)
        texts = [own.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                          [*batch.schema.names, "decoded"])

    schema = rest.select("*", F.lit("").alias("decoded")).schema
    return map_rows(rest.withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>"))), rows, schema)
