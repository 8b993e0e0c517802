"""Conversation structure repair: the cheapest edits that make roles read system?, (user, assistant) and so on.

Every row is a symbol, its role and its fault; equal symbols in a row are one run. A symbol moves a conversation between
four states at a cost (a 4 x 4 matrix under minimum and sum), and a run of n rows moves it by the n-th power, put
together from cached binary powers. Costs to the end are carried back over the runs; then edits are unrolled forward.

This is done on rows without texts. Conversations that hold very many rows are dealt by ranges over many tasks: each task
turns its stretch into one matrix, the stretches are chained, and then unrolled where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tableprobe.functions.columns import quoted
from tableprobe.llm.common import HOT_SHARE, join_groups, ship, staged

# The price of each edit, and of keeping a truncated row.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

FAULTS = ["", "truncated", "duplicate", "blank"]
INITIALS = "sua"  # all other roles are one class
PIECE = 1 << 16  # rows of a conversation that one task takes whole, unless a thousandth of all rows is more
SEGMENT = 1024  # rows of a run that are unrolled at once
ROWS_OUT = 4096

Vector = tuple[int, int, int, int]
INF = 1 << 60
# States: nothing put out, after system, after user, after assistant. A user is next in all but the third.
FOLLOWS = (2, 2, 3, 2)
END: Vector = (0, 2 * INSERT, INSERT, 0)


def symbol(initial: str, fault: int) -> int:
    """A row's symbol; faults that force a deletion are one."""
    return (INITIALS.find(initial) % 4 if initial else 3) * 3 + min(fault, 2)


def kept_as(state: int, sign: int) -> int | None:
    """The state after the row as it is, if it may stand there."""
    return {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((state, sign // 3))


def times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def apply(matrix: tuple, vector: Vector) -> Vector:
    return tuple(min(row[j] + vector[j] for j in range(4)) for row in matrix)


def relative(vector: Vector) -> Vector:
    low = min(vector)
    return tuple(v - low for v in vector)


@cache
def power(sign: int, bit: int) -> tuple:
    """What 2^bit rows of a symbol cost, from state to state, with insertions before each."""
    if bit:
        half = power(sign, bit - 1)
        return times(half, half)
    insert = tuple(tuple(0 if i == j else INSERT if FOLLOWS[i] == j else INF for j in range(4)) for i in range(4))
    step = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        step[state][state] = DELETE
        if sign % 3 < 2:
            worse = TRUNCATED * (sign % 3)
            to = FOLLOWS[state]
            step[state][to] = min(step[state][to], REROLE + worse)
            to = kept_as(state, sign)
            if to is not None:
                step[state][to] = min(step[state][to], worse)
    return times(times(insert, insert), tuple(map(tuple, step)))


@lru_cache(1 << 16)
def back(sign: int, n: int, after: Vector) -> Vector:
    """The least costs to the end before ``n`` rows of a symbol, from those after them, less the least of them."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            after = relative(apply(power(sign, bit), after))
    return relative(after)


def stretch(runs: list[tuple[int, int]]) -> tuple:
    """The matrix of consecutive runs."""
    total = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
    for sign, n in runs:
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                total = times(total, power(sign, bit))
    return total


Edit = tuple[str, tuple, int, int, int]


@lru_cache(1 << 16)
def choose(sign: int, state: int, after: Vector) -> Edit:
    """The cheapest edits up to and with a row, first in ASCII order: (initials, roles put out with None for the row's
    own, which of them has the row's text or -1, cost, next state)."""
    before = apply(power(sign, 0), after)
    letters, roles, cost = "", [], 0
    worse = TRUNCATED * (sign % 3)
    while True:
        rest, to = before[state], FOLLOWS[state]
        role = "assistant" if to == 3 else "user"
        if rest == DELETE + after[state]:
            return letters + "D", tuple(roles), -1, cost + DELETE, state
        if rest == INSERT + before[to]:
            letters, cost, state = letters + "I", cost + INSERT, to
            roles.append(role)
            continue
        stays = kept_as(state, sign) if sign % 3 < 2 else None
        if stays is not None and rest == worse + after[stays]:
            return letters + "K", (*roles, None), len(roles), cost + worse, stays
        return letters + "R", (*roles, role), len(roles), cost + REROLE + worse, to


def finish(state: int) -> tuple[str, tuple, int]:
    """What to insert at the end."""
    roles = []
    while END[state]:
        state = FOLLOWS[state]
        roles.append("assistant" if state == 3 else "user")
    return "I" * len(roles), tuple(roles), INSERT * len(roles)


def collapse(rows: list[tuple]) -> list[tuple[int, int]]:
    """Runs of equal symbols of (symbol, copies): further copies of a row are duplicates, or as blank as the first."""
    runs: list[list[int]] = []
    for sign, copies in rows:
        for sign, n in ((sign, 1), (sign - sign % 3 + 2, copies - 1)):
            if n and runs and runs[-1][0] == sign:
                runs[-1][1] += n
            elif n:
                runs.append([sign, n])
    return [tuple(r) for r in runs]


class Costs:
    """The least costs to the end after each row of some runs, read in order. A run's are made a segment at a time."""

    def __init__(self, runs: list[tuple[int, int]], after: Vector):
        self.runs, self.run, self.done = runs, 0, 0
        self.ends = [after]
        for sign, n in reversed(runs):
            self.ends.append(back(sign, n, self.ends[-1]))
        self.ends.reverse()
        self.segment: list[Vector] = []  # the next rows', last first

    def skip(self, n: int) -> None:
        """Pass rows of one run."""
        del self.segment[max(0, len(self.segment) - n):]
        self.done += n
        if self.done == self.runs[self.run][1]:
            self.run, self.done = self.run + 1, 0

    def following(self) -> Vector:
        """The costs after the next row."""
        if not self.segment:
            sign, n = self.runs[self.run]
            size = min(SEGMENT, n - self.done)
            self.segment.append(back(sign, n - self.done - size, self.ends[self.run + 1]))
            for _ in range(size - 1):
                self.segment.append(back(sign, 1, self.segment[-1]))
        after = self.segment[-1]
        self.skip(1)
        return after


def walk(rows: list[tuple], state: int, after: Vector) -> Iterator[Edit]:
    """The edits of each of the rows (symbol, copies), from a state to costs after the last.

    Those of further copies are deletions: putting an insertion off until after them costs nothing and reads less.
    """
    costs = Costs(collapse(rows), after)
    for sign, copies in rows:
        letters, roles, own, cost, state = choose(sign, state, costs.following())
        if copies > 1:
            costs.skip(copies - 1)
        yield letters + "D" * (copies - 1), roles, own, cost + DELETE * (copies - 1), state


def _filled(column: str) -> Column:
    return F.coalesce(quoted(column).cast("string"), F.lit(" "))


def _marked(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, known, at, role, text, same): ``same`` is a digest of key, role and text."""
    rows = df.select(quoted(key).alias("key"), quoted(turn).isNotNull().alias("known"),
                     F.coalesce(quoted(turn).cast("bigint"), F.lit(0)).alias("at"),
                     _filled(role).alias("role"), _filled(text).alias("text"))
    name = F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit(""))
    return rows.withColumn("same", F.unhex(F.sha2(F.concat(
        F.length(name).cast("string"), F.lit(" "), name, F.length("role").cast("string"), F.lit(" "), "role", "text"),
        256)))


ORDER = ["known", "at", "role", "same"]


def _looks(text: Column) -> Column:
    """The place of a text's own fault in FAULTS."""
    last = F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", 3).when(last.isin(".", "!", "?"), 0).otherwise(1)


def _light(marked: DataFrame) -> DataFrame:
    """Different rows without text, with how many there are of each, and their faults."""
    rows = staged(marked.select("key", "known", "at", "role", "same", _looks(F.col("text")).alias("looks"))
                  .groupBy("key", "known", "at", "role", "same")
                  .agg(F.max("looks").alias("looks"), F.count(F.lit(1)).alias("copies")))
    when = F.struct("known", "at")
    seen = staged(rows.groupBy("same").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("times")))
    fault = F.when(F.col("looks") == 3, 3).when(when != F.col("first"), 2).otherwise(F.col("looks"))
    return join_groups(rows, seen, ["same"], "times", rows.count()).select(
        "key", F.lit(0).alias("part"), "known", "at", "role", "same", "copies", fault.alias("fault"))


def _stretches(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[dict]]]:
    """(part, key, rows) of the stretches of conversations in sorted batches."""
    held: list[dict] = []
    for batch in stream:
        for row in batch.to_pylist():
            if held and (row["part"], row["key"]) != (held[0]["part"], held[0]["key"]):
                yield held[0]["part"], held[0]["key"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["part"], held[0]["key"], held


def _symbols(rows: list[dict]) -> list[tuple[int, int]]:
    return [(symbol(r["role"][:1], r["fault"]), r["copies"]) for r in rows]


def _solved(light: DataFrame, at: dict | None = None) -> DataFrame:
    """The edits of sorted rows; ``at`` has the state before a stretch, the costs after it, and if it is the last."""
    kind = light.schema["key"].dataType.simpleString()
    names = ["key", "part", "place", "known", "at", "same", "copies", "fault", "edits", "cost", "roles", "own"]
    schema = (f"key {kind}, part int, place bigint, known boolean, at bigint, same binary, copies bigint, "
              "fault string, edits string, cost bigint, roles array<string>, own int")
    shared = light.sparkSession.sparkContext.broadcast(at)
    key_type = to_arrow_type(light.schema["key"].dataType)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [key_type, pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(),
                     pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.int32()]
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        place = 0
        for part, key, rows in _stretches(stream):
            state, after, last = (0, END, True) if shared.value is None else shared.value[part, key]
            for number, (row, edit) in enumerate(zip(rows, walk(_symbols(rows), state, after)), 1):
                letters, roles, own, cost, state = edit
                if last and number == len(rows):
                    more = finish(state)
                    letters, roles, cost = letters + more[0], roles + more[1], cost + more[2]
                out.append((key, part, place, row["known"], row["at"], row["same"], row["copies"],
                            FAULTS[row["fault"]], letters, cost, list(roles), own))
                place += 1
                if len(out) >= ROWS_OUT:
                    yield batch()
        if out:
            yield batch()

    return light.mapInArrow(run, schema)


def _chain(light: DataFrame) -> dict:
    """(part, key) -> (state before, costs after, whether it is the last) of the stretches of long conversations.

    There is a stretch per task and long conversation at most: one matrix, then four states, come to the driver for each.
    """
    kind = light.schema["key"].dataType.simpleString()
    key_type = to_arrow_type(light.schema["key"].dataType)

    def summarised(function, width: int) -> dict:
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, key, rows in _stretches(stream):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], key_type), pa.array([part], pa.int32()),
                     pa.array([function(part, key, _symbols(rows))], pa.list_(pa.int64()))], ["key", "part", "found"])

        found = light.mapInArrow(run, f"key {kind}, part int, found array<bigint>").collect()
        return {(r["part"], r["key"]): r["found"] for r in found}

    matrices = summarised(lambda part, key, rows: [min(c, INF) for r in stretch(collapse(rows)) for c in r], 16)
    by_key: dict = {}
    for part, key in sorted(matrices, key=lambda p: p[0]):
        by_key.setdefault(key, []).append(part)
    after: dict = {}
    for key, parts in by_key.items():
        vector = END
        for part in reversed(parts):
            after[part, key] = vector
            m = matrices[part, key]
            vector = relative(apply([m[i:i + 4] for i in range(0, 16, 4)], vector))
    shared = light.sparkSession.sparkContext.broadcast(after)

    def last_states(part: int, key: object, rows: list[tuple]) -> list[int]:
        found = []
        for state in range(4):
            for *_, state in walk(rows, state, shared.value[part, key]):
                pass
            found.append(state)
        return found

    states, chained = summarised(last_states, 4), {}
    for key, parts in by_key.items():
        state = 0
        for part in parts:
            chained[part, key] = state, after[part, key], part == parts[-1]
            state = states[part, key][state]
    return chained


def repair_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 piece: int = PIECE) -> DataFrame:
    """One row per different row of ``df``: (key, part, place, turn, role, text, copies, fault, edits, cost, repaired).

    Rows are taken by turn (nulls first), ties by role and a digest of the text; ``part`` and ``place`` number them in
    that order within a conversation. ``fault`` is that of the first copy; further copies are duplicates, or blank like
    it. ``edits`` are the initials of Keep, Rerole, Delete and Insert for the row and its copies, ``repaired`` the
    (role, text) they put out; insertions at the end stand with the last row. Of the cheapest edits of a conversation
    the first in ASCII order is taken.

    Null roles and texts count as one space, rows of null key as a conversation. Roles are judged by their first
    letter. Other columns are left out; no rows give no rows. ``turn`` is a whole number. A conversation of over
    ``piece`` rows, and more than a thousandth of all, is dealt over many tasks.
    """
    ship(df.sparkSession)
    marked = _marked(df, key, turn, role, text)
    light = staged(_light(marked))
    least = max(piece, light.count() // HOT_SHARE)
    long = staged(light.groupBy("key").count().where(F.col("count") > least).select(
        F.col("key").alias("_key")))  # fewer than HOT_SHARE rows, whatever the data
    same_key = F.col("key").eqNullSafe(F.col("_key"))
    if long.isEmpty():
        solved = _solved(light.repartition("key").sortWithinPartitions("key", *ORDER))
    else:
        short = light.join(F.broadcast(long), same_key, "left_anti")
        pieces = staged(light.join(F.broadcast(long), same_key, "left_semi").repartitionByRange("key", *ORDER)
                        .withColumn("part", F.spark_partition_id() + 1))
        pieces = pieces.repartition("part").sortWithinPartitions("part", "key", *ORDER)
        solved = _solved(short.repartition("key").sortWithinPartitions("key", *ORDER)).unionByName(
            _solved(pieces, _chain(pieces)))
    texts = marked.groupBy("same", "known", "at").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    repaired = F.transform("roles", lambda r, i: F.struct(
        F.coalesce(r, F.col("role")).alias("role"), F.when(i == F.col("own"), F.col("text")).otherwise("").alias("text")))
    return solved.hint("merge").join(texts, ["same", "known", "at"]).select(
        F.col("key").alias(key), "part", "place", F.when(F.col("known"), F.col("at")).alias("turn"), "role", "text",
        "copies", "fault", "edits", "cost", repaired.alias("repaired"))


REPORT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


def repair_report(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation of what `repair_turns` returns: counts, cost, audit and the digest of what stays.

    A conversation's rows stream through one task, in order, because the digest is one over all of them; only the
    initials of its edits are held.
    """
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    key_type = to_arrow_type(rows.schema[key].dataType)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Report | None = None
        for batch in stream:
            for row in batch.to_pylist():
                if now is None or row["key"] != now.key:
                    if now:
                        yield now.batch(key_type)
                    now = _Report(row["key"])
                now.add(row)
        if now:
            yield now.batch(key_type)

    ordered = (rows.select(quoted(key).alias("key"), "part", "place", "turn", F.substring("role", 1, 1).alias("initial"),
                           "copies", "fault", "edits", "cost", "repaired")
               .repartition("key").sortWithinPartitions("key", "part", "place"))
    return ordered.mapInArrow(run, f"key {kind}, {REPORT}").withColumnRenamed("key", key)


class _Report:
    """Counts of one conversation, as its rows come."""

    def __init__(self, key: object):
        self.key = key
        self.digest, self.empty = hashlib.sha256(), True
        self.audit: list[str] = []
        self.counts = dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "cost"], 0)
        self.first = self.last = self.before = None
        self.turns = 0

    def add(self, row: dict) -> None:
        turn, initial, copies, fault = row["turn"], row["initial"], row["copies"], row["fault"]
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = (turn if self.first is None else self.first), turn, self.turns + 1
        if fault:
            self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.counts["illegal"] += copies - 1
        self.before = initial
        self.counts["cost"] += row["cost"]
        self.audit.append(row["edits"])
        for turn in row["repaired"]:
            self.digest.update(f"{'' if self.empty else chr(10)}{turn['role']}:{turn['text']}".encode())
            self.empty = False

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        c = self.counts
        values = [gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"]]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.key], kind), *(pa.array([v], pa.int64()) for v in values),
             pa.array(["".join(self.audit)]), pa.array([self.digest.hexdigest()])],
            ["key", *(f.split()[0] for f in REPORT.split(", "))])
