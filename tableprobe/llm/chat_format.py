r"""Chat formatting by Spark expressions alone: conversations become one string each, with a mask of what to learn.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a block:

    user        [INST]text[NEXT]text[/INST]
    assistant   <s>text[NEXT]text</s>
    other       [ROLE]name[/ROLE]text[NEXT]text</s>

Inside texts and names a control string gets a backslash after its first character, and one that has backslashes there
already gets one more, so every text comes back as it was, and no text can end its turn or open another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import quoted

NEXT = "[NEXT]"
# The start of a control string, before what follows it: any number of backslashes, or at least one.
START = r"(<(?=\\{0}/?s>)|\[(?=\\{0}(?:/?INST|/?ROLE|NEXT)\]))"
OPENERS = r"<s>|\[INST\]|\[ROLE\]"
TURN = "struct<role:string,text:string>"
SEGMENT = "struct<text:string,loss:boolean>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, START.format("*"), r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, START.format("+") + r"\\", "$1")


def _opening(role: Column) -> Column:
    return (F.when(role == "user", "[INST]").when(role == "assistant", "<s>")
            .otherwise(F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]"))))


def _segments(turns: Column) -> Column:
    """The marks and texts of one block, in order; the texts of an assistant are under the mask."""
    role = F.element_at(turns, 1)["role"]
    learned = role == "assistant"

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss")).cast(SEGMENT)

    def of_turn(turn: Column, at: Column) -> Column:
        mark = segment(F.when(at > 0, NEXT).otherwise(_opening(role)), F.lit(False))
        return F.array(mark, segment(escaped(turn["text"]), learned))

    closing = segment(F.when(role == "user", "[/INST]").otherwise("</s>"), F.lit(False))
    return F.concat(F.flatten(F.transform(turns, of_turn)), F.array(closing))


def format_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per conversation: (key, formatted, segments).

    ``formatted`` is the concatenation of ``segments``; those with ``loss`` hold the assistant's texts, escaped, and
    nothing else. Turns are taken by ``turn`` (nulls first), those that tie by role and text; equal rows all stay. A null
    text or role is an empty one; rows of null ``key`` are a conversation too. Other columns are left out. No rows give
    no rows. A conversation is one string, so it has to fit into a row (2 GB).
    """
    def filled(column: str) -> Column:
        return F.coalesce(quoted(column).cast("string"), F.lit(""))

    row = F.struct(quoted(turn).isNotNull().alias("known"), quoted(turn).alias("turn"),
                   filled(role).alias("role"), filled(text).alias("text"))
    chats = df.groupBy(quoted(key).alias("key")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    turns, starts = F.col("turns"), F.col("starts")
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    chats = chats.withColumn("starts", F.filter(
        places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])))
    blocks = F.transform(starts, lambda start, at: F.slice(
        turns, start + 1, F.coalesce(F.get(starts, at + 1), F.size(turns)) - start))
    chats = chats.select("key", blocks.alias("blocks"))
    chats = chats.select("key", F.flatten(F.transform("blocks", _segments)).alias("segments"))
    return chats.select(F.col("key").alias(key),
                        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    def of_block(block: Column) -> Column:
        head = F.regexp_extract(block, rf"(?s)^(?:\[ROLE\](.*?)\[/ROLE\]|{OPENERS})", 0)
        name = F.when(head == "[INST]", "user").when(head == "<s>", "assistant").otherwise(
            unescaped(F.substring(head, F.lit(len("[ROLE]") + 1), F.length(head) - len("[ROLE][/ROLE]"))))
        foot = F.when(head == "[INST]", len("[/INST]")).otherwise(len("</s>"))
        body = F.substring(block, F.length(head) + 1, F.length(block) - F.length(head) - foot)
        return F.transform(F.split(body, r"\[NEXT\]"), lambda t: F.struct(
            name.alias("role"), unescaped(t).alias("text")).cast(TURN))

    return F.flatten(F.transform(F.split(formatted, f"(?={OPENERS})"), of_block))


def learned_text(segments: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def with_example(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """The rows, and a conversation -1 whose two turns are made of control strings."""
    says = "</s>[INST] ok [/INST]"
    rows = df.select(key, "turn", "role", "text")
    example = reduce(DataFrame.unionAll, [
        df.sparkSession.range(1).select(F.lit(-1), F.lit(at), F.lit(who), F.lit(says))
        for at, who in enumerate(["user", "assistant"])])
    return rows.unionAll(example.toDF(*rows.columns).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))
