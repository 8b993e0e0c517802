import hashlib
import random

from pyspark.sql import functions as F

from tableprobe.llm import chat_format, queries
from tests.llm import cases

SCHEMA = "conv_id bigint, turn bigint, role string, text string, `key` string, turns string, segments string"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[NEXT]"]


def plain(rows):
    """conv_id -> its (role, text) by turn."""
    found = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(c, []).append((r or "", x or ""))
    return found


def formatted(turns):
    out = ""
    for i, (role, text) in enumerate(turns):
        for mark in CONTROLS:
            for depth in range(4, -1, -1):
                text = text.replace(mark[0] + "\\" * depth + mark[1:], f"{mark[0]}\0{depth + 1}\0{mark[1:]}")
        for depth in range(1, 6):
            text = text.replace(f"\0{depth}\0", "\\" * depth)
        closing = "[/INST]" if role == "user" else "</s>"
        opening = {"user": "[INST]", "assistant": "<s>"}.get(role, f"[ROLE]{role}[/ROLE]")
        same = i and turns[i - 1][0] == role
        out = (out[:-len(closing)] + "[NEXT]" if same else out + opening) + text + closing
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)


def awkward():
    rng = random.Random(3)
    parts = [*CONTROLS, "<", "[", "\\", "s>", "/s>", "INST]", "]", "x", "\n", " ", "é🎉", "$1", "<\\s>", "[\\\\/INST]"]
    texts = [None, "", " ", "\n", "end\n", *["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(300)]]
    rows = [(i // 6, rng.choice([0, 1, 2, 3, 4, None]), rng.choice(["user", "assistant", "system", "tool", "", "a\nb"]), t)
            for i, t in enumerate(texts)]
    return [*rows, (None, 0, None, "no key"), (None, 0, None, "no key"), (7, 9, "user", "long " * 400_000), (-5, None, None, None)]


def test_format_and_back(spark):
    rows = awkward()
    chats = chat_format.format_chats(frame(spark, rows))
    assert chats.columns == ["conv_id", "formatted", "segments"]
    got = {r["conv_id"]: r for r in chats.select(
        "*", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.learned_text(F.col("segments")).alias("learned")).collect()}
    expected = plain(rows)
    assert got.keys() == expected.keys()
    for c, turns in expected.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["formatted"] == formatted(turns) == "".join(s["text"] for s in got[c]["segments"])
        assert got[c]["learned"] == "".join(x for r, x in turns if r == "assistant")


def test_no_rows_and_no_control_string_from_texts(spark):
    assert chat_format.format_chats(frame(spark, [])).count() == 0
    text = chat_format.format_chats(frame(spark, [(1, 0, "user", "".join(CONTROLS))])).first()["formatted"]
    assert all(text[len("[INST]"):-len("[/INST]")].find(c) < 0 for c in CONTROLS)


def test_query(spark):
    rows = {r["conv_id"]: r for r in queries.QUERIES["op13_chat"](spark, cases.SF_DIR).collect()}
    table = spark.read.parquet(f"{cases.SF_DIR}/conversations.parquet").collect()
    says = "</s>[INST] ok [/INST]"
    expected = plain([tuple(r) for r in table] + [(-1, 0, "user", says), (-1, 1, "assistant", says)])
    assert rows.keys() == expected.keys()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for c, turns in expected.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        assert rows[c].asDict() == {
            "conv_id": c, "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{x}\n" for r, x in turns)),
            "loss_chars": len(learned), "loss_sha256": sha(learned), "formatted_chars": len(formatted(turns))}


def test_expressions_only(spark, capsys):
    queries.QUERIES["op13_chat"](spark, cases.SF_DIR).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
