import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableprobe.llm import language_id
from tableprobe.llm.language_id import CODE_BITS, Ranker, learn_profiles, ngrams, predict_language
from tableprobe.llm.queries import QUERIES
from tests.llm import cases


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = []
    for w in words:
        found += list(w)
    spaced = " " + " ".join(words) + " "
    found += [spaced[i:i + 2] for i in range(len(spaced) - 1)] if words else []
    found += [spaced[i:i + 3] for i in range(len(spaced) - 2) if spaced[i + 1] != " "] if words else []
    return Counter(sum(ord(c) << CODE_BITS * (len(g) - 1 - k) for k, c in enumerate(g)) for g in found)


@pytest.mark.parametrize("text", ["", "  ", "1 2", "a", "Ab, cd-ef", "Été à Ñ 日本", "İ x"])
def test_ngrams(text):
    assert Counter(ngrams(text).tolist()) == plain_ngrams(text)


def test_distance_is_out_of_place():
    ranker = Ranker({"a": [1, 2, 3], "b": [3, 2, 1], "c": [9]}, size=5)
    ranker_text = {"x": [1, 2, 3]}
    assert ranker.ranks[0].tolist() == [0, 2, -1] and ranker_text
    assert Ranker({}).predict("abc") == ("und", 0.0)


def test_rows(spark):
    learn = [(i, w * 3) for i, w in enumerate(["the house and the garden ", "der hund und die katze "] * 5)]
    df = cases.frame(spark, learn).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(
        F.col("doc_id") < 9, "de"))
    profiles = learn_profiles(df, F.lit(True))
    counted = Counter()
    for i, t in learn:
        if i % 2 == 0:
            counted += plain_ngrams(t)
    assert profiles["en"] == [g for g, _ in sorted(counted.items(), key=lambda c: (-c[1], c[0]))][:400]
    rows = {(r["doc_id"], r["text"]): r for r in predict_language(cases.frame(spark), profiles).collect()}
    assert len(rows) == len(set(cases.texts()))
    assert (rows[1, None]["lang_pred"], rows[1, None]["score"]) == ("und", 0.0)
    assert rows[20, "0123456789abcdef0123"]["lang_pred"] in ("de", "en") and rows[2, ""]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert predict_language(cases.frame(spark, []), profiles).count() == 0
    assert learn_profiles(cases.frame(spark, []), F.lit(True)) == {}


def plain_prediction(text, profiles, size=400):
    """Language and score by the out-of-place distance, n-gram by n-gram; ties go to the first name."""
    found = plain_ngrams(text or "")
    if not found or not profiles:
        return "und", 0.0
    own = sorted(found, key=lambda g: (-found[g], g))[:size]
    distances = {}
    for name, profile in profiles.items():
        place = {g: i for i, g in enumerate(profile)}
        distances[name] = sum(abs(place[g] - i) if g in place else size for i, g in enumerate(own))
    best = min(sorted(distances), key=distances.get)
    return best, 1 - distances[best] / (size * len(own))


def test_predictions_against_plain_distances(spark):
    rows = spark.read.parquet(f"{cases.SF_DIR}/documents.parquet").collect()
    counts = {}
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            counts.setdefault(r["lang"], Counter()).update(plain_ngrams(r["text"] or ""))
    profiles = {n: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:400] for n, c in counts.items()}
    got = {r["doc_id"]: r for r in QUERIES["op6_language"](spark, cases.SF_DIR).collect()}
    for r in rows:
        name, score = plain_prediction(r["text"], profiles)
        assert got[r["doc_id"]]["lang_pred"] == name and abs(got[r["doc_id"]]["score"] - score) < 1e-12


def test_ties_go_to_the_first_name(spark):
    grams = [g for g, _ in plain_ngrams("abba").most_common()]
    profiles = {"zz": grams, "aa": list(grams), "mm": grams[::-1]}
    rows = predict_language(cases.frame(spark), profiles).collect()
    for r in rows:
        assert (r["lang_pred"], round(r["score"], 12)) == tuple(
            round(v, 12) if isinstance(v, float) else v for v in plain_prediction(r["text"], profiles))
    assert {r["lang_pred"] for r in rows} == {"aa", "und"} or {r["lang_pred"] for r in rows} == {"aa", "mm", "und"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    df = spark.range(8).selectExpr("id AS doc_id", "'text here' AS text", "string(id % 4) AS lang")
    with pytest.raises(ValueError):
        learn_profiles(df, F.lit(True))
    assert set(learn_profiles(df, F.col("lang") != "3")) == {"0", "1", "2"}


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{cases.SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op6_language"](spark, cases.SF_DIR).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in truth}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
