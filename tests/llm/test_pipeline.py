"""Every stage on documents with all edges, against a plain version; then the pipeline on a driver table."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tableprobe.llm.secret_scan import find_secrets
from tests.llm import cases
from tests.llm.test_line_dedup import plain
from tests.llm.test_simhash import components_of, fingerprint
from tests.oracle import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def documents(spark):
    return cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars", "key", "score")


def test_five_stages_in_order():
    assert [name for name, _ in pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]


def test_quality_keeps_columns_and_good_rows(spark, documents):
    kept = pipeline.filter_quality(spark, documents, cases.SF_DIR)
    assert kept.columns == documents.columns
    rows = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert rows <= Counter(cases.texts())


def test_thinned_lines(spark, documents):
    rows = pipeline.thin_lines(spark, documents, cases.SF_DIR).collect()
    found = plain(cases.texts())
    expected = Counter()
    for d in cases.texts():
        text, lines, spans = found[d]
        if not (spans and sum(b - a for a, b in spans) == lines):
            expected[d[0], text] += 1
    assert Counter((r["doc_id"], r["text"]) for r in rows) == expected
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def test_one_of_each_group_of_near_copies(spark, documents):
    rows = pipeline.drop_near_copies(spark, documents, cases.SF_DIR).collect()
    marks = {t: fingerprint(t) for _, t in cases.texts()}
    label = components_of(sorted(set(marks.values())))
    kept = Counter(label[marks[r["text"]]] for r in rows)
    assert set(kept.values()) == {1} and set(kept) == set(label.values())


def test_secrets_are_marked(spark, documents):
    rows = pipeline.remove_secrets(spark, documents, cases.SF_DIR).collect()
    assert len(rows) == len(cases.texts())
    assert not any(find_secrets(r["text"] or "") for r in rows if r["doc_id"] != 19)
    texts = dict(cases.texts())
    assert all(r["text"] == texts[r["doc_id"]] for r in rows if r["doc_id"] in (1, 2, 8, 13, 17))


@pytest.mark.parametrize("number", range(1, 5))
def test_no_rows(spark, number):
    empty = cases.frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    assert pipeline.STAGES[number][1](spark, empty, cases.SF_DIR).count() == 0


def test_whole_pipeline(spark):
    rows = pipeline.run(spark, cases.SF_DIR).collect()
    assert 100 < len({r["doc_id"] for r in rows}) < 200
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024


def test_queries_with_sql(spark):
    from tableprobe.llm.queries import ORACLES, QUERIES
    duck = connect(cases.SF_DIR)
    assert set(ORACLES) <= set(QUERIES)
    for name, sql in ORACLES.items():
        assert spark_rows(QUERIES[name](spark, cases.SF_DIR)) == sql_rows(duck, sql), name


def test_registered():
    import __spark_entry__ as contract
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
