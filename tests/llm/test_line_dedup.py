from collections import Counter

from tableprobe.llm.line_dedup import line_dedup
from tests.llm import cases


def plain(documents):
    """(id, text) -> kept text and spans; a row listed twice is one document."""
    first, found = set(), {}
    for i, t in sorted(set(documents), key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at:at + 3])
            if window in first:
                gone |= {at, at + 1, at + 2}
            first.add(window)
        edges = [j for j in gone if j - 1 not in gone], [j + 1 for j in gone if j + 1 not in gone]
        spans = list(zip(*map(sorted, edges)))
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else t
        found[i, t] = (kept, len(lines), spans)
    return found


def test_later_windows_go(spark):
    documents = [d for d in cases.texts() if d != (None, cases.texts()[8][1])]
    df = cases.frame(spark, documents)
    result = line_dedup(df)
    assert result.columns == [c for c in df.columns if c != "spans"] + ["n_lines", "spans"]
    expected = plain(documents)
    rows = result.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in documents)
    got = Counter((r["doc_id"], r["text"], r["n_lines"], str([tuple(s) for s in r["spans"]])) for r in rows)
    want = Counter()
    for i, t in documents:
        kept, lines, spans = expected[i, t]
        want[i, kept, lines, str(spans)] += 1
    assert got == want
    assert any(spans for _, _, spans in expected.values())
    assert line_dedup(cases.frame(spark, [])).count() == 0


def test_one_window_that_most_rows_hold(spark):
    documents = [(i, f"start {i}\n{cases.PASSAGE}\nend {i}") for i in range(300)]
    rows = {r["doc_id"]: r for r in line_dedup(cases.frame(spark, documents)).collect()}
    assert rows[0]["text"] == documents[0][1] and not rows[0]["spans"]
    assert all(rows[i]["text"] == f"start {i}\nend {i}" for i in range(1, 300))
