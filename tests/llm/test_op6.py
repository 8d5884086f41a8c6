import hashlib
import random

import pytest

from quillmark.llm import op6_line_dedup as op6
from tests.llm.conftest import SF


def brute(rows, lines=4, words=50):
    """{row number: set of deleted lines} by looking at all windows in order; rows are sorted."""
    seen, gone = set(), {}
    for k, (_, text) in enumerate(rows):
        gone[k] = set()
        ls = text.split("\n") if text is not None else []
        for i in range(len(ls)):
            for n in range(1, lines + 1):
                w = tuple(ls[i : i + n])
                if len(w) == n and (n == lines or sum(len(x.split()) for x in w) >= words):
                    if w in seen:
                        gone[k].update(range(i, i + n))
                    seen.add(w)
    return gone


def kept(text, gone):
    return None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    gone = brute(rows)
    got = sorted(op6.query(docs).collect())
    assert [(r.doc_id, r.n_lines, r.n_deleted, r.kept_sha256) for r in got] == [
        (i, t.count("\n") + 1, len(gone[k]), hashlib.sha256(kept(t, gone[k]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)
    ]
    assert any(gone.values())


@pytest.mark.parametrize("lines, words", [(1, 99), (2, 3), (3, 4), (4, 5), (5, 4), (8, 6)])
def test_any_depth(spark, lines, words):
    rng = random.Random(lines)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c", ""]) for _ in range(rng.randrange(14)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute(rows, lines, words)
    got = {r.doc_id: r.text for r in op6.without_repeats(docs, least_lines=lines, least_words=words).collect()}
    assert got == {i: kept(t, gone[k]) for k, (i, t) in enumerate(rows)}


def test_odd_rows(spark):
    para = "\n".join(f"line {k} of a passage that several documents have in common" for k in range(6))
    long = "word " * 60
    rows = [(1, para, 1), (2, "own\n" + para + "\nown too", 1), (None, para, 1), (3, None, 1), (4, "", 1), (5, "", 1), (6, long, 1), (6, long, 1), (7, "x\n" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, i int")
    out = op6.without_repeats(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[None] == [para] and got[1] == [""] and got[2] == ["own\nown too"] and got[3] == [None] and got[4] == got[5] == [""]
    assert sorted(got[6]) == ["", long] and got[7] == ["x\n"]  # windows may overlap their earlier copy
    assert op6.query(docs.limit(0)).count() == 0
