import math

import pytest

from quillmark.llm import op4_mixing as op4
from tests.llm.conftest import SF


def table(rows):
    """source -> (tokens, taken tokens, weight, repetition, copies of each document)"""
    out = {}
    for r in rows:
        t = out.setdefault(r.s, [0, 0, r.weight, r.repetition, []])
        t[0] += r.n
        t[1] += r.n * (r.passes + r.extra)
        t[4].append(r.passes + r.extra)
    return out


def brute_exponent(tokens, good):
    """The edge of ``good`` (a predicate of the exponent) in the unit interval, by plain bisection."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) == good(0.0) else (low, mid)
    return (low + high) / 2


def entropy(tokens, a):
    w = [t**a for t in tokens]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def test_query_takes_every_document_within_the_limit(spark):
    rows = op4.query(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(rows) == 1000 and abs(sum({r.source: r.weight for r in rows}.values()) - 1) < 1e-9
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [0, 0])
        t[0] += r.n_tokens
        t[1] += r.n_tokens * r.copies
        assert 1 <= r.copies <= 2 and 1.0 <= r.repetition <= op4.MAX_REPETITION + 1e-6
    least, most = min(t[0] for t in by.values()), max(t[0] for t in by.values())
    a = brute_exponent(None, lambda a: (most / least) ** (1 - a) > op4.MAX_REPETITION)
    total = sum(t[0] ** a for t in by.values())
    for r in rows:
        assert abs(r.weight - by[r.source][0] ** a / total) < 1e-6
        assert abs(r.repetition - (most / by[r.source][0]) ** (1 - a)) < 1e-5
    largest = max(r.n_tokens for r in rows)
    for tokens, taken in by.values():
        wanted = tokens * (most / tokens) ** (1 - a)
        assert wanted - largest - 1 <= taken <= wanted + 1


@pytest.mark.parametrize("budget", [0.5, 3.0])
def test_entropy_target_and_budget(spark, monkeypatch, budget):
    monkeypatch.setattr(op4, "BLOCK_ROWS", 7)
    monkeypatch.setattr(op4, "GROUP_BLOCKS", 4)
    sizes = {"a": 300, "b": 40, "c": 10, "d": 1}
    rows = [(k, f"{'w ' * (1 + k % 9)}{s}", s) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sized = op4.sized(docs)
    found = table(op4.plan(sized, target_entropy=1.1, budget=budget).collect())
    tokens = {s: t[0] for s, t in found.items()}
    a = brute_exponent(None, lambda a: entropy(tokens.values(), a) >= 1.1)
    z, total = sum(t**a for t in tokens.values()), sum(tokens.values())
    for s, (t, taken, weight, repetition, copies) in found.items():
        assert abs(weight - t**a / z) < 1e-6 and abs(repetition - weight * budget * total / t) < 1e-6
        wanted = weight * budget * total
        assert wanted - 11 - 1 <= taken <= wanted + 1e-6
        assert max(copies) - min(copies) <= 1
    again = table(op4.plan(op4.sized(docs.repartition(3)), target_entropy=1.1, budget=budget).collect())
    assert {s: sorted(t[4]) for s, t in again.items()} == {s: sorted(t[4]) for s, t in found.items()}


def test_odd_rows(spark):
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, "x y", None, 0), (None, "z", None, 0), (4, "q", "a", 0), (4, "q", "a", 0), (5, None, "empty", 0), (6, "w " * 100_000, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = op4.query(docs).collect()
    assert len(got) == 8 and all(r.copies >= 1 for r in got)
    assert {r.source for r in got} == {"a", None, "empty"} and {r.weight for r in got if r.source == "empty"} == {0.0}
    out = op4.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert op4.query(docs.limit(0)).count() == 0 and op4.mixed(docs.limit(0)).count() == 0
    blank = docs.where("doc_id in (1, 2, 5)")
    assert {r.copies for r in op4.query(blank).collect()} == {1}
