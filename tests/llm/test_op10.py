import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillmark.llm import op10_fingerprints as op10
from tests.llm.conftest import SF


def expected(rows):
    """doc_id, n_chars and the edited text, for rows (doc_id, text) in order."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return out


def terms(text):
    words = re.split("[ \t\n\r\f\x0b]+", text.strip(" \t\n\r\f\x0b").lower())
    return list(zip(words, words[1:])) if len(words) > 1 else [(words[0], "")] if words[0] else []


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 1").repartition(5)
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    got = sorted(op10.query(docs).collect())
    assert [tuple(r)[:3] for r in got] == expected(rows)
    every = {t for _, x in rows for t in terms(x)}
    hashed = spark.createDataFrame([(a, b) for a, b in every], "a string, b string")
    hashes = {(r.a, r.b): (r.h % 2**64) << 64 | (r.g % 2**64) for r in hashed.select("a", "b", F.xxhash64("a", "b").alias("h"), F.xxhash64(F.lit(1), "a", "b").alias("g")).collect()}
    fps = []
    for _, text in rows:
        hs = [hashes[t] for t in terms(text)]
        fps.append(sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    assert [int(r.fingerprint, 16) for r in got] == fps
    for k, r in enumerate(got):
        assert r.near_next == 1 - (fps[k] ^ fps[(k + 1) % len(fps)]).bit_count() / 128
        assert r.near_edited == 1 - (fps[k] ^ int(r.edited_fingerprint, 16)).bit_count() / 128
    pairs = sum(r.near_edited > r.near_next for r in got)
    assert pairs > 0.95 * len(got)


def test_odd_rows(spark):
    rows = [(None, "x \U0001f600 y"), (1, None), (2, ""), (3, "Same text here"), (3, "Same text here"), (5, "ß" * 7), (6, "word " * 200_000), (7, "same Text  here\n")]
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, hi int")
    got = op10.query(docs).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted((tuple(r)[:3] for r in got), key=order) == sorted(expected(rows), key=order)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[1] == by[2] == {"0" * 32} and by[3] == by[7] and all(len(v) == 1 for v in by.values())
    assert op10.query(docs.limit(0)).count() == 0
    one = op10.query(docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_near_finds_all_within_radius(spark):
    import random

    rng = random.Random(3)
    fps = [rng.getrandbits(128) for _ in range(30)]
    for f in list(fps):
        for d in range(1, 9):
            for bit in rng.sample(range(128), d):
                f ^= 1 << bit
            fps.append(f)
    fps += fps[:3]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f >> 64), signed(f & (2**64 - 1))) for f in fps], "hi long, lo long")
    got = {((r.q_hi % 2**64) << 64 | r.q_lo % 2**64, (r.hi % 2**64) << 64 | r.lo % 2**64) for r in op10.near(df, df).collect()}
    assert got == {(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= op10.RADIUS}
    with pytest.raises(ValueError):
        op10.near(df, df, 7)


def test_rows_of_one_id_are_spread(spark):
    rows = [(7, f"text {k}") for k in range(10_000)] + [(None, f"none {k}") for k in range(10_000)] + [(1, "a"), (9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = op10.with_next(docs)
    sizes = [r.n for r in got.groupBy(F.shiftright("rid", 40).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 4 * sorted(sizes)[len(sizes) // 2]
    found = {r.rid: r for r in got.collect()}
    assert len(found) == 20_002
    r, seen = found[min(found)], []
    while r.rid not in seen[:1]:  # a ring through all rows
        seen.append(r.rid)
        assert found[r.next_rid].text == r.next_text
        r = found[r.next_rid]
    assert len(seen) == 20_002 and [found[k].doc_id for k in seen[:10_000]] == [None] * 10_000 and [found[k].doc_id for k in (seen[10_000], seen[-1])] == [1, 9]
