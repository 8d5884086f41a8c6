import re

import numpy as np
import xxhash

from quillmark.llm import op3_simhash_dedup as op3
from quillmark.operators.graph import components
from tests.llm.conftest import SF


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], fps)
    got = sorted(map(tuple, op3.query(docs).collect()))
    assert got == [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (4, "One two"), (None, "one TWO"), (None, "x y"), (7, "w " * 300_000)]
    docs = spark.createDataFrame([(i, t, "e", 9) for i, t in rows], "doc_id long, text string, fp string, key long")
    got = op3.query(docs).collect()
    assert len(got) == 8
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[1, "0" * 16] == by[2, "0" * 16] == by[3, "0" * 16] == 1
    assert {r.component_id for r in got if r.doc_id == 4} == {4}
    kept = op3.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 7]
    assert op3.query(docs.limit(0)).count() == 0


def test_buckets_and_midpoints_agree(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = {int(b) for b in base}
    for b in base[:20]:
        x = int(b) & (2**64 - 1)
        for _ in range(15):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    comps = brute_components(fps, [f & (2**64 - 1) for f in fps])
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def classes(edges):
        root = {r.node: r.root for r in components(edges).collect()}
        return {tuple(sorted(g)) for g in _groups(fps, [root.get(f, f) for f in fps])}

    want = {tuple(sorted(g)) for g in _groups(fps, comps)}
    assert classes(op3.links(df)) == want
    assert classes(op3.links(df, bucket=2)) == want
    assert classes(op3.midpoint_links(df)) == want


def _groups(keys, labels):
    out = {}
    for k, v in zip(keys, labels):
        out.setdefault(v, []).append(k)
    return out.values()


def test_components_of_a_path(spark):
    n = 60
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
