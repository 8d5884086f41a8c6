import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quillmark.llm import near_copies
from tests.llm.conftest import SF


def brute_shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Least ids of the groups of rows (id, text) that pairs of Jaccard >= 0.8 connect; and those pairs' number."""
    held = [brute_shingles(t) for _, t in rows]
    root, n = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(held[i] & held[j]) >= 4 * (len(held[i]) + len(held[j])):
                n += held[i] != held[j]
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(i for k, (i, _) in enumerate(rows) if find(k) == k), n


def test_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    want, pairs = brute_kept(rows)
    stage = corpus_pipeline.near_dedup(spark, docs, SF)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == want and pairs > 0


def test_chains_groups_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(10**9)}"
    texts = []
    for _ in range(30):
        text = [word() for _ in range(120)]
        for _ in range(8):  # a chain: each differs a little more from the first
            texts.append(" ".join(text))
            text[rng.integers(120)] = word()
    rows = [(i, t) for i, t in enumerate(texts)]
    want, pairs = brute_kept(rows)
    assert pairs > 300 and len(want) < 60
    odd = [(1000, None), (1001, ""), (1002, "one two"), (None, "ONE  two"), (None, "x y"), (1003, "one two three")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    got = [r.doc_id for r in near_copies.one_of_each(docs).collect()]
    assert sorted(-1 if i is None else i for i in got) == [-1, *want, 1000, 1002, 1003]
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_a_large_group_of_unlike_variants(spark):
    """Variants of one text, from nearly alike to hardly alike: those out of reach of each other stay apart."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(160):
        text = list(base)
        for at in rng.integers(0, 150, k // 16):
            text[at] = f"v{rng.integers(10**9)}"
        texts.append(" ".join(text))
    want, pairs = brute_kept(list(enumerate(texts)))
    assert 50 < len(want) < 140 and pairs > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_odd_parts_bound_the_difference(a, b):
    x, y = (near_copies.odd_parts(np.array(sorted(s), np.uint64)) for s in (a, b | set(list(a)[: len(a) // 2])))
    b = b | set(list(a)[: len(a) // 2])
    assert len(x) == near_copies.PARTS // 64
    assert sum((int(p) ^ int(q)).bit_count() if (int(p) ^ int(q)) >= 0 else ((int(p) ^ int(q)) & (2**64 - 1)).bit_count() for p, q in zip(x, y)) <= len(a ^ b)


def test_long_texts_of_many_words(spark):
    words = [f"w{k * 7919 % 50_021}" for k in range(60_000)]
    near = [*words[:30_000], *(f"x{k}" for k in range(400)), *words[30_400:]]
    far = [*words[:20_000], *(f"y{k}" for k in range(40_000))]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in ((1, words), (2, near), (3, far), (4, words[:300]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [1, 3, 4]


def test_simhash_proposes_pairs(spark):
    """What op3 links is met where no band is shared; the whole sets still decide."""
    words = [f"w{k * k % 9973}" for k in range(4000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"x{k}" for k in range(500)), "w0", "w0 " * 6, "w0 w0 w0 w0 w0 w1"]
    held = [near_copies.shingle_set(t) for t in texts]
    prints = [near_copies.op3.fingerprint(near_copies.shingle_hashes(t)) for t in texts]
    assert ((prints[0] ^ prints[1]) & (2**64 - 1)).bit_count() <= near_copies.op3.RADIUS
    node = [near_copies.node_of(h) for h in held]
    sets = spark.createDataFrame([(n, h.view(np.int64).tolist()) for n, h in zip(node, held)], "node long, held array<long>")
    # no two have a band in common
    nodes = spark.createDataFrame([(n, len(h), [8 * k], near_copies.odd_parts(h).tolist()) for k, (n, h) in enumerate(zip(node, held))], "node long, n int, keys array<long>, odd array<long>")
    first = near_copies.simhash_pairs(spark.createDataFrame(list(zip(node, prints)), "node long, fp long"))
    found = near_copies.links(nodes, lambda wanted: sets.join(wanted, "node"), first=first)
    assert {(r.node, r.root) for r in found.collect()} == {(n, min(node[:2])) for n in node[:2]}
    assert [tuple(r) for r in near_copies.links(nodes, lambda wanted: sets.join(wanted, "node")).collect()] == []
