"""Whole results against plain Python where the other tests look at parts of them."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import op4_mixing as op4
from quillmark.llm import op7_secrets as op7
from quillmark.llm import op8_toxicity as op8
from quillmark.llm import op10_fingerprints as op10
from tests.llm.conftest import SF

SMALL = "/root/testdata/sf0.001"


def convolved(model, text):
    """The classifier's score of one text, filter by filter and place by place."""
    words = [w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower()) if w]
    crc = zlib.crc32
    vectors = [model.embed[[crc(w) % op8.BUCKETS, crc(w[:4], 1) % op8.BUCKETS, crc(w[:6], 2) % op8.BUCKETS]].sum(axis=0) for w in words]
    pad = np.zeros(op8.DIM)
    pooled = []
    for kernel, bias in zip(model.kernels, model.biases):
        width = len(kernel)
        at = [sum((vectors[i + o] if i + o < len(vectors) else pad) @ kernel[o] for o in range(width)) for i in range(max(1, len(vectors)))]
        pooled += list(np.maximum(np.max(at, axis=0) + bias, 0))
    return 1 / (1 + np.exp(-(np.array(pooled) @ model.out + model.out_bias)))


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = op8.fit(docs, labels)
    some = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r.score for r in op8.scored(some, model, keep=["doc_id"]).collect()}
    for r in some.collect():
        assert abs(got[r.doc_id] - convolved(model, r.text)) < 1e-4
    kept = {r.doc_id for r in op8.reject(some, model).collect()}
    assert kept == {r.doc_id for r in some.collect() if got[r.doc_id] < model.thresholds.get(r.lang, op8.THRESHOLD)}


def test_thresholds_have_the_least_weighted_error():
    rng = np.random.default_rng(4)
    langs = np.array(["a"] * 120 + ["b"] * 120 + ["c"] * 30, object)
    y = (rng.random(270) < 0.4).astype(np.float32)
    score = np.clip(y * 0.5 + rng.random(270) * 0.6 + (langs == "b") * 0.2, 0, 1)
    weight = np.where(y == 1, 0.3, 1.0)
    got = op8._thresholds(score, y, weight, langs)
    grid = [round(0.05 * k, 2) for k in range(1, 20)]
    for lang, t in got.items():
        of = langs == lang
        error = lambda t: (weight[of] * ((score[of] >= t) != (y[of] == 1))).sum()  # noqa: E731, B023
        assert error(t) == min(map(error, grid))
    assert {"a", "b"} <= set(got) and (30 >= 40 or "c" not in got)


def test_markov_spans(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + k, f"key {s} end, {s}") for k, s in enumerate(["xK9pQ2vL8mN4rT7wZ3bY6cF1", "internationalization_of_things", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA=="])], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    model = op7.fit(docs)
    at = {c: k + 1 for k, c in enumerate(op7.CLASSES)}
    found = 0
    for r in op7.query(docs).join(docs, "doc_id").collect():
        base = op7.base_spans(r.text or "")
        want = list(base)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", r.text or ""):
            ids = [0, *(at[c] for c in m.group())]
            score = sum(model.ratio[a, b] for a, b in zip(ids, ids[1:]))
            if score > model.threshold and not any(a <= m.start() and m.end() <= b for a, _, b in base):
                want.append((m.start(), 3, m.end()))
        found += len(want) - len(base)
        assert r.spans == op7.listed(want)
    assert found >= 4


def test_copies_follow_the_permutation(spark, monkeypatch):
    monkeypatch.setattr(op4, "BLOCK_ROWS", 9)
    monkeypatch.setattr(op4, "GROUP_BLOCKS", 3)
    sizes = {"a": 200, "b": 60, "c": 25}
    rows = [(k * 7, f"{'w ' * (1 + k % 11)}{s}", s) for s, n in sizes.items() for k in range(n)] + [(3, "same row here", "c")] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("th"), F.concat(F.lit("="), "source").alias("s"), F.size(F.split("text", " ")).alias("n"))
    blocks = len(rows) // 9
    hashed = keyed.withColumn("block", F.pmod(F.xxhash64(F.lit(op4.SEED), "doc_id", "th"), F.lit(blocks))).withColumns(
        {"turn": F.xxhash64(F.lit(op4.SEED + 1), "s", "block"), "order": F.xxhash64(F.lit(op4.SEED + 2), "doc_id", "th")}
    )
    known = sorted(hashed.collect(), key=lambda r: (r.source, r.turn % (blocks // 3), r.turn, r.block, r.order, r.doc_id, r.th))
    got = {}
    for r in op4.query(docs).collect():
        got.setdefault((r.source, r.doc_id), []).append(r.copies)
    often = {r.source: r.repetition for r in op4.query(docs).select("source", "repetition").distinct().collect()}
    want = {}
    for s in sizes:
        mine = [r for r in known if r.source == s]
        tokens = sum(r.n for r in mine)
        passes = int(often[s])
        left, open_ = int((often[s] - passes) * tokens), True
        for r in mine:
            open_ = open_ and r.n <= left
            left -= r.n if open_ else 0
            want.setdefault((s, r.doc_id), []).append(passes + open_)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_fingerprints_of_edited_texts_and_neighbours(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())

    def terms(text):
        words = re.split("[ \t\n\r\f\x0b]+", text.strip(" \t\n\r\f\x0b").lower())
        return list(zip(words, words[1:])) if len(words) > 1 else [(words[0], "")] if words[0] else []

    texts, changed = dict(rows), {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        changed[i] = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
    every = {x for t in [*texts.values(), *changed.values()] for x in terms(t)}
    hashed = spark.createDataFrame(sorted(every), "a string, b string")
    known = {(r.a, r.b): (r.h % 2**64) << 64 | (r.g % 2**64) for r in hashed.select("a", "b", F.xxhash64("a", "b").alias("h"), F.xxhash64(F.lit(1), "a", "b").alias("g")).collect()}

    def fingerprint(text):
        hs = [known[t] for t in terms(text)]
        return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    own = {i: fingerprint(t) for i, t in texts.items()}
    for r in op10.query(docs).collect():
        assert int(r.fingerprint, 16) == own[r.doc_id] and int(r.edited_fingerprint, 16) == fingerprint(changed[r.doc_id])
        near = sum((own[r.doc_id] ^ f).bit_count() <= op10.RADIUS for f in own.values())
        assert r.n_near == (near if r.doc_id % op10.QUERY_STEP == 0 else None)


def test_url_lists_of_several_files(spark):
    from quillmark.llm import op2_url_filter as op2

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert sorted(map(tuple, op2.judged(pages, keep=["page_id"], part=2).collect())) == sorted(map(tuple, op2.query(pages).collect()))
    assert {r.verdict for r in op2.judged(pages, {}, keep=["page_id"]).collect()} == {"allow"}
