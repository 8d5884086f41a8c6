import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import op11_substring_dedup as op11
from tests.llm.conftest import SF


def brute(texts, window=35):
    """For each text whether each of its words is under a window that starts at two places."""
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def test_query_matches_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(op11.SQL).fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, op11.query(docs).collect()))
    assert got == want and 0 < sum(r[2] for r in got) < sum(r[1] for r in got)
    rows = docs.select("doc_id", "text").collect()
    plain = sorted((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for (i, _), (w, g) in zip(rows, brute([t for _, t in rows])))
    assert got == plain


@pytest.mark.parametrize("window, crowd, block", [(35, 256, 200_000), (8, 3, 50), (5, 1, 10), (2, 2, 100), (1, 256, 1000)])
def test_any_window(spark, monkeypatch, window, crowd, block):
    monkeypatch.setattr(op11, "CROWD", crowd)
    monkeypatch.setattr(op11, "BLOCK", block)
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 3 * window))] for _ in range(6)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(2 * window))]
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in op11.marked(docs.withColumnRenamed("doc_id", "i"), window).withColumnRenamed("__0", "doc_id").collect()}
    for i, (w, g) in enumerate(brute(texts, window)):
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(g))
        assert got[i].text == (" ".join(x.decode() for x, y in zip(w, g) if not y) if any(g) else texts[i])


def test_block_factors():
    """Factors are greedy and longest, and a window across two of them is found."""
    rng = random.Random(4)
    for _ in range(200):
        window = rng.randrange(1, 9)
        texts = [[b"%d" % rng.randrange(3) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 6))]
        copies = [rng.choice([1, 1, 2]) for _ in texts]
        block = op11.Block(texts, copies)
        whole = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]

        def longest(k, i):
            rest = texts[k][i:]
            if copies[k] > 1:
                return len(rest)
            def common(j, m):
                n = 0
                while n < len(rest) and m + n < len(texts[j]) and texts[j][m + n] == rest[n]:
                    n += 1
                return n
            return max((common(j, m) for j, m in whole if (j, m) != (k, i)), default=0)

        begin, length = block.factors()
        want = []
        for k, t in enumerate(texts):
            i = 0
            while i < len(t):
                want.append((int(block.starts[k]) + i, longest(k, i)))
                i += max(1, want[-1][1])
        assert list(zip(begin.tolist(), length.tolist())) == want
        cover = {(k, i + o) for k, i in whole if i + window <= len(texts[k]) and longest(k, i) >= window for o in range(window)}
        of, a, b = block.duplicates(window)
        assert {(k, j) for k, x, y in zip(of.tolist(), a.tolist(), b.tolist()) for j in range(x, y)} == cover


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(op11, "PASS", 1000)
    passage = " ".join(f"p{k}" for k in range(40))
    long = " ".join(f"x{k % 7001}" for k in range(150_000))
    rows = [(1, passage, "a"), (None, passage, "b"), (2, "own words " + passage + "  and\nmore ", "c"), (3, None, "d"), (4, "", "e"), (5, " \t\n", "f"), (6, long, "g"), (7, "y" * 5_000_000, "h"), (7, "y" * 5_000_000, "h"), (8, "a " * 100, "i"), (9, "short\x00 one  two", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    out = op11.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.rid: (r.doc_id, r.text) for r in out.collect()}
    assert got["a"] == (1, "") and got["b"] == (None, "") and got["c"] == (2, "own words and more") and got["d"] == (3, None) and got["e"] == (4, "") and got["f"] == (5, " \t\n")
    assert got["g"] == (6, "") and got["h"] == (7, "y" * 5_000_000) and got["i"] == (8, "") and got["j"] == (9, "short\x00 one  two")
    assert op11.query(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, passage)] * 3, "doc_id long, text string")
    assert {(r.n_words, r.n_removed) for r in op11.query(twice).collect()} == {(40, 40)}


def test_hashes_do_not_depend_on_the_batch():
    texts = [" ".join(f"w{k * k % 97}" for k in range(60)), None, " ".join(f"w{k * k % 97}" for k in range(60)), "x"]
    of, s, n, h, c = op11.segments(pa.array(texts))
    a, b = (sorted(zip(s[of == k], n[of == k], h[of == k], c[of == k])) for k in (0, 2))
    assert a == b and set(of) == {0, 2} and int(np.sum(n[of == 0])) == 26
    of2, *rest = op11.segments(pa.array(texts)[2:3])
    assert sorted(zip(*rest)) == a


def test_windows_of_a_crowd_are_a_row_a_segment(spark, monkeypatch):
    """Own words around a passage that everyone has: Python gives a row a segment, and words only of windows that occur again."""
    monkeypatch.setattr(op11, "CROWD", 3)
    passage = " ".join(f"p{k}" for k in range(36))
    texts = [f"{' '.join(f'a{i}_{k}' for k in range(30))} {passage} {' '.join(f'b{i}_{k}' for k in range(30))}" for i in range(60)]
    sizes = {}
    for name in ("_single_windows", "_window_words"):
        def spied(rows, window, made=getattr(op11, name), name=name):
            found, _ = op11.cut(made(rows, window), "spied")
            sizes[name] = (rows.count(), found.count())
            return found
        monkeypatch.setattr(op11, name, spied)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in op11.query(docs).collect()}
    assert got == {i: sum(g) for i, (_, g) in enumerate(brute(texts))} and set(got.values()) == {36}
    rows, made = sizes["_single_windows"]
    assert rows == made > 3 and sizes["_window_words"][1] <= 2


def test_crowds_are_cut_into_parts_first(spark, monkeypatch):
    """Windows are made of the parts alone that hold the border of what everyone has, and in proportion to the texts."""
    monkeypatch.setattr(op11, "CROWD", 3)
    made = {}

    def spied(df, name, cut=op11.cut):
        found, path = cut(df, name)
        if name == "words":
            made["all"] = found.where("crowded").selectExpr("sum(n)").first()[0]
        if name in ("parts", "windows"):
            made[name] = found.selectExpr("count(*)" if name == "parts" else "sum(size(hashes))").first()[0]
        return found, path

    monkeypatch.setattr(op11, "cut", spied)
    passage, sizes = " ".join(f"p{k}" for k in range(60)), []
    for n in (60, 120):
        texts = [f"{' '.join(f'a{i}_{k}' for k in range(30))} {passage} {' '.join(f'b{i}_{k}' for k in range(30))}" for i in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.n_removed for r in op11.query(docs).collect()} == {60}
        assert made["all"] > 10 * n and made.get("parts", 0) + made["windows"] < made["all"] / 2
        sizes.append((made["parts"], made["windows"]))
    assert all(b <= 2.5 * a for a, b in zip(*sizes))


@pytest.mark.parametrize("window, crowd", [(35, 2), (35, 5), (12, 1), (3, 1)])
def test_parts_lose_no_repeat(spark, monkeypatch, window, crowd):
    """Stretches that are alike for any number of words before and behind a common passage."""
    monkeypatch.setattr(op11, "CROWD", crowd)
    rng = random.Random(window + crowd)
    left, passage, right = ([f"{c}{k}" for k in range(2 * window)] for c in "lpr")
    texts = []
    for i in range(120):
        a, b = rng.randrange(2 * window), rng.randrange(2 * window)
        middle = passage[: rng.choice([5, window - 1, window, 2 * window])]
        texts.append(" ".join([f"x{i % 50}", *left[a:], *middle, *right[:b], *(f"y{i}_{k}" for k in range(rng.randrange(window)))]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r["__0"]: (r.n_words, r.n_removed, r.text) for r in op11.marked(docs, window).collect()}
    assert got == {i: (len(w), sum(g), " ".join(x.decode() for x, y in zip(w, g) if not y)) for i, (w, g) in enumerate(brute(texts, window))}
