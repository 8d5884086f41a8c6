import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import op5_decontamination as op5
from tests.llm.conftest import SF


def row(r):
    return (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)


def expected(docs, items):
    out = []
    for i, t in docs:
        n, hit, ids = op5.brute_force(t, items)
        out.append((i, n, hit, len(ids), op5.listing(ids), hit > 0 and 20 * hit >= n))
    return out


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = sorted(map(row, op5.query(docs, items).collect()))
    assert got == sorted(expected(docs.select("doc_id", "text").collect(), [tuple(r) for r in items.select("item_id", "text").collect()]))
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_query_matches_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = c.execute(f"SELECT {', '.join(names)} FROM ({op5.SQL})").fetchall()
    got = op5.query(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert got.columns == names and sorted(map(row, got.collect())) == sorted(want)


LONG = "a b c d e f g h i j k l m n o p"
ITEMS = [(1, LONG), (2, "Short item"), (3, "one"), (4, None), (5, " "), (1, LONG), (None, "zz top"), (7, "é-ü"), (8, LONG), (9, "short item")]
DOCS = [(1, None), (2, ""), (3, "x " + LONG.upper() + " y"), (4, "short, ITEM! one"), (None, "one"), (5, "é ü"), (5, "é ü"), (6, "zz top"), (7, "--- !!"), (8, "w " * 200_000 + "short item"), (9, "a b " * 50 + LONG)]


def test_odd_rows(spark):
    d = spark.createDataFrame([(i, t, "x", 1, True, 2, 3) for i, t in DOCS], "doc_id long, text string, items string, spans long, contaminated boolean, t1 int, `__0` int")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(expected(DOCS, ITEMS), key=str)
    assert sorted(map(row, op5.query(d, b).collect()), key=str) == want
    full = op5.judged(d, b)
    assert full.columns == [*d.columns, "n_words", "n_hit", "n_items", "spans", "items", "contaminated"]
    for r in full.collect():
        assert sum(x[1] - x[0] for x in r[10]) == r[8] and len(r[11]) == r[9]
    kept = op5.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 8]
    assert all(r["__0"] == 3 and r.t1 == 2 for r in kept.collect())
    assert op5.query(d.limit(0), b).count() == 0 and op5.clean(d.limit(0), b).count() == 0
    assert {r.n_items for r in op5.query(d, b.limit(0)).collect()} == {0}
    assert op5.clean(d, b.limit(0)).count() == len(DOCS)


def test_a_small_filter_only_adds_candidates(spark, monkeypatch):
    monkeypatch.setattr(op5, "BITS", 64)
    d, b = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(row, op5.query(d, b).collect()), key=str) == sorted(expected(DOCS, ITEMS), key=str)


def test_hot_windows_and_copies(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [f"{passage} tail {i % 40}" for i in range(120)] + [f"clean text number {i}" for i in range(60)]
    items = [(i, passage + f" q{i % 3}") for i in range(30)] + [(i + 50, " ".join(f"w{j}" for j in range(3, 16))) for i in range(3)]
    d, b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(row, op5.query(d, b).collect())) == expected(list(enumerate(texts)), items)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 .é漢-\x00\t", max_size=12)), max_size=6))
def test_words_and_keys(texts):
    words, starts = op5.split_words(pa.array(texts, pa.string()))
    lists = [op5.word_list(t) for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for x in lists for w in x]
    assert np.diff(starts).tolist() == [len(x) for x in lists]
    pairs, inside, lone = op5.shingle_keys(words, starts)
    flat, ends = [w for x in lists for w in x], set(np.cumsum([len(x) for x in lists]).tolist())
    for i, w in enumerate(flat):
        assert inside[i] == (i + 1 not in ends)
        for j, v in enumerate(flat):
            assert (lone[i] == lone[j]) == (w == v)
            if inside[i] and inside[j]:
                assert (pairs[i] == pairs[j]) == (flat[i : i + 2] == flat[j : j + 2])
