import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quillmark.llm import op3_simhash_dedup, op4_mixing, op5_decontamination, op8_toxicity, op9_sstable

SF = "/root/testdata/sf0.001"


def first_of_each(rows):
    """The row of least doc_id of every group of texts that share four of five of their five-word shingles, by
    comparing all pairs."""
    sets = []
    for r in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
        words = [w for w in words if w]
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = op8_toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = op8_toxicity.Scorer(model)
    left = [r for i, r in sorted(rows.items()) if scorer.score(r.text) < model.thresholds.get(r.lang, op8_toxicity.THRESHOLD)]
    stage = corpus_pipeline.toxicity(spark, docs, SF)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == [r.doc_id for r in left]

    left = first_of_each(left)
    stage = corpus_pipeline.near_dedup(spark, stage, SF)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == [r.doc_id for r in left]

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = []
    for r in left:
        n, hit, _ = op5_decontamination.brute_force(r.text, items)
        if not (hit and 20 * hit >= n):
            clean.append(r)
    stage = corpus_pipeline.decontamination(spark, stage, SF)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == [r.doc_id for r in clean]

    copies = {r.doc_id: r.copies for r in op4_mixing.query(stage).collect()}
    stage = corpus_pipeline.mixing(spark, stage, SF)
    want = sorted(r.doc_id for r in clean for _ in range(copies[r.doc_id]))
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == want and set(want) == {r.doc_id for r in clean}

    t, start, out = Tokenizer.from_file(op9_sstable.tokenizer_path()), 0, []
    for i in want:
        ids = [*t.encode(rows[i].text, add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.token_output(spark, stage, SF).collect())) == out
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == out


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    assert corpus_pipeline.ORACLE_SQL is None and op3_simhash_dedup.RADIUS == 4


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_go_through_the_stages(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, `__0` string, score string, `a b` string"
    long = "one two three four five six seven eight nine ten " * 30
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, long, "en", "s"), (3, long, "en", "s"), (None, long + "x", "en", "t"), (None, "word", "de", None), (4, "Σ" * 50_000, "el", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "z", "y", "x") for r in rows], names)
    model = op8_toxicity.Model(rate=0.0)
    kept = op8_toxicity.reject(docs, model)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and {(r["__0"], r.score, r["a b"]) for r in kept.collect()} == {("z", "y", "x")}
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    shards = corpus_pipeline.token_output(spark, kept, SF).collect()
    assert {r.doc_id for r in shards} == {None, 1, 3, 4} and min(r.start for r in shards) == 0
    assert next(r.n_tokens for r in shards if r.doc_id == 1) == 1
