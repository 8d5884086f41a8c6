import zlib

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from quillmark.llm import op8_toxicity as op8
from tests.llm.conftest import SF


def auc(scores, labels):
    bad, good = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return np.mean([b > g for b in bad for g in good])


def test_held_out_accuracy_of_the_model():
    rows = ds.dataset("/root/testdata/sf0.1/documents.parquet").to_table(columns=["doc_id", "text"]).to_pandas()
    rows = rows.merge(ds.dataset("/root/testdata/sf0.1/labels.parquet").to_table().to_pandas(), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id])
    fit = rows[~held]
    scorer = op8.Scorer(op8.train(list(fit.text), list(fit.toxic), fit.toxic.mean()))
    scores = np.array([scorer.score(t) for t in rows[held].text])
    assert auc(scores, rows[held].toxic) > 0.97
    assert np.mean((scores >= 0.3) == rows[held].toxic) > 0.97


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op8.query(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc([r.score for r in held], [r.toxic for r in held]) > 0.75  # some thirty toxic rows to learn from


def test_held_out_labels_and_metadata_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = op8.query(docs, labels).select("doc_id", "score")
    b = op8.query(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), other).select("doc_id", "score")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 1), (None, "bad word", "en", 1), (4, "good " * 70_000 + "bad", "en", 1), (4, "good", "en", 1)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = op8.query(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in op8.query(docs, labels.limit(0)).collect()} == {0.0}
    assert op8.query(docs.limit(0), labels).count() == 0
    kept = op8.reject(docs, op8.Model(rate=0.1, thresholds={"en": 0.05}))
    assert kept.columns == docs.columns and kept.count() == 1


def test_pieces_do_not_show():
    model = op8.train(["a b c", "x y z", "a c", "x z", "b", "y", "a", "x", "c b", "z y"] * 8, [0, 1] * 40, 0.5)
    words = [w.encode() for w in "a b x y z c a b".split()]
    whole, piece = op8.Scorer(model).pooled(words), op8.PIECE
    try:
        for op8.PIECE in (1, 2, 3, 5):
            assert np.allclose(op8.Scorer(model).pooled(words), whole, atol=1e-5)  # of 32-bit sums
    finally:
        op8.PIECE = piece
