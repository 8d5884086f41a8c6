"""Approximate keyword matches against the sliding-window definition."""

import random
from difflib import SequenceMatcher

import pytest

from quillmark.operators import fuzzy
from quillmark.plans import catalog, extraction
from tests.conftest import SF


def plain(text, word, threshold):
    low, kw = (text or "").lower(), word.lower()
    if not low or not kw:
        return 0.0
    if kw in low:
        return 1.0
    best = max(SequenceMatcher(None, kw, low[i : i + len(kw) + 5]).ratio() for i in range(max(1, len(low) - len(kw) + 1)))
    return best if best >= threshold else 0.0


WORDS = ["protein engineering", "CRISPR", "metabolic flux", "a", "Straße", "directed evolution of enzymes", ""]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 0.95])
def test_definition(spark, threshold):
    rng = random.Random(int(threshold * 100))

    def noisy(w):
        chars = list(w)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(chars) + 1)
            chars[k : k + rng.randrange(2)] = rng.choice(["", "x", " ", "e", "ß"])
        return "".join(chars)

    texts = [" ".join(noisy(rng.choice(WORDS[:-1] + ["lorem", "ipsum dolor"])) for _ in range(rng.randrange(7))) for _ in range(60)] + ["", None, "x", "CRIS"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {(r.i, r.keyword): r.score for r in fuzzy.fuzzy_matches(df, "i", "t", WORDS, threshold).collect()}
    for i, t in enumerate(texts):
        for w in WORDS:
            assert got.get((i, w), 0.0) == plain(t, w, threshold), (t, w)
    best = {r.i: r for r in fuzzy.fuzzy_scores(df, "i", "t", WORDS, threshold).collect()}
    assert all(best[i].score == max(plain(t, w, threshold) for w in WORDS) for i, t in enumerate(texts) if t)


def test_query_scores_few_windows(spark):
    rows = catalog.QUERIES["g19_fuzzy_keywords"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0").count()
    windows, scored = sum(r.windows for r in rows), sum(r.scored for r in rows)
    assert 0 < scored < windows / 200  # the share of windows that are compared
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = extraction.fuzzy_keywords(spark, SF)
    rng = random.Random(1)
    for r in rng.sample([r for r in rows if len(texts[r.doc_id]) < 600], 8):
        assert r.score == max(plain(texts[r.doc_id], w, 0.75) for w in words)
