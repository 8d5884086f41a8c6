import math
import random

import numpy as np
import pytest

from quillmark.llm import op13_whitening as op13
from tests.llm.conftest import SF


def brute(rows):
    """{vec_id: (deviation, whitened)} and the shares, by a full decomposition of the covariance matrix."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    t = n * x - s
    c = t.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return {i: (int((a * a).sum()), w) for (i, _), a, w in zip(kept, t, c @ u / np.sqrt(e))}, e / np.trace(c.T @ c / n)


def test_query_matches_full_decomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want, shares = brute([(r.vec_id, r.embedding) for r in table.collect()])
    rows = op13.query(table).collect()
    assert len(rows) == 8 * len(want) and {r.n for r in rows} == {len(want)}
    got = {}
    for r in rows:
        assert r.deviation == want[r.vec_id][0] and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    ids = sorted(want)
    a, b = np.array([[got[i][k] for k in range(1, 9)] for i in ids]), np.array([want[i][1] for i in ids])
    signs = np.sign((a * b).sum(0))
    assert np.abs(a - b * signs).max() < 1e-8


@pytest.mark.parametrize("d, k", [(1, 8), (5, 8), (20, 8), (120, 8), (200, 3)])
def test_eigenpairs_are_certified(d, k):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, 3 * d)) * np.linspace(1, 2, d)[:, None]
    v = a @ a.T / (3 * d)
    k = min(k, d)
    values, vectors, norms, rounds = op13.lobpcg(lambda b: v @ b, d, k)
    e, u = np.linalg.eigh(v)
    assert np.allclose(values, e[::-1][:k], rtol=1e-10) and norms.max() <= op13.LEAST * e[-1]
    assert np.abs(np.abs((vectors * u[:, ::-1][:, :k]).sum(0)) - 1).max() < 1e-9


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 2), 0.5], "a") for i in range(60)]
    odd = [(100, None, "a"), (101, [1.0, None, 2.0], "a"), (102, [1.0, float("nan"), 2.0], "a"), (103, [float("inf"), 1.0, 2.0], "a"), (104, [], "a"), (105, [1.0], "a"), (106, [1e300, 0.0, 0.0], "a")]
    more = [(None, [0.25, -0.25, 0.5], "b"), (1, [0.25, -0.25, 0.5], "b"), (1, [0.25, -0.25, 0.5], "b")]
    table = spark.createDataFrame(rows + odd + more, "vec_id long, embedding array<double>, whitened string")
    model = op13.fit(table)
    assert model.n == 63 and list(model.used) == [True, True, False] and model.identity_error < 1e-9
    out = op13.whitened(table, model)
    assert out.columns == ["vec_id", "embedding", "whitened", "deviation", "whitened"] and out.count() == 63
    found = op13.query(table).collect()
    assert len(found) == 63 * 3 and all((r.whitened is None) == (r.component == 3) for r in found)
    assert len({(r.deviation, r.whitened) for r in found if r.component == 1 and r.vec_id in (1, None)}) == 2  # three alike, and row 1
    assert op13.query(table.limit(0)).collect() == [] and op13.query(table.where("vec_id in (100, 104)")).collect() == []
    one = op13.query(table.where("vec_id = 7")).collect()
    assert len(one) == 3 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in one)


def test_deviations_are_exact_at_any_size():
    x = np.array([[1 << 50, 3], [-(1 << 50), 4], [5, 5]])
    sums = tuple(int(s) for s in x.astype(object).sum(0))
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert op13.deviations(x, 3, sums) == [w if w < 1 << 63 else None for w in want]
    y = np.array([[10, 20], [11, 25]])
    assert op13.deviations(y, 2, (21, 45)) == [26, 26]
