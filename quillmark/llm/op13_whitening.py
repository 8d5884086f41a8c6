"""PCA whitening of embeddings by LOBPCG.

The covariance matrix is never formed. A round multiplies it with the orthonormal basis of three blocks, iterate,
residual and previous direction: every task centres its rows and sums its part of the product, Spark adds the parts,
and the driver, which sees nothing but matrices of dimensions times block width, solves the Rayleigh-Ritz problem in
that basis. Residuals come from the products themselves, so that they certify the eigenpairs; rounds go on until all
wanted ones are small. The block is ``GUARD`` wider than what is asked for, so that close eigenvalues at its end
don't slow the wanted ones.

Entries are long integers, floor(1024 * c) + 100000. Sums, and each row's deviation, are exact.

Defined results: a row whose vector is null, or holds a null, a non-finite entry or one of 2^42 or more, is dropped, and
so is one whose length isn't the commonest (of lengths as common, the greatest counts); null and repeated ids
take part, and repeated rows count as often as they occur; an empty table, or one without a usable row, gives no rows; fewer
dimensions than components give fewer components; a component without variance (10^-12 of the greatest or less) has
null whitened values, and where there is no variance at all ``explained`` is null too; a deviation beyond a long is
null; vectors of any length are read in slices of a fixed number of entries; extra columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, lean, plain, rebatched, remove

COMPONENTS = 8
#: Columns of the block beyond the components.
GUARD = 8
#: Residuals, as shares of the greatest eigenvalue: small enough to stop; and what must be reached where rounding ends progress.
SMALL, LEAST = 1e-13, 1e-10
ROUNDS = 500
#: Variance of a component, as a share of the greatest, that counts as none.
FLAT = 1e-12
SCALE, SHIFT = 1024, 100_000
#: Entries that a task holds as numbers at a time.
SLICE = 1 << 20
_HALF = 26


@dataclass(frozen=True)
class Whitening:
    """``n`` rows with the exact ``sums`` of their dimensions; unit eigenvectors (dimensions x components), their
    eigenvalues in falling order, the norms of their residuals, the trace of the covariance matrix, and how far the
    covariance of what is whitened is from the identity."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    rounds: int = 0
    identity_error: float | None = None

    @property
    def used(self) -> np.ndarray:
        return self.values > FLAT * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)

    def scaled(self) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; zero where there is no variance."""
        return np.where(self.used, self.vectors / np.sqrt(np.where(self.used, self.values, 1.0)), 0.0)


def integers(vector: Column | str) -> Column:
    """The vector's entries as integers, or null where it isn't to be used."""
    v = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(v, lambda c: F.coalesce(F.abs(c) < float(1 << 42), F.lit(False)) & ~F.isnan(c))
    return F.when(usable, F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], like: np.ndarray) -> np.ndarray:
    """The sum over all rows of ``part``, which takes a slice of them as a matrix of integers and gives an array like
    ``like``. Every task adds up its slices, Spark adds the tasks; only the sum is collected."""
    schema = pa.schema([("k", pa.int32()), ("v", pa.from_numpy_dtype(like.dtype))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(like)
        for batch in rebatched(batches, max(1, SLICE // d)):
            total += part(_matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], schema=schema)

    kind = "double" if like.dtype.kind == "f" else "long"
    got = rows.select("x").mapInArrow(lean(run), f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()  # an entry of the array each
    out = np.zeros(like.size, like.dtype)
    for k, v in got:
        out[k] = v
    return out.reshape(like.shape)


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: as longs, or as Python's integers where these might not do."""
    far = max(int(np.abs(x).max(initial=0)), 1)
    if far * n < 1 << 61 and all(abs(int(s)) < 1 << 61 for s in sums):
        return x * np.int64(n) - np.array([int(s) for s in sums], np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return differences(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - sums)^2; None beyond a long."""
    t = differences(x, n, sums)
    if t.dtype != object and float(np.abs(t).max(initial=0)) ** 2 * max(1, t.shape[1]) >= 2.0**62:
        t = t.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (t * t).sum(axis=1)]


def _orthonormal(x: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
    """x, whose columns are orthonormal, and an orthonormal basis of what ``more`` adds to it."""
    w = np.hstack(more)
    for _ in range(2):
        lengths = np.linalg.norm(w, axis=0)
        w = w[:, lengths > 0] / lengths[lengths > 0]
        w = w - x @ (x.T @ w)
        if w.shape[1]:
            u, s, _ = np.linalg.svd(w, full_matrices=False)
            w = u[:, s > 1e-8 * max(s[0], 1e-300)] if s[0] > 1e-12 else u[:, :0]
    w = w - x @ (x.T @ w)
    return np.linalg.qr(np.hstack([x, w]))[0] if w.shape[1] else x


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residual norms, rounds) of the ``k`` greatest eigenpairs of a symmetric matrix of ``d`` rows
    that is known by its ``product`` with a block. Raises where residuals stay above ``LEAST``."""
    m = min(d, k + GUARD)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    x, best, waited = None, np.inf, 0
    for rounds in range(1, ROUNDS + 1):
        image = product(basis)
        small = basis.T @ image
        w, c = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-w, kind="stable")[:m]
        old, x, values = x, basis @ c[:, order], w[order]
        residual = image @ c[:, order] - x * values
        norms = np.linalg.norm(residual, axis=0)
        scale = max(abs(values[0]), 1e-300)
        worst = norms[:k].max() / scale
        waited = waited + 1 if worst > best / 2 else 0
        best = min(best, worst)
        full = basis.shape[1] == d and rounds > 1
        if worst <= SMALL or (worst <= LEAST and (waited >= 2 or full)) or values[0] <= 0:
            return values[:k], x[:, :k], norms[:k], rounds
        x = np.linalg.qr(x)[0] * np.sign(np.sum(np.linalg.qr(x)[0] * x, axis=0))
        direction = [x - old @ (old.T @ x)] if old is not None else []
        basis = _orthonormal(x, [residual, *direction])
    raise RuntimeError(f"eigenpairs are not certified after {ROUNDS} rounds: residual {best:.2g} of the greatest eigenvalue")


def usable(vectors: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(rows of ``vectors`` with __x, their integers; the number of dimensions), for vectors of the commonest length."""
    rows = vectors.withColumn("__x", integers(F.col(f"`{vec_col}`"))).where(F.col("__x").isNotNull())
    sizes = rows.groupBy(F.size("__x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    d = sizes[0].d if sizes else 0
    return rows.where(F.size("__x") == d), d


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable rows; None where there are none, or they have no entries."""
    spark = vectors.sparkSession
    rows, d = usable(vectors, vec_col)
    if not d:
        return None
    rows, path = cut(rows.select(F.col("__x").alias("x")), "vectors")
    low = np.int64((1 << _HALF) - 1)
    halves = summed(rows, d, lambda x: np.concatenate([(x >> _HALF).sum(0), (x & low).sum(0), [len(x)]]), np.zeros(2 * d + 1, np.int64))
    n, sums = int(halves[-1]), tuple((int(a) << _HALF) + int(b) for a, b in zip(halves[:d], halves[d : 2 * d]))

    def times(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ block)

        return summed(rows, d, part, np.zeros_like(block)) / n

    trace = float(summed(rows, d, lambda x: np.array([np.square(centred(x, n, sums)).sum()]), np.zeros(1))[0]) / n
    values, found, residuals, rounds = lobpcg(times, d, min(components, d))
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    model = Whitening(n, sums, found * np.where(signs == 0, 1, signs), np.maximum(values, 0.0), residuals, trace, rounds)
    white = model.scaled()
    mean = summed(rows, d, lambda x: (centred(x, n, sums) @ white).sum(0), np.zeros(white.shape[1])) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ white - mean
        return w.T @ w

    off = np.abs(summed(rows, d, spread, np.zeros((len(mean), len(mean)))) / n - np.eye(len(mean)))[np.ix_(model.used, model.used)]
    remove(spark, path)
    return Whitening(n, sums, model.vectors, model.values, residuals, trace, rounds, float(off.max()) if off.size else None)


def whitened(vectors: DataFrame, model: Whitening | None, vec_col: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` of the model's length, with two last columns, whatever the others are called: the
    deviation and the array of whitened components."""
    rows, short = plain(vectors)
    d = len(model.sums) if model else -1
    kept = rows.withColumn("__x", integers(F.col(short[vec_col]))).where((F.size("__x") == d) & F.col("__x").isNotNull())
    white, used = (model.scaled(), model.used) if model else (np.zeros((0, 0)), np.zeros(0, bool))
    n, sums = (model.n, model.sums) if model else (0, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, max(1, SLICE // max(d, 1))):
            x = _matrix(batch.column(batch.num_columns - 1), d)
            w = centred(x, n, sums) @ white
            flat = pa.array(w.ravel(), mask=np.broadcast_to(~used, w.shape).ravel())
            ends = pa.array(np.arange(0, w.size + 1, max(w.shape[1], 1), dtype=np.int32))
            more = [pa.array(deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(ends, flat)]
            names = [*batch.schema.names[:-1], "deviation", "whitened"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = kept.mapInArrow(lean(run), f"{schema}, deviation long, whitened array<double>")
    return out.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(vectors.columns)), "deviation", "whitened")


def query(embeddings: DataFrame) -> DataFrame:
    """A row for each usable vector and component."""
    slim = embeddings.select("vec_id", "embedding")
    model = fit(slim)
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values] if model else []
    explained = F.array(*(F.lit(s).cast("double") for s in shares)).cast("array<double>")
    each = whitened(slim, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
