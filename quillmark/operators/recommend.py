"""Vector likeness, scores and the composite recommendation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.shared import cut

# The share of each part in the composite.
WEIGHTS = {"similarity": 0.30, "connection": 0.25, "citation": 0.15, "tier": 0.10, "h_index": 0.20}
#: Vectors of a block of seeds, and of a block of rows.
SEED_BLOCK, ROW_BLOCK = 2_000, 50_000


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two vectors; the shorter is padded with zeros, and of a zero vector it is 0."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce(a, zero).cast("double") * F.coalesce(b, zero).cast("double")), zero, lambda s, v: s + v)
    size = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, a: s + a.cast("double") * a.cast("double")))
    norms = size(x) * size(y)
    return F.when(norms == 0, zero).otherwise(dot / norms)


def nearest_seed(rows: DataFrame, seeds: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, best): the greatest cosine of each row with any seed, 0 without seeds. Vectors of other lengths are padded with
    zeros; a null vector is a zero vector.

    Rows and seeds are dealt to blocks of at most about ``ROW_BLOCK`` and ``SEED_BLOCK``. Every two blocks meet in a task,
    where their cosines are products of matrices, and of each row's maxima over the blocks of seeds the greatest counts. So a
    row is shuffled once for each block of seeds and a seed once for each block of rows; nothing passes through the driver."""
    distinct = seeds.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").distinct()
    few, _ = cut(distinct.withColumn("h", F.xxhash64("v")), "seeds")
    held, _ = cut(rows.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")), "rows")
    n_seeds, n_rows = few.count(), held.count()
    if not n_seeds:
        return held.select(F.col("key").alias(key), F.lit(0.0).alias("best"))
    s, r = -(-n_seeds // SEED_BLOCK), max(1, -(-n_rows // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.select("id", "v", F.pmod("id", F.lit(r)).cast("int").alias("rows"), every(s).alias("seeds"))
    right = few.select("v", F.pmod("h", F.lit(s)).cast("int").alias("seeds"), every(r).alias("rows"))
    met = left.groupBy("rows", "seeds").cogroup(right.groupBy("rows", "seeds")).applyInArrow(_best_of, "id long, best double")
    best = met.groupBy("id").agg(F.max("best").alias("best"))
    return held.select("id", "key").join(best, "id", "left").select(F.col("key").alias(key), F.coalesce("best", F.lit(0.0)).alias("best"))


def _unit(vectors: list) -> np.ndarray:
    """The vectors as rows of one length each, padded with zeros; zero vectors stay."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        if v is not None:
            out[k, : len(v)] = [0.0 if x is None else x for x in v]
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size == 0, 1, size)


def _best_of(rows: pa.Table, seeds: pa.Table) -> pa.Table:
    """Of each of some rows the greatest cosine with any of some seeds."""
    known, out = _unit(seeds.column("v").to_pylist()), []
    for at in range(0, rows.num_rows, 1024):
        part = _unit(rows.column("v").slice(at, 1024).to_pylist())
        width = max(part.shape[1], known.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        out.append((pad(part) @ pad(known).T).max(axis=1) if len(known) else np.zeros(len(part)))
    best = np.concatenate(out) if out else np.zeros(0)
    return pa.table({"id": rows.column("id"), "best": pa.array(best, pa.float64())})


def recency(age_years: Column) -> Column:
    return F.exp(-age_years / 2.0)


def saturating(n: Column, rate: float) -> Column:
    return 1 - 1 / (1 + n * rate)


def tier_score(tier: Column) -> Column:
    """1.0, 0.75, 0.5 and 0.3 for tiers 1 to 4, 0.15 beyond."""
    return F.when(tier == 1, 1.0).when(tier == 2, 0.75).when(tier == 3, 0.5).when(tier == 4, 0.3).otherwise(0.15)


def composite(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + F.coalesce(parts[name], F.lit(0.0)) * weight
    return F.bround(out, 4)
