"""Near copies by the Jaccard likeness of their word shingles, for pipelines.

Two texts are near copies if at least 4 of 5 of all their distinct five-word shingles are in both.
First come the pairs that op3's SimHash links, by its fingerprints and multi-index hashing; then, as texts that share four
of five mostly lie beyond its radius, MinHash bands propose pairs (32 of 8 rows: a pair at 0.8 shares none once in 360,
one at 0.85 once in 26,000). The complete sets decide each. What SimHash has joined isn't compared again. In a bucket of many, everything meets one centre first, twice; what those links have
joined needs no comparison, so that a large group isn't expanded into its n * n pairs. After that the pairs of
a bucket that are still in different groups are compared, but for those that can't be alike. Two exact bounds tell:
the share of shingles not in common is a metric, so distances to a centre may not differ by more than near copies do;
and shingles are dealt to 1,024 parts, of which a set keeps whether it has an odd number in each, so every part in
which two sets differ stands for one shingle at least that only one of them has.

Defined results: words are those of ``op3_simhash_dedup.shingle_hashes``; a text of five words or fewer
is one shingle; null and blank texts are copies of each other; a null id takes part but is kept only
where all ids of its group are null; a very long text takes part with all its shingles, hashed by one row of a batch; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, lean, rebatched
from quillmark.llm import op3_simhash_dedup as op3
from quillmark.llm.op3_simhash_dedup import keep_first, shingle_hashes
from quillmark.operators.graph import components

SHINGLE = 5
#: Likeness from which two texts are near copies, as a fraction.
LIKE = (4, 5)
BANDS, ROWS = 32, 8
#: Rounds in which the members of a bucket meet one centre only.
CENTRES = 2
#: Parts into which shingles are dealt, a power of two.
PARTS = 1024

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PART = np.uint64(0x9E3779B97F4A7C15)
_OFFSETS = _RNG.integers(0, 2**63, BANDS, np.uint64)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def band_keys(held: np.ndarray) -> np.ndarray:
    """A key for each band: the mixed minima of its rows' permutations."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(held), 512):
        np.minimum(least, (held[None, at : at + 512] * _FACTORS).min(axis=1), out=least)
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _OFFSETS).view(np.int64)


def odd_parts(held: np.ndarray) -> np.ndarray:
    """A bit for each of ``PARTS`` parts of all shingles: whether the set has an odd number of them."""
    odd = np.bincount((held * _PART >> np.uint64(54)).astype(np.int64), minlength=PARTS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def node_of(held: np.ndarray) -> int:
    """One number for each set of shingles."""
    n = xxhash.xxh64_intdigest(held.tobytes())
    return n - (1 << 64) if n >> 63 else n


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rebatched(batches, 1024):
        nodes, sizes, keys, odd, fps = [], [], [], [], []
        for t in batch.column("text"):
            held = shingle_set(t.as_py())
            nodes.append(node_of(held))
            sizes.append(len(held))
            keys.append(band_keys(held) if len(held) else [])
            odd.append(odd_parts(held))
            fps.append(op3.fingerprint(shingle_hashes(t.as_py())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(fps, pa.int64())],
            names=["id", "th", "node", "n", "keys", "odd", "fp"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rebatched(batches, 256):
        held = [shingle_set(t.as_py()).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(held, pa.list_(pa.int64()))], names=["node", "held"]
        )


def _measured(pairs: DataFrame, sets: DataFrame, like: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) with whether their sets are alike enough, and their distance."""
    a, b = (sets.select(F.col("node").alias(c), F.col("held").alias(f"s{c}")) for c in "ab")
    met = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    num, den = like
    # both / (size a + size b - both) >= num / den
    return met.select("a", "b", ((num + den) * F.col("both") >= num * F.col("sum")).alias("near"), (1 - F.col("both") / (F.col("sum") - F.col("both"))).alias("apart"))


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that connect all whose fingerprints op3 links, of ``prints`` (node, fp), distinct: the nodes of
    one fingerprint through the least of them, and these through op3's edges."""
    least, _ = cut(prints.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    alike = prints.join(least, "fp").select(F.col("least").alias("x"), F.col("node").alias("y"))
    end = lambda c, n: least.select(F.col("fp").alias(c), F.col("least").alias(n))
    linked = op3.links(least.select("fp")).join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    return alike.unionByName(linked).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(nodes: DataFrame, sets_of, centres: int = CENTRES, like: tuple[int, int] = LIKE, first: DataFrame | None = None) -> DataFrame:
    """(node, root) of every node of ``nodes`` (node, n, keys, odd) that has a near copy; ``sets_of`` gives
    (node, held) for a table of nodes. ``first``: pairs (a, b) that are decided before those of the bands."""
    exploded, _ = cut(nodes.select("node", "n", F.explode("keys").alias("key")), "bands")
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    entries, _ = cut(exploded.join(shared, "key"), "buckets")
    wanted = entries.select("node")
    if first is not None:
        wanted = wanted.unionByName(first.select(F.col("a").alias("node"))).unionByName(first.select(F.col("b").alias("node")))
    sets, _ = cut(sets_of(wanted.distinct()), "sets")
    odd = nodes.select("node", *(F.get("odd", F.lit(j)).alias(f"o{j}") for j in range(PARTS // 64)))
    num, den = like
    sized = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    edges = tested = roots = None
    middle = []
    if first is not None:
        tested, _ = cut(_measured(first, sets, like), "measured")
        edges = tested.where("near").select("a", "b")
        roots, _ = cut(components(edges), "roots")
    for k in range(centres + 1):
        now = entries.withColumn("root", F.col("node"))
        if roots is not None:
            now = entries.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
            now, _ = cut(now, "rooted")
        left = now.select("key", F.col("node").alias("x"), F.col("n").alias("na"), F.col("root").alias("ra"))
        right = now.select("key", F.col("node").alias("y"), F.col("n").alias("nb"), F.col("root").alias("rb"))
        if k < centres:
            right = right.groupBy("key").agg(F.min_by(F.struct("y", "nb", "rb"), F.xxhash64("y", F.lit(k))).alias("c")).select("key", "c.*")
            middle.append(cut(right.select("key", F.col("y").alias("centre")), "centres")[0])
            met = left.join(right, "key").where("ra <> rb")
        else:  # only buckets of several groups have any pairs left
            open_ = now.groupBy("key").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("key")
            told, far = now.join(open_, "key").select("key", "node", "n", "root").join(odd, "node"), F.lit(False)
            for j, centre in enumerate(middle):
                ends = {"a": F.least("node", "centre"), "b": F.greatest("node", "centre")}
                told = told.join(centre, "key").withColumns(ends).join(tested.select("a", "b", "apart"), ["a", "b"], "left")
                told = told.withColumn(f"d{j}", F.when(F.col("node") == F.col("centre"), 0.0).otherwise(F.col("apart"))).drop("a", "b", "apart", "centre")
                far = far | F.coalesce(F.abs(F.col(f"d{j}") - F.col(f"e{j}")) > 1 - num / den + 1e-9, F.lit(False))
            told, _ = cut(told, "told")
            words = range(PARTS // 64)
            left = told.select("key", F.col("node").alias("x"), F.col("n").alias("na"), F.col("root").alias("ra"), *(f"d{j}" for j in range(centres)), *(F.col(f"o{j}").alias(f"p{j}") for j in words))
            right = told.select("key", F.col("node").alias("y"), F.col("n").alias("nb"), F.col("root").alias("rb"), *(F.col(f"d{j}").alias(f"e{j}") for j in range(centres)), *(F.col(f"o{j}").alias(f"q{j}") for j in words))
            apart = sum((F.bit_count(F.col(f"p{j}").bitwiseXOR(F.col(f"q{j}"))) for j in words), F.lit(0))
            # what only one of them has is (den - num) / (den + num) of both sizes at most
            met = left.join(right, "key").where("ra <> rb and x < y").where(~far).where((den + num) * apart <= (den - num) * (F.col("na") + F.col("nb")))
        met = met.where(sized)
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, _ = cut(pairs, "pairs")
        measured, _ = cut(_measured(pairs, sets, like), "measured")
        tested = measured if tested is None else tested.union(measured)
        found = measured.where("near").select("a", "b")
        edges = found if edges is None else edges.union(found)
        if not found.isEmpty() or roots is None:
            roots, _ = cut(components(edges), "roots")
    return roots


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: tuple[int, int] = LIKE) -> DataFrame:
    """``docs`` with one row of each group of near copies: of its least id, or (all null) of its least text hash."""
    if 5 * like[0] < 4 * like[1]:
        raise ValueError("the bands serve a likeness of 0.8 or more")
    slim = _slim(docs, id_col, text_col)
    rows, _ = cut(slim.mapInArrow(lean(_sketched), "id long, th long, node long, n int, keys array<long>, odd array<long>, fp long"), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("null"), F.coalesce("id", F.lit(0)).alias("id"), "th")).alias("k")
    named, _ = cut(rows.groupBy("node").agg(least), "named")
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        one = named.join(wanted, "node").select("node", F.col("k.null").alias("null"), F.col("k.id").alias("key"), F.col("k.th").alias("th"))
        text = slim.withColumns({"null": F.col("id").isNull(), "key": F.coalesce("id", F.lit(0))}).drop("id")
        found = text.join(one.hint("merge"), ["null", "key", "th"]).select("node", "text")
        return found.mapInArrow(lean(_sets), "node long, held array<long>").groupBy("node").agg(F.first("held").alias("held"))

    first_, _ = cut(simhash_pairs(rows.select("node", "fp").distinct()), "simhash")
    roots = links(nodes, sets_of, like=like, first=first_)
    grouped = named.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    first, _ = cut(grouped.select(F.col("k.id").alias("id"), F.col("k.null").alias("null"), F.col("k.th").alias("th")), "first")
    return keep_first(docs, first, id_col, text_col)
