"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint is cut into two halves. Of two fingerprints within 4 bits, one half differs in at most
2 bits, so the balls of radius 1 around that half meet: every fingerprint is entered under the 33 keys
of each half's ball, what shares a key is a candidate, and the complete distance decides.

Defined results: a null or blank text has fingerprint zero and links like any other; repeated rows and
equal fingerprints form one group; a null doc_id takes part but never names a group unless all its
members' ids are null; a very long text is fingerprinted whole, by
one row of a batch; an empty table gives an empty table; extra columns are ignored by ``groups`` and
kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, lean, plain, rebatched, renamed
from quillmark.operators.graph import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: The most members of a bucket that are compared in memory; a larger one is solved by shared midpoints.
BUCKET = 4096

_SHIFTS = np.arange(8, dtype=np.uint64)
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words (of the whole text if it has fewer), repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # eight counters of a byte each to a word
        lanes = ((hashes[at : at + 255, None] >> _SHIFTS) & _LANES).sum(axis=0, dtype=np.uint64)
        counts += lanes.view(np.uint8).reshape(8, 8).T.ravel()
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) of every row; th tells rows of one id with different texts apart."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 1024):
            fps = [fingerprint(shingle_hashes(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(fps, pa.int64())], names=["id", "th", "fp"]
            )

    return slim.withColumn("th", F.xxhash64("text")).mapInArrow(lean(hashed), "id long, th long, fp long")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))  # of a signed integer it would count the magnitude's bits


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, first member) for each component of one bucket: searched outward from one at a time."""
    left, found = fps, []
    while len(left):
        first, left = left[0], left[1:]
        ahead = [first]
        while ahead and len(left):
            near = _differing(left, ahead.pop()) <= radius
            found += [(int(x), int(first)) for x in left[near]]
            ahead += list(left[near])
            left = left[~near]
    return found


def _scan(batches: Iterator[pa.RecordBatch], radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal keys; a run beyond ``bucket`` is passed on as (fp, fp, true)."""
    key, fps, dense = np.empty(0, np.int64), np.empty(0, np.int64), None
    out: list[tuple[int, int, bool]] = []

    def pack() -> pa.RecordBatch:
        a, b, d = zip(*out) if out else ((), (), ())
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.bool_())], names=["a", "b", "dense"]
        )

    def solve(final: bool) -> None:
        nonlocal key, fps, dense
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(key)].astype(np.int64)
        size = ends - starts
        done = np.ones(len(starts), bool)
        if not final and len(done):
            done[-1] = size[-1] > bucket  # the last run may go on in the next batch
        pairs = starts[done & (size == 2) & (key[starts] != dense)]
        x, y = fps[pairs], fps[pairs + 1]
        near = _differing(x, y) <= radius
        out.extend((int(a), int(b), False) for a, b in zip(x[near], y[near]))
        for at, n in zip(starts[done & ((size > 2) | (key[starts] == dense))], size[done & ((size > 2) | (key[starts] == dense))]):
            run = fps[at : at + n]
            if n > bucket or key[at] == dense:
                dense = key[at]
                out.extend((int(f), int(f), True) for f in run)
            else:
                out.extend((a, b, False) for a, b in _links(run, radius))
        keep = len(key) if len(done) == 0 or done[-1] else starts[-1]
        key, fps = key[keep:], fps[keep:]

    for batch in batches:
        key = np.r_[key, batch.column("key").to_numpy()]
        fps = np.r_[fps, batch.column("fp").to_numpy()]
        solve(final=False)
        if out:
            yield pack()
    solve(final=True)
    yield pack()


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all of ``distinct``'s fingerprints (fp: long) that are within ``radius``
    (2 to 5) bits of each other, directly or through others. Each entry yields one edge at most, so a
    group of n isn't expanded into its n * n pairs."""
    if not 2 <= radius <= 5:
        raise ValueError("balls of radius 1 around halves serve a radius of 2 to 5")
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = F.array(
        F.struct(F.lit(0).cast("long").alias("base"), F.shiftrightunsigned("fp", 32).alias("half")),
        F.struct(F.lit(1 << 32).cast("long").alias("base"), F.col("fp").bitwiseAND(low).alias("half")),
    )
    ball = F.array(*(F.lit(m).cast("long") for m in (0, *(1 << i for i in range(32)))))
    entries = (
        distinct.select("fp", F.explode(halves).alias("s"))
        .select("fp", "s.base", "s.half", F.explode(ball).alias("flip"))
        .select((F.col("base") + F.col("half").bitwiseXOR(F.col("flip"))).alias("key"), "fp")
    )
    found, _ = cut(
        entries.repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(lean(lambda b: _scan(b, radius, bucket)), "a long, b long, dense boolean")
        .distinct(),
        "links",
    )
    edges = found.where("not dense").select("a", "b")
    dense = found.where("dense").select(F.col("a").alias("fp")).distinct()
    return edges if dense.isEmpty() else edges.union(midpoint_links(dense, radius))


def midpoint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The same links by a way whose cost is linear in the fingerprints, however dense they lie: two are
    within 2k (2k + 1) bits exactly if their balls of radius k (k and k + 1) share a value."""
    def masks(k: int) -> list[int]:
        found = [0]
        for _ in range(k):
            found = sorted({m ^ (1 << i) for m in found for i in range(64)} | set(found))
        return [m - (1 << 64) if m >> 63 else m for m in found]

    def ball(k: int) -> DataFrame:
        flips = F.array(*(F.lit(m).cast("long") for m in masks(k)))
        return distinct.select("fp", F.explode(flips).alias("flip")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")
        )

    near, far = ball(radius // 2), ball(radius - radius // 2)
    least = near.groupBy("mid").agg(F.min("fp").alias("m"))
    return far.join(least, "mid").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def _rooted(docs: DataFrame, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, th, fp) of every row, (fp, first, least, root) of every fingerprint): first is its least id, least its
    first row as (null, id, th), root names its group."""
    rows, _ = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("th"))).alias("least")
    distinct, _ = cut(rows.groupBy("fp").agg(F.min("id").alias("first"), least), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted, _ = cut(
        distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "least", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    return rows, rooted


def groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp, component_id) of every row; component_id is the least id of its group."""
    rows, rooted = _rooted(docs, radius, id_col, text_col)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes, _ = cut(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("id", "th", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", likeness: tuple[int, int] | None = None) -> DataFrame:
    """``docs`` with one row of each group: of its least id, or (all null) of its least text hash.

    With a ``likeness`` groups are those of ``near_copies``, by the share of five-word shingles. Texts that share four
    of five differ in 9 or 10 of 64 bits, and balls that reach so far meet most of all fingerprints, so their pairs are
    proposed by bands of minima instead of fingerprints."""
    if likeness is not None:
        from quillmark.llm import near_copies

        return near_copies.one_of_each(docs, id_col, text_col, likeness)
    _, rooted = _rooted(docs, radius, id_col, text_col)
    first = rooted.groupBy("root").agg(F.min("least").alias("k"))
    kept, _ = cut(first.select(F.coalesce("k.id", F.lit(0)).alias("id"), F.col("k.null").alias("null"), F.col("k.th").alias("th")), "first")
    return keep_first(docs, kept, id_col, text_col)


def keep_first(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each row of ``first`` (id: 0 for null, null, th). Of rows alike in id and text the one
    whose other columns have the least hash is taken, before rows are shuffled."""
    keys = ["id", "null", "th"]
    rows, short = plain(docs)
    others = [f for f in rows.schema.fields if f.name not in (short[id_col], short[text_col]) and f.dataType.typeName() not in ("map", "variant")]
    every = F.struct(*rows.columns)
    one = rows.select(
        F.coalesce(F.col(short[id_col]).cast("long"), F.lit(0)).alias("id"),
        F.col(short[id_col]).isNull().alias("null"),
        F.xxhash64(F.col(short[text_col]).cast("string")).alias("th"),
        F.xxhash64(F.lit(0), *(f.name for f in others)).alias("o"),
        every.alias("row"),
    )
    kept = one.groupBy(*keys).agg(F.min_by("row", "o").alias("row")).join(first.hint("merge"), keys)  # by one plan at every size
    return renamed(kept.select("row.*"), docs)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return groups(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
