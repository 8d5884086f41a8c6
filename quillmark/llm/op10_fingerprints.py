"""Document fingerprints: SimHash of 128 bits, in DataFrame functions only.

Terms are pairs of neighbouring words, lower-cased; a term weighs as often as it occurs. Each term's two
64-bit hashes vote on 128 bits. The votes are counted in long sums of two 32-bit lanes each, partially summed
before the shuffle; a text would need 2^31 terms to overflow a lane, more than a string can hold.

All fingerprints within ``RADIUS`` bits are found through permuted block tables: of 8 blocks of 16 bits, 6
differing bits leave 2 blocks alone, so each of the 28 pairs of blocks is the key of a table, and what
shares a key is compared in full.

Defined results: a null or blank text has fingerprint zero; the next document follows in ascending
doc_id, nulls first, rows of one id by their texts' hashes; a single row is its own next; repeated rows are kept;
a very long text has its votes added as packed sums that don't overflow; an empty table gives an empty table; extra
columns don't matter.
"""

from __future__ import annotations

import json
from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import cut, partitions, remove

BITS = 128
RADIUS = 6
BLOCKS = 8
#: Rows whose ids are divisible by this are looked up among all rows.
QUERY_STEP = 20
_SPACE = " \t\n\r\f\x0b"


def _lanes(h: Column, name: str) -> list[Column]:
    ones = F.lit((1 << 32) | 1).cast("long")
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(ones)).alias(f"{name}{i}") for i in range(32)]


def _bits(name: str) -> Column:
    """The bits that more than half of the terms have set, from the 32 sums called ``name``."""
    low, out = F.lit(0xFFFFFFFF).cast("long"), F.lit(0).cast("long")
    for i in range(32):
        for half, votes in ((0, F.col(f"{name}{i}").bitwiseAND(low)), (32, F.shiftrightunsigned(f"{name}{i}", 32))):
            bit = F.shiftleft(F.lit(1).cast("long"), i + half)
            out = out.bitwiseOR(F.when(votes * 2 > F.col("n_terms"), bit).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and (hi, lo) for every distinct ``keys`` of ``texts``."""
    words = F.split(F.lower(F.btrim(F.col(text_col), F.lit(_SPACE))), "[ \\t\\n\\r\\f\\x0B]+")
    many, w = F.size("__words") > 1, F.col("__words")
    after = F.when(many, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1)))).otherwise(F.array(F.lit("")))
    pairs = (
        texts.select(*keys, words.alias("__words"))
        .select(*keys, many.alias("many"), F.explode(F.arrays_zip(w.alias("a"), after.alias("b"))).alias("p"))
        .where("p.b is not null")  # the last word begins no pair
    )
    real = (F.col("p.a") != "") | F.col("many")
    zero = F.lit(0).cast("long")
    voted = pairs.select(
        *keys,
        F.when(real, F.xxhash64("p.a", "p.b")).otherwise(zero).alias("h"),
        F.when(real, F.xxhash64(F.lit(1), "p.a", "p.b")).otherwise(zero).alias("g"),
        F.when(real, F.lit(1)).otherwise(F.lit(0)).alias("one"),
    )
    summed = voted.groupBy(*keys).agg(F.sum("one").alias("n_terms"), *_lanes(F.col("h"), "h"), *_lanes(F.col("g"), "g"))
    return summed.select(*keys, _bits("h").alias("hi"), _bits("g").alias("lo"))


def likeness(a: tuple, b: tuple) -> Column:
    """1 less the share of differing bits."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / F.lit(float(BITS))


def block_tables(fps: DataFrame) -> DataFrame:
    """An entry (key, hi, lo) of every fingerprint for each of the block pairs; key tells the table as well."""
    def block(i: int) -> Column:
        return F.shiftrightunsigned(F.col("hi" if i < 4 else "lo"), 16 * (3 - i % 4)).bitwiseAND(F.lit(0xFFFF).cast("long"))

    keys = [
        F.shiftleft(block(i), 16).bitwiseOR(block(j)) + F.lit(t << 32).cast("long")
        for t, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))
    ]
    return fps.select("hi", "lo", F.explode(F.array(*keys)).alias("key"))


def near(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q_hi, q_lo, hi, lo) for every distinct fingerprint within ``radius`` of each distinct query."""
    if radius > RADIUS:
        raise ValueError(f"the tables serve a radius of at most {RADIUS}")
    index = block_tables(fps.select("hi", "lo").distinct())
    asked = block_tables(queries.select("hi", "lo").distinct()).select("key", F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"))
    differing = F.bit_count(F.col("hi").bitwiseXOR(F.col("q_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("q_lo")))
    return index.join(asked, "key").where(differing <= radius).select("q_hi", "q_lo", "hi", "lo").distinct()


def _bucket(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted ``bounds`` the row's (a, h) reaches, searched in two steps of about their root."""
    step = isqrt(len(bounds)) + 1
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    pair = "struct<a:bigint,h:bigint>"
    listed = lambda some: [{"a": a, "h": h} for a, h in some]
    tops = F.from_json(F.lit(json.dumps(listed(c[0] for c in chunks if c))), f"array<{pair}>")
    lists = F.from_json(F.lit(json.dumps([listed(c) for c in chunks])), f"array<array<{pair}>>")
    reached = lambda array: F.size(F.filter(array, lambda b: b <= F.struct("a", "h")))
    at = F.greatest(reached(tops) - 1, F.lit(0))
    return (at * step + reached(F.get(lists, at))).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, next_rid, doc_id, text, next_text): every row with the row that follows it, by doc_id (null ids first), then by
    the text's hash.

    Rows are dealt to buckets, ranges of that order, one to a task; where ranges begin is taken from slim rows, so that
    rows of one id are spread like any others. To each bucket goes a copy of the next bucket's first row as well, so texts
    are shuffled only once.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = src.withColumns({"a": F.coalesce("doc_id", F.lit(-(1 << 63))), "h": F.xxhash64("text")})
    n = 4 * partitions(spark)
    ordered, path = cut(keyed.select("a", "h").repartitionByRange(n, "a", "h").withColumn("part", F.spark_partition_id()), "order")
    bounds = sorted(tuple(r.x) for r in ordered.groupBy("part").agg(F.min(F.struct("a", "h")).alias("x")).collect())  # a row for each range
    remove(spark, path)
    dealt = keyed.withColumn("bucket", _bucket(bounds[1:]))
    follow = [(*first, k, (k - 1) % len(bounds)) for k, first in enumerate(bounds)]
    heads = F.broadcast(spark.createDataFrame(follow, "fa long, fh long, own long, before int"))  # a row for each bucket
    copies = (
        dealt.join(heads, (F.col("bucket") == F.col("own")) & (F.col("a") == F.col("fa")) & (F.col("h") == F.col("fh")))
        .groupBy("own", "before", "a", "h")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", "a", "h", F.col("before").alias("bucket"), "own")
    )
    rows = dealt.withColumn("own", F.lit(-1).cast("long")).unionByName(copies).repartitionById(n, F.col("bucket"))
    order = Window.partitionBy("bucket").orderBy(F.col("own") >= 0, "a", "h")
    own = F.lead("own").over(order)
    rid = F.shiftleft(F.col("bucket").cast("long"), 40) + F.row_number().over(order) - 1
    return (
        rows.select("doc_id", "text", F.lead("text").over(order).alias("next_text"), rid.alias("rid"), own.alias("after"), "own")
        .where("own < 0")
        .select("rid", F.when(F.col("after") >= 0, F.shiftleft("after", 40)).otherwise(F.col("rid") + 1).alias("next_rid"), "doc_id", "text", "next_text")
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as much of the beginning of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def query(docs: DataFrame) -> DataFrame:
    both = with_next(docs).select(
        "rid", "next_rid", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited(F.col("text"), F.col("next_text")).alias("edited")
    ).select(
        "rid", "next_rid", "doc_id", "n_chars",
        F.explode(F.array(
            F.struct(F.lit(0).alias("w"), F.col("text").alias("t"), F.lit(None).cast("binary").alias("sha")),
            F.struct(F.lit(1).alias("w"), F.col("edited").alias("t"), F.unhex(F.sha2("edited", 256)).alias("sha")),
        )).alias("x"),
    ).select("rid", "next_rid", "doc_id", "n_chars", F.col("x.w").alias("w"), F.col("x.t").alias("text"), F.col("x.sha").alias("sha"))
    found, _ = cut(fingerprints(both, ["rid", "next_rid", "doc_id", "n_chars", "w", "sha"]), "fingerprints")
    plain = found.where("w = 0").select("rid", "next_rid", "doc_id", "n_chars", "hi", "lo")
    changed = found.where("w = 1").select("rid", "sha", F.col("hi").alias("e_hi"), F.col("lo").alias("e_lo"))
    after = found.where("w = 0").select(F.col("rid").alias("next_rid"), F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo"))
    weights = plain.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    asked = plain.where(F.pmod("doc_id", F.lit(QUERY_STEP)) == 0)
    counts, _ = cut(
        near(plain, asked).join(weights, ["hi", "lo"]).groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("n_near")), "near"
    )
    hexed = lambda hi, lo: F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))
    own = (F.col("hi"), F.col("lo"))
    return (
        plain.join(changed, "rid")
        .join(after, "next_rid")
        .join(counts, ["hi", "lo"], "left")
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("sha")).alias("edited_sha256"),
            hexed("hi", "lo").alias("fingerprint"),
            hexed("e_hi", "e_lo").alias("edited_fingerprint"),
            likeness(own, (F.col("e_hi"), F.col("e_lo"))).alias("near_edited"),
            likeness(own, (F.col("n_hi"), F.col("n_lo"))).alias("near_next"),
            F.when(F.pmod("doc_id", F.lit(QUERY_STEP)) == 0, F.col("n_near")).alias("n_near"),
        )
    )
