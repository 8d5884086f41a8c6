"""Benchmark decontamination as a prefix-filtered containment join.

Every benchmark item is cut into windows of 13 words (a shorter item is one window). A window is a set
of two-word shingles; containment needs all of them, so the prefix that a document must share is one
shingle, and the rarest one, by its count over all documents, admits the fewest candidates. Documents
emit the places of prefix shingles with the words around them. They are joined to the prefixes, which
bound a candidate by the shingle's place in the window and by the window's length, and the words in those
bounds are joined to the windows, which confirms them word by word.

Windows, prefixes and items stay in tables and are never collected. Two filters of at most ``BITS`` bits tell
documents which shingles to emit; where there are more shingles than they can tell apart, more is emitted and
the joins decide. Texts are judged once however often they occur, and the lists of items are made once for each
set of windows' lists that occurs. Joins with windows and verdicts are salted, as one passage may be in most texts.

Defined results: a null, blank or wordless text has no words, no hits and is clean; repeated items add only
ids; items without words are left out; words in windows of an item with a null id are hit, but the id isn't
listed; a very long text is a batch of its own and emits places like others; repeated documents each get a row; extra columns don't matter, and ``clean`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import WORD_BYTES, cut, lean, rebatched, sized_batches, word_list

WINDOW = 13
#: Share of a document's words that must be hit for it to count as contaminated: 1 in 20.
SHARE = 20
#: The most bits of a filter that goes to every worker; 32 bits a shingle up to there.
BITS = 1 << 26
PROBES = 4
#: Bytes of text that are hashed at a time.
BATCH_BYTES = 4 << 20
#: Parts into which the rows of one key of a join are dealt.
SALTS = 16

_TABLE = np.frombuffer(WORD_BYTES, np.uint8)
_LEFT, _LONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def split_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, and where each text's words begin (and the last's end)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(_TABLE[data])])
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), before[bounds - bounds[0]]


def shingle_keys(words: pa.StringArray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit key of each word with the next and whether both are in one text, and a key of each word alone."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]
    after = np.concatenate([hashes[1:], np.zeros(min(1, len(hashes)), np.uint64)])
    pair = hashes * _LEFT + after
    inside = np.ones(len(hashes), bool)
    inside[starts[1:][starts[1:] > 0] - 1] = False  # a text's last word
    return (pair ^ (pair >> np.uint64(29))).view(np.int64), inside, (hashes * _LONE ^ _LONE).view(np.int64)


def window_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(words: the window joined by spaces, n, keys: its shingles' by place, cls) for every distinct window of
    ``items``, and (cls, ids) for every list of items that a window has."""
    slim = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 256):
            out = [
                (b" ".join(w).decode("utf-8", "surrogatepass"), i)
                for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist())
                for w in dict.fromkeys(windows(word_list(t), width))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in out], pa.string()), pa.array([i for _, i in out], pa.string())], names=["words", "id"]
            )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 4096):
            words, starts = split_words(batch.column("words"))
            pairs, _, lone = shingle_keys(words, starts)
            keys = [pairs[a : b - 1] if b - a > 1 else lone[a:b] for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("words"), batch.column("ids"), pa.array(np.diff(starts), pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["words", "ids", "n", "keys"]
            )

    listed = slim.mapInArrow(lean(cut_up), "words string, id string").groupBy("words").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    table, _ = cut(listed.mapInArrow(lean(keyed), "words string, ids array<string>, n int, keys array<long>"), "windows")
    classes, _ = cut(table.select("ids").distinct().withColumn("cls", F.monotonically_increasing_id()), "classes")
    return cut(table.join(classes, "ids").select("words", "n", "keys", "cls"), "classed")[0], classes


class Filter:
    """A Bloom filter over keys; its size follows their number up to ``BITS``."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Filter:
        n = keys.select(column).distinct().count()
        size = min(BITS, max(1 << 12, 1 << (32 * n).bit_length()))
        key = F.col(column)
        places = F.array(*((key.bitwiseAND(F.lit((1 << 32) - 1)) + i * (F.shiftrightunsigned(key, 32) + 1)).bitwiseAND(F.lit(size - 1)) for i in range(PROBES)))
        words = (
            keys.select(F.explode(places).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
            .toArrow()  # at most BITS / 64 rows
        )
        bits = np.zeros(size // 64, np.int64)
        bits[words.column("w").to_numpy()] = words.column("m").to_numpy()
        return cls(bits.view(np.uint8))

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.int64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        k, size = keys.view(np.uint64), np.uint64(8 * len(self.bits) - 1)
        low, step = k & np.uint64(0xFFFFFFFF), (k >> np.uint64(32)) + np.uint64(1)
        out = None
        for i in range(PROBES):
            at = (low + np.uint64(i) * step) & size
            hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            out = hit if out is None else out & hit
        return out.astype(bool)


def shingle_counts(docs: DataFrame, wanted: DataFrame, lone: bool, text_col: str = "text") -> DataFrame:
    """(k, n): how often the keys ``wanted`` (k), and a few others, occur in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(Filter.of(wanted, "k").bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seek = Filter(held.value)
        for batch in sized_batches(batches, "text", BATCH_BYTES):
            pairs, inside, alone = shingle_keys(*split_words(batch.column("text")))
            found = pairs[inside & seek.holds(pairs)]
            if lone:
                found = np.concatenate([found, alone[seek.holds(alone)]])
            keys, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

    return (
        docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
        .mapInArrow(lean(count), "k long, n long")
        .groupBy("k")
        .agg(F.sum("n").alias("n"))
    )


def prefixes(table: DataFrame, counts: DataFrame) -> DataFrame:
    """(words, n, cls, k, place): each window's rarest shingle. A window that has one which no document has is in none."""
    each = table.select("words", "n", "cls", F.posexplode("keys").alias("place", "k"))
    rarest = each.join(counts.withColumnRenamed("n", "often"), "k", "left").groupBy("words", "n", "cls").agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "k", "place")).alias("p")
    )
    return rarest.where("p.often > 0").select("words", "n", "cls", "p.k", "p.place")


CANDIDATES = "array<struct<k:long,at:int,before:int,around:string>>"


def candidates(docs: DataFrame, prefix: DataFrame, lone: bool, text_col: str, width: int = WINDOW) -> DataFrame:
    """``docs`` without the text, with n_words and the places of prefix shingles: key, place, how many words
    before it are given, and the words around it that a window can reach."""
    held = docs.sparkSession.sparkContext.broadcast(Filter.of(prefix, "k").bits)
    others = [c for c in docs.columns if c != text_col]
    slim = docs.select(*others, F.col(text_col).cast("string").alias(text_col))
    kind = pa.list_(pa.struct([("k", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seek = Filter(held.value)
        for batch in sized_batches(batches, text_col, BATCH_BYTES):
            words, starts = split_words(batch.column(text_col))
            pairs, inside, alone = shingle_keys(words, starts)
            hits = [(int(i), int(pairs[i])) for i in np.flatnonzero(inside & seek.holds(pairs))]
            if lone:
                hits = sorted(hits + [(int(i), int(alone[i])) for i in np.flatnonzero(seek.holds(alone))])
            found: list[list] = [[] for _ in range(batch.num_rows)]
            of = np.searchsorted(starts, [i for i, _ in hits], "right") - 1
            for (i, k), row in zip(hits, of):
                first, last = max(starts[row], i - width + 1), min(starts[row + 1], i + width)
                found[row].append({"k": k, "at": i - int(starts[row]), "before": i - int(first), "around": " ".join(words[first:last].to_pylist())})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(np.diff(starts), pa.int64()), pa.array(found, kind)], names=[*others, "n_words", "found"]
            )

    return slim.mapInArrow(lean(probe), slim.drop(text_col).withColumns({"n_words": F.lit(0).cast("long"), "found": F.lit(None).cast(CANDIDATES)}).schema)


def _salted(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """A join in which the rows of ``left`` that share a key are dealt to ``SALTS`` parts by ``salt``."""
    a = left.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    b = right.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return a.join(b, [*on, "salt"], how).drop("salt")


def spans_of(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """(t1, t2, start, stop, cls) of every window in every distinct text of ``found`` (t1, t2, found)."""
    places = found.where(F.size("found") > 0).select("t1", "t2", F.explode("found").alias("c")).select("t1", "t2", "c.*").distinct()
    bounds = prefix.select("k", "place", "n").distinct()
    first = F.col("before") - F.col("place")
    words = F.split("around", " ")
    near = (
        _salted(places, bounds, ["k"], F.col("t1"))
        .where((first >= 0) & (first + F.col("n") <= F.size(words)))
        .select("t1", "t2", (F.col("at") - F.col("place")).alias("start"), "n", F.array_join(F.slice(words, first + 1, F.col("n")), " ").alias("words"))
    )
    return _salted(near, prefix.select("words", "cls"), ["words"], F.col("t1")).select("t1", "t2", "start", (F.col("start") + F.col("n")).alias("stop"), "cls").distinct()


def verdicts(spans: DataFrame, classes: DataFrame) -> DataFrame:
    """(t1, t2, spans: merged, n_hit, items) of every text with a hit."""
    text = ["t1", "t2"]
    found, _ = cut(spans, "spans")
    order = Window.partitionBy(*text).orderBy("start", "stop")
    reach = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = (
        found.groupBy(*text, "start").agg(F.max("stop").alias("stop"))
        .withColumn("new", (reach < F.col("start")).cast("int"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*text, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    merged = islands.groupBy(*text).agg(F.sort_array(F.collect_list(F.array("start", "stop"))).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("n_hit"))
    of, _ = cut(merged.join(found.groupBy(*text).agg(F.sort_array(F.collect_set("cls")).alias("of")), text), "texts")
    every = of.select("of").distinct().withColumn("cls", F.explode("of")).join(classes, "cls")
    items = every.select("of", F.explode_outer("ids").alias("id")).groupBy("of").agg(F.sort_array(F.collect_set("id")).alias("items"))
    return cut(of.join(items, "of").drop("of"), "verdicts")[0]


def text_keys(text: Column) -> dict[str, Column]:
    """Two hashes that name a text."""
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def find(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(the columns ``keep`` of every document, t1, t2 and n_words; the verdicts on texts with hits)."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)), *(c.alias(n) for n, c in text_keys(text).items()), text.alias("text"))
    table, classes = window_table(items, width=width)
    lone = not table.where("n = 1").isEmpty()
    counts = shingle_counts(slim, table.select(F.explode("keys").alias("k")), lone)
    prefix, _ = cut(prefixes(table, counts), "prefixes")
    found, _ = cut(candidates(slim, prefix, lone, "text", width), "candidates")
    rows = found.select(*(F.col(f"__{i}") for i in range(len(keep))), "t1", "t2", "n_words")
    return rows, verdicts(spans_of(found, prefix), classes)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def judged(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), and in the last six columns n_words, n_hit, n_items,
    spans (merged, in words, end exclusive), items and contaminated, whatever the others are called."""
    names = docs.columns if keep is None else keep
    rows, hits = find(docs, items, names, text_col, width)
    joined = _salted(rows, hits, ["t1", "t2"], F.xxhash64(*(F.col(f"__{i}") for i in range(len(names))), F.lit(0)), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        *(F.col(f"__{i}").alias(c) for i, c in enumerate(names)),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
        found.alias("items"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    rows, hits = find(docs, items, [])
    lengths = rows.groupBy("t1", "t2").agg(F.max("n_words").alias("n_words"))
    bad, _ = cut(hits.join(lengths, ["t1", "t2"]).where(contaminated(F.col("n_hit"), F.col("n_words"))).select("t1", "t2"), "contaminated")
    held = docs.select(*(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(docs.columns)))  # so that no column clashes with the keys
    text = F.col(f"__{docs.columns.index('text')}").cast("string")
    return held.withColumns(text_keys(text)).join(bad, ["t1", "t2"], "left_anti").select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)))


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    listed = F.sha2(F.array_join("items", ","), 256)
    return judged(docs, items, ["doc_id"]).select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS words, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
  FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (
  SELECT k, i, n, item_id FROM places JOIN windows USING (n, words)
), hit_words AS (
  SELECT k, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS j FROM hits) GROUP BY k
), found AS (
  SELECT k, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (k) LEFT JOIN found USING (k)
"""


def brute_force(text: str | None, items: list[tuple], width: int = WINDOW) -> tuple[int, int, list[str]]:
    """(n_words, n_hit, item ids) by comparing each window with each position; for tests."""
    words = word_list(text)
    hit, ids = np.zeros(len(words), bool), set()
    for item, t in items:
        for w in windows(word_list(t), width):
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == list(w):
                    hit[at : at + len(w)] = True
                    ids |= set() if item is None else {str(item)}
    return len(words), int(hit.sum()), sorted(ids)


def listing(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
