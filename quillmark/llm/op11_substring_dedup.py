"""Substring dedup by relative Lempel-Ziv parsing: words under windows that occur again anywhere are removed.

Which reference blocks can hold a window follows from its anchor: of the short seeds in the window the one whose hash
is least (the first of such). Equal windows have equal anchors at equal places. A document is cut into segments, the
stretches of windows of one anchor; segments whose anchor occurs once hold nothing that is repeated, and the others
go to the block of their anchor's hash. Every window is in one segment alone, so that two places in blocks are two places
in the corpus. Segments that are alike, by 128 bits of hashes, are one segment of a block, with a number of copies.

A block is indexed by a suffix array of words, and each of its segments is factored against all of it but itself:
the longest prefix that also begins elsewhere is a factor, and the next begins behind it. A factor of a window's
length is a duplicate span. A repeated window that no factor holds lies across the boundary of two, as what follows
the boundary is repeated as well; so the windows across a boundary are looked up where both factors together are long
enough, and nowhere else.

The segments of an anchor stay together, unless there are more than ``CROWD`` different ones, as where a passage that
everyone has meets everyone's own words. Then they are cut at fixed places around the anchor into parts, whose windows all hold
the same longer stretch of words; that stretch takes the anchor's place. A part whose stretch occurs once has nothing to match,
and parts whose stretch has no more than ``CROWD`` different ones meet in a block. Of the others, which hold the border of
what everyone has, the windows are counted by 128 bits of hashes; each that occurs again becomes a segment of its own, with
its number of copies, and takes the same way. A window has w places for its seed, and parts have at most about the root of w
windows, so that a segment makes about twice that root of rows where single windows would make w.

Defined results: null, empty and blank texts have no words and lose none; so do texts shorter than a window; repeated rows are
copies of each other, whatever their ids, and lose all windows; windows may overlap their copy; of seeds whose hashes
tie the first counts; a very long text is hashed in one batch of its own and its segments are dealt like others; an empty
table gives no rows; ``without_repeats`` keeps extra columns, whatever their names, and texts without repeats as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, lean, partitions, plain, rebatched, remove, sized_batches

WINDOW = 35
#: Different segments of an anchor that stay in one block.
CROWD = 256
#: Words of a block, but for its last anchor's; bytes of text hashed at a time, and of one pass of a hash.
BLOCK, BATCH_BYTES, PASS = 200_000, 2 << 20, 1 << 20

_BASE, _STEP, _PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)
#: 0 for the bytes between words, else the byte and 1.
_VALUE = np.array([0 if b == 32 or 9 <= b <= 13 else b + 1 for b in range(256)], np.uint64)


def seed_words(window: int) -> int:
    return max(1, window // 4)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number modulo 2^64, and of its inverse."""
    have = _TABLES.get(int(base))
    if have is None or len(have[0]) < n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        have = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, PASS), b, np.uint64)])) for b in (base, inverse))
        if n <= 4 * PASS:  # tables for longer texts aren't kept
            _TABLES[int(base)] = have
    return have


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word, of the bytes from its start to the next one's that aren't between words."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + PASS)))
        end = starts[upto] if upto < len(starts) else len(data)
        power, inverse = _powers(_BASE, int(end - starts[at]))
        values = _VALUE[data[starts[at] : end]]
        values *= power[: len(values)]
        local = starts[at:upto] - starts[at]
        out[at:upto] = _mixed(np.add.reduceat(values, local) * inverse[local])
        at = upto
    return out


def _placed_segments(texts: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """What ``segments`` gives, and how many words of each segment stand before its anchor."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = (ends - ends[0]).astype(np.int64)
    inside = _VALUE[data] != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    seed = seed_words(window)
    wide = window - seed + 1
    n = len(starts) - window + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    words = _word_hashes(data, starts)
    of = np.searchsorted(ends[1:], starts, "right")
    first = np.searchsorted(starts, ends[:-1])  # each text's first word
    grams = np.zeros(len(words) - seed + 1, np.uint64)
    for j in range(seed):
        grams = grams * _STEP + words[j : j + len(grams)]
    grams = _mixed(grams)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < wide:
        more = min(width, wide - width)
        least = np.minimum(least[:-more], least[more:])
        width += more
    whole = np.flatnonzero(of[:n] == of[window - 1 :])  # windows within a text
    if not len(whole):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    anchor = (least[whole] & _LOW).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(heads, len(whole)))
    at = whole[heads]
    power, inverse = _powers(_PLACE, len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[: len(words)])])
    content = _mixed((sums[at + count + window - 1] - sums[at]) * inverse[at] + count.astype(np.uint64))
    return of[at], at - first[of[at]], count, grams[anchor[heads]].view(np.int64), content.view(np.int64), anchor[heads] - at


def segments(texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first word, number of windows, hash of the anchor, hash of all words) of every segment of some texts."""
    return _placed_segments(texts, window)[:5]


_ANCHORS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("rid", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def anchors(rows: DataFrame, window: int) -> DataFrame:
    """(h, c, rid, s, n): the segments of all texts, by anchor, words, row, first word and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", BATCH_BYTES):
            of, s, n, h, c = segments(batch.column("text"), window)
            rids = batch.column("rid").to_numpy()[of] if len(of) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type, safe=False) for x, f in zip((h, c, rids, s, n), _ANCHORS)], schema=_ANCHORS)

    return rows.select("rid", "text").mapInArrow(lean(run), "h long, c long, rid long, s int, n int")


def _texts(rows: DataFrame, window: int) -> DataFrame:
    """(h, c, n, m, crowded, words): the words of each segment that ``rows`` (text, found) ask for, joined by a space."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("crowded", pa.bool_()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", BATCH_BYTES):
            found = batch.column("found")
            asked, sizes = found.flatten(), pc.list_value_length(found).to_numpy()
            s, n = (asked.field(k).to_numpy() for k in ("s", "n"))
            words, at = [], 0
            for text, size in zip(batch.column("text"), sizes):
                split = text.as_py().encode("utf-8", "surrogatepass").split()
                words += [b" ".join(split[a : a + b + window - 1]) for a, b in zip(s[at : at + size].tolist(), n[at : at + size].tolist())]
                at += size
            out = pa.RecordBatch.from_arrays([*(asked.field(k) for k in ("h", "c", "n", "m", "crowded")), pa.array(words, pa.binary())], schema=schema)
            for lo in range(0, out.num_rows, 20_000):
                yield out.slice(lo, 20_000)

    return rows.select("text", "found").mapInArrow(lean(run), "h long, c long, n int, m long, crowded boolean, words binary")


def part_windows(window: int) -> int:
    """How many windows a part of a segment has at most: the root, rounded up, of the places that a window has for its seed."""
    return math.isqrt(window - seed_words(window)) + 1


def _parts(rows: DataFrame, window: int) -> DataFrame:
    """(h, c, n, m, at, x, y, k): the parts of the segments ``rows`` (h, c, n, m, words), each with its first window, the hash of
    the words that all windows have which stand as they do around the anchor, the hash of all its words, and minus its number of windows.
    Where one part ends and the next begins depends on the anchor alone, so that equal windows are in parts of one x."""
    wide, width = window - seed_words(window) + 1, part_windows(window)
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("at", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("k", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "words", BATCH_BYTES):
            found: list[list] = [[] for _ in range(5)]
            before = _placed_segments(batch.column("words"), window)[5].tolist()  # a segment's words are one segment again
            for row, (n, words, p) in enumerate(zip(batch.column("n").to_pylist(), batch.column("words").to_pylist(), before, strict=True)):
                split, at = words.split(), 0
                while at < n:  # the window at ``at`` has p - at words before the anchor
                    low = (p - at) // width * width
                    high, upto = min(low + width, wide) - 1, min(n, p - low + 1)
                    core = b" ".join([b"%d" % low, *split[p - low : p - high + window]])
                    whole = b" ".join(split[at : upto + window - 1])
                    values = (row, at, xxhash.xxh3_64_intdigest(core) - (1 << 63), xxhash.xxh3_64_intdigest(whole, 1) - (1 << 63), at - upto)
                    for column, v in zip(found, values):
                        column.append(v)
                    at = upto
            of = pa.array(found[0], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("h", "c", "n", "m")), *(pa.array(v, f.type) for v, f in zip(found[1:], list(schema)[4:]))], schema=schema)

    return rows.select("h", "c", "n", "m", "words").mapInArrow(lean(run), "h long, c long, n int, m long, at int, x long, y long, k int")


def _single_windows(rows: DataFrame, window: int) -> DataFrame:
    """(h, c, n, m, hashes): two hashes of the words of each window of the segments or parts ``rows``, in their order."""
    hashes = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("hashes", hashes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 1000):
            found = []
            for n, words in zip(batch.column("n").to_pylist(), batch.column("words").to_pylist()):
                split = words.split()
                pairs = (divmod(xxhash.xxh3_128_intdigest(b" ".join(split[at : at + window])), 1 << 64) for at in range(abs(n)))
                found.append([{"x": x - (1 << 63), "y": y - (1 << 63)} for x, y in pairs])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "c", "n", "m")), pa.array(found, hashes)], schema=schema)

    return rows.select("h", "c", "n", "m", "words").mapInArrow(lean(run), "h long, c long, n int, m long, hashes array<struct<x:long,y:long>>")


def _window_words(rows: DataFrame, window: int) -> DataFrame:
    """(h, c, n, m, crowded, words): what ``rows`` (words of a segment or part, asked: at, x, y, k, m, crowded) ask for, as segments:
    parts with their k, which is below 0, as n, and single windows with a k of 0."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("crowded", pa.bool_()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 1000):
            out: list[list] = [[] for _ in schema]
            for words, asked in zip(batch.column("words").to_pylist(), batch.column("asked").to_pylist()):
                split = words.split()
                for w in asked:
                    own = b" ".join(split[w["at"] : w["at"] + max(-w["k"], 1) + window - 1])
                    for column, v in zip(out, (w["x"], w["y"], w["k"], w["m"], w["crowded"], own)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return rows.select("words", "asked").mapInArrow(lean(run), "h long, c long, n int, m long, crowded boolean, words binary")


class Block:
    """A reference block of segments (lists of words), indexed by a suffix array over the words of all of them."""

    def __init__(self, texts: list[list[bytes]], copies: list[int]):
        ids: dict[bytes, int] = {}
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        seq = np.empty(int((self.lengths + 1).sum()), np.int64)
        for k, (t, a) in enumerate(zip(texts, self.starts.tolist())):
            seq[a : a + len(t)] = [ids.setdefault(w, len(ids)) for w in t]
            seq[a + len(t)] = -1 - k
        breaks = seq < 0  # each segment ends with a sign of its own
        seq[breaks] = len(ids) - 1 - seq[breaks]
        self.copied = np.repeat(np.array(copies) > 1, self.lengths + 1)
        self.ends = np.repeat(self.starts + self.lengths, self.lengths + 1)
        n = len(seq)
        self.levels, rank, p = [], seq, 1  # ranks by the first 1, 2, 4, ... words
        while True:
            self.levels.append(np.concatenate([rank, [-1]]))
            key = rank * (n + 2)
            key[: max(n - p, 0)] += rank[p:] + 1
            order = np.argsort(key)
            found = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[False], found[1:] != found[:-1]])) if n else 0
            rank, p = new, 2 * p
            if n == 0 or int(rank[order[-1]]) == n - 1:
                break
        self.rank, self.suffixes = rank, order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and b begin with alike."""
        got, last = np.zeros(len(a), np.int64), len(self.rank)
        for k in reversed(range(len(self.levels))):
            x, y = np.minimum(a + got, last), np.minimum(b + got, last)
            got += np.where((self.levels[k][x] == self.levels[k][y]) & (x < last) & (y < last), 1 << k, 0)
        return got

    def longest(self, at: np.ndarray) -> np.ndarray:
        """The lengths of the longest matches of what begins at these places with what begins at another place. A
        segment with copies matches one of them up to its end."""
        r = self.rank[at]
        before = np.where(r > 0, self._common(at, self.suffixes[np.maximum(r - 1, 0)]), 0)
        after = np.where(r < len(self.rank) - 1, self._common(at, self.suffixes[np.minimum(r + 1, len(self.rank) - 1)]), 0)
        return np.maximum(np.maximum(before, after), np.where(self.copied[at], self.ends[at] - at, 0))

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length) of the factors of all segments, in order; a word that is nowhere else is a factor of length 0."""
        at, begins, lengths = self.starts[self.lengths > 0], [], []
        while len(at):
            long = self.longest(at)
            begins.append(at)
            lengths.append(long)
            nxt = at + np.maximum(long, 1)
            at = nxt[nxt < self.ends[at]]
        begin, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, lengths))
        order = np.argsort(begin)
        return begin[order], length[order]

    def duplicates(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, from, to): stretches of words that repeated windows cover."""
        begin, length = self.factors()
        cover = np.zeros(len(self.rank) + 1, np.int64)
        long = length >= window
        np.add.at(cover, begin[long], 1)
        np.add.at(cover, begin[long] + length[long], -1)
        end, following = begin[:-1] + length[:-1], length[1:]
        tried = (end == begin[1:]) & (length[:-1] > 0) & (length[:-1] + following >= window)
        low = np.maximum(begin[:-1] + 1, end - window + 1)[tried]
        high = np.minimum(end - 1, end + following - window)[tried]
        many = np.maximum(high - low + 1, 0)
        across = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum())) if len(many) else np.zeros(0, np.int64)
        across = across[self.longest(across) >= window] if len(across) else across
        np.add.at(cover, across, 1)
        np.add.at(cover, across + window, -1)
        covered = np.cumsum(cover) > 0
        edges = np.diff(np.concatenate([[False], covered]).astype(np.int8))
        a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        of = np.searchsorted(self.starts, a, "right") - 1
        return of, a - self.starts[of], b - self.starts[of]


def factored(rows: DataFrame, window: int) -> DataFrame:
    """(h, c, n, spans): of segments (h, c, n, m, words), those with duplicate spans, which are in words from the segment's begin.
    The segments of one h meet in one block."""
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("spans", span)])

    def solved(held: list[tuple]) -> pa.RecordBatch:
        of, a, b = Block([w.split() for *_, w in held], [m for _, _, _, m, _ in held]).duplicates(window)
        found: dict[int, list] = {}
        for k, x, y in zip(of.tolist(), a.tolist(), b.tolist()):
            found.setdefault(k, []).append({"a": x, "b": y})
        columns = [[held[k][j] for k in found] for j in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([*columns, list(found.values())], schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "n", "m", "words"))):
                if size >= BLOCK and row[0] != last:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                last, size = row[0], size + abs(row[2]) + window
        if held:
            yield solved(held)

    dealt = rows.select("h", "c", "n", "m", "words").repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(lean(run), "h long, c long, n int, spans array<struct<a:int,b:int>>")


def repeats(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, spans): the stretches of words, from row to row by ``rid``, that repeated windows cover; not merged."""
    every, path = cut(anchors(rows, window), "anchors")
    # tables of keys are written before they are joined, so that the other side's hot keys can be split
    again, keys = cut(every.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "again")
    places, _ = cut(every.join(again, "h"), "places")
    remove(rows.sparkSession, path)
    remove(rows.sparkSession, keys)
    key = ["h", "c", "n"]
    unlike, _ = cut(places.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("rid"), F.min_by("s", "rid").alias("s")), "segments")
    crowds, _ = cut(unlike.groupBy("h").agg(F.count(F.lit(1)).alias("k")).select("h", (F.col("k") > CROWD).alias("crowded")), "crowds")
    asked = unlike.join(crowds, "h").groupBy("rid").agg(F.collect_list(F.struct("s", *key, "m", "crowded")).alias("found"))  # of a text's own
    texts, _ = cut(_texts(rows.select("rid", "text").join(asked, "rid"), window), "words")
    crowded = texts.where("crowded")
    parts, _ = cut(_parts(crowded, window), "parts")
    alike, _ = cut(parts.groupBy("x", "y", "k").agg(F.sum("m").alias("m"), F.min(F.struct(*key, "at")).alias("one")), "alike")
    tops, _ = cut(alike.groupBy("x").agg(F.sum("m").alias("t"), F.count(F.lit(1)).alias("k")).where("t > 1").select("x", (F.col("k") > CROWD).alias("crowded")), "tops")
    asked = alike.join(tops, "x").select("one.*", "x", "y", "k", "m", "crowded").groupBy(*key).agg(F.collect_list(F.struct("at", "x", "y", "k", "m", "crowded")).alias("asked"))  # of a segment's own
    pieces, _ = cut(_window_words(crowded.select(*key, "words").join(asked, key), window), "pieces")
    borders = pieces.where("crowded")
    hashed, _ = cut(_single_windows(borders, window), "windows")  # a row a part
    each = hashed.select(*key, "m", F.posexplode("hashes").alias("at", "w")).select(*key, "m", "at", "w.x", "w.y")
    # a window that is nowhere else has nothing to match; of the others one part gives the words
    more, _ = cut(each.groupBy("x", "y").agg(F.sum("m").alias("m"), F.min(F.struct(*key, "at")).alias("one")).where("m > 1"), "repeated")
    single = F.struct("at", "x", "y", F.lit(0).alias("k"), "m", F.lit(False).alias("crowded"))
    asked = more.select("one.*", "x", "y", "m").groupBy(*key).agg(F.collect_list(single).alias("asked"))  # of a part's own
    own = _window_words(borders.select(*key, "words").join(asked, key), window)
    blocks = texts.where("not crowded").unionByName(pieces.where("not crowded")).unionByName(own)
    found, _ = cut(factored(blocks.select(*key, "m", "words"), window), "factors")
    whole = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + window).alias("b")))
    back = each.select(*key, "x", "y", whole.alias("spans")).join(found.where("n = 0").select(F.col("h").alias("x"), F.col("c").alias("y")), ["x", "y"]).groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    pieced, _ = cut(found.where("n < 0").unionByName(back), "pieced")  # parts, then their segments
    inside = F.transform("spans", lambda x: F.struct((x.a + F.col("at")).alias("a"), (x.b + F.col("at")).alias("b")))
    joined = parts.join(pieced.toDF("x", "y", "k", "spans"), ["x", "y", "k"]).select(*key, inside.alias("spans")).groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    known = found.where("n > 0").unionByName(joined)
    moved = F.transform("spans", lambda x: F.struct((x.a + F.col("s")).alias("a"), (x.b + F.col("s")).alias("b")))
    return places.join(known, key).select("rid", moved.alias("spans")).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of a text's own


def _gone(spans: list[dict] | None, n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(edges, [x["a"] for x in spans], 1)
        np.add.at(edges, [x["b"] for x in spans], -1)
    return np.cumsum(edges[:n]) > 0


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """A written table of ``docs`` under plain names, with their text and a number for each row."""
    rows, short = plain(docs)
    text = F.col(short[text_col]).cast("string").alias("text")
    return cut(rows.select(*(c for c in rows.columns if c != short[text_col]), text, F.monotonically_increasing_id().alias("rid")), "texts")[0]


def marked(docs: DataFrame, window: int = WINDOW, text_col: str = "text", texts: bool = True) -> DataFrame:
    """``docs`` (columns __0, __1, ... but for the text) with n_words, n_removed, the digest of the kept words and, if
    asked for, ``text``: what is kept, or the text itself where nothing is removed."""
    rows = _numbered(docs, text_col)
    found, _ = cut(repeats(rows, window), "repeats")
    joined = rows.join(found, "rid", "left").drop("rid")
    names = [c for c in joined.columns if c not in ("text", "spans")]
    more = [("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")] + [("text", "string")] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", BATCH_BYTES):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                text = text.as_py()
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                gone = _gone(spans.as_py(), len(words))
                removed = int(gone.sum())
                kept = b" ".join(words if not removed else [words[k] for k in np.flatnonzero(~gone).tolist()])
                for column, v in zip(out, (len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if removed and texts else text)):
                    column.append(v)
            arrays = [pa.array(v, t) for v, t in zip(out[: len(more)], (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], names=[*names, *(c for c, _ in more)])

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *(f"{c} {k}" for c, k in more)])
    return joined.mapInArrow(lean(run), ddl)


def without_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` without the words that repeated windows cover; texts that lose words have the others joined by spaces."""
    found = marked(docs, window, text_col)
    return found.select(*((F.col("text") if c == text_col else F.col(f"__{i}")).alias(c) for i, c in enumerate(docs.columns)))


def query(docs: DataFrame) -> DataFrame:
    found = marked(docs.select("doc_id", "text"), texts=False)
    return found.select(F.col("__0").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS x FROM (SELECT k, w, unnest(generate_series(1, len(w) - 34)) AS i FROM docs WHERE len(w) >= 35)
), again AS (
  SELECT k, i FROM places WHERE x IN (SELECT x FROM places GROUP BY x HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT k, i + o AS j FROM again, (SELECT unnest(generate_series(0, 34)) AS o)
), words AS (
  SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs
), kept AS (
  SELECT k, count(*) FILTER (WHERE gone.j IS NOT NULL)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS t
  FROM words LEFT JOIN gone USING (k, j) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (k)
"""
