"""Keywords that texts contain approximately: an approximate substring join with count filters.

A window of a text is a keyword's length and ``OVER`` characters more, from each place on; its score is the ratio of
characters in common blocks (Ratcliff-Obershelp). Few windows are scored. To reach a score, a window must share so many
characters with the keyword, and, as blocks are parted by what isn't shared, so many pairs of neighbours. Characters are
counted for all windows of many texts at once, in running numbers of a byte that all keywords share; for the windows that
are left, pairs are counted and the longest common subsequence is found, and they are scored from the highest bound
down until no bound exceeds the best score. Texts pass by once, whatever the number of keywords.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.shared import spread

# Fixed value: how many characters a window is longer than its keyword.
OVER = 5
#: Windows whose characters are counted at a time, in the general way, and by running numbers.
SLICE, BLOCK = 4096, 1 << 16
#: Characters of a longer window can't be counted in a byte.
BYTE = 255
_TABLE = 1 << 16


def _pairs(codes: np.ndarray) -> np.ndarray:
    """A number below ``_TABLE`` for each two neighbours; unlike pairs may share one, which only loosens the filter."""
    c = codes.astype(np.uint64)
    return ((c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)).astype(np.uint16)


class Keyword:
    def __init__(self, word: str):
        self.word = word
        self.low = word.lower()
        codes = np.frombuffer(self.low.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars, self.times = np.unique(codes, return_counts=True)
        self.pairs = np.zeros(_TABLE, bool)
        self.pairs[_pairs(codes)] = True
        self.places = np.array([sum(1 << k for k in np.flatnonzero(codes == c).tolist()) & ((1 << 64) - 1) for c in self.chars], np.uint64)

    def needed(self, window: int, threshold: float) -> tuple[int, int]:
        """How many characters, and pairs, a window of this length must share to reach ``threshold``."""
        both = len(self.low) + window
        least = int(np.ceil(threshold * both / 2 - 1e-9))
        return least, 3 * least - both - 1  # a break between blocks costs a pair, and an unshared character on a side at least

    def common(self, grid: np.ndarray) -> np.ndarray:
        """At most how many characters each row of ``grid``, a window, has in common blocks with the keyword: the length of
        their longest common subsequence, in which blocks lie; of keywords of 64 characters or more, the characters alone."""
        size = len(self.low)
        if size >= 64:
            return sum(np.minimum((grid == c).sum(1), t) for c, t in zip(self.chars, self.times))
        at = np.minimum(np.searchsorted(self.chars, grid), len(self.chars) - 1)
        places = np.where(self.chars[at] == grid, self.places[at], np.uint64(0))
        open_ = np.full(len(grid), np.uint64((1 << 64) - 1))  # a bit for each place that ends no longer subsequence
        for k in range(grid.shape[1]):
            used = open_ & places[:, k]
            open_ = (open_ + used) | (open_ - used)
        return size - np.bitwise_count(open_ & np.uint64((1 << size) - 1)).astype(np.int64)

    def match(self, low: str, codes: np.ndarray, pairs: np.ndarray, threshold: float) -> tuple[float, int, int]:
        """(best score, 0 if it is below ``threshold``; windows; windows that were scored) of a lower-cased text."""
        size, n = len(self.low), len(low)
        windows = max(1, n - size + 1)
        if not size or not n:
            return 0.0, 0, 0
        if self.low in low:
            return 1.0, windows, 0
        whole = max(0, n - size - OVER + 1)  # windows that the text's end doesn't shorten
        hit = np.concatenate([[0], np.cumsum(self.pairs[pairs], dtype=np.int32)])
        inner, need = size + OVER - 1, self.needed(size + OVER, threshold)
        left = np.flatnonzero(hit[inner : inner + whole] - hit[:whole] >= need[1]) if need[0] <= size else np.zeros(0, np.int64)
        tail = [i for i in range(whole, windows) if (t := self.needed(n - i, threshold))[0] <= size and hit[max(n - 1, i)] - hit[i] >= t[1]]
        left = np.concatenate([left, np.array(tail, np.int64)])
        both = size + np.minimum(size + OVER, n - left)
        best, scored = 0.0, 0
        bounds = np.zeros(len(left))
        padded = np.concatenate([codes, np.full(size + OVER, np.iinfo(np.uint32).max, np.uint32)])
        for at in range(0, len(left), SLICE):
            some = left[at : at + SLICE]
            grid = padded[some[:, None] + np.arange(size + OVER)]
            bounds[at : at + SLICE] = 2.0 * self.common(grid) / both[at : at + SLICE]
        for k in np.argsort(-bounds, kind="stable"):
            if bounds[k] < threshold - 1e-12 or bounds[k] <= best:
                break
            i = int(left[k])
            scored += 1
            best = max(best, SequenceMatcher(None, self.low, low[i : i + size + OVER]).ratio())
        return (best if best >= threshold else 0.0), windows, scored


class Texts:
    """Lower-cased texts, none empty, one behind the other with a mark between them that no keyword has."""

    def __init__(self, lows: list[str], known: list[Keyword]):
        used = {c for w in known for c in w.low}
        self.mark = next(c for c in map(chr, range(len(used) + 1)) if c not in used)
        self.joined = self.mark.join(lows)
        self.codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.pairs = _pairs(self.codes)
        self.sizes = np.array([len(t) for t in lows], np.int64)
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.starts = self.ends - self.sizes

    def holding(self, w: Keyword) -> np.ndarray:
        """Which texts contain the keyword."""
        found = np.zeros(len(self.sizes), bool)
        at = self.joined.find(w.low)
        while at >= 0:
            k = int(np.searchsorted(self.ends, at, "right"))
            found[k] = True
            at = self.joined.find(w.low, int(self.ends[k]))
        return found

    def sharing(self, known: list[Keyword], threshold: float) -> list[np.ndarray]:
        """For each keyword the places of the windows, of a whole window's length, that share enough characters with it."""
        over = max((len(w.low) for w in known), default=0) + OVER
        found: list[list[np.ndarray]] = [[] for _ in known]
        for a in range(0, len(self.codes), BLOCK):
            codes = self.codes[a : a + BLOCK + over]
            running: dict[int, np.ndarray] = {}
            for w, out in zip(known, found):
                window = len(w.low) + OVER
                least = w.needed(window, threshold)[0]
                n = min(BLOCK, len(codes) - window + 1)
                if least > len(w.low) or n <= 0:
                    continue
                shared = np.zeros(n, np.uint8)
                for c, most in zip(w.chars.tolist(), w.times.tolist()):
                    if c not in running:
                        running[c] = np.zeros(len(codes) + 1, np.uint8)
                        np.cumsum(codes == c, dtype=np.uint8, out=running[c][1:])
                    times = running[c][window : window + n] - running[c][:n]
                    shared += np.minimum(times, np.uint8(most), out=times)
                if least <= 0 or (shared.max() >= least):
                    out.append(np.flatnonzero(shared >= max(least, 0)) + a)
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]

    def likely(self, w: Keyword, at: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, bounds) of the windows at ``at``, all of one length, that may reach ``threshold``."""
        need = w.needed(window, threshold)
        if need[0] > len(w.low):
            at = at[:0]
        kept, bounds = [], []
        for k in range(0, len(at), SLICE):
            some = at[k : k + SLICE]
            if need[1] > 0:
                some = some[w.pairs[self.pairs[some[:, None] + np.arange(window - 1)]].sum(1) >= need[1]]
            bound = 2.0 * w.common(self.codes[some[:, None] + np.arange(window)]) / (len(w.low) + window)
            enough = bound >= threshold - 1e-12
            kept.append(some[enough])
            bounds.append(bound[enough])
        return (np.concatenate(kept), np.concatenate(bounds)) if kept else (at, np.zeros(0))

    def scores(self, w: Keyword, sharing: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, numbers of scored windows): what ``Keyword.match`` finds in each text. ``sharing`` is the keyword's."""
        size, window = len(w.low), len(w.low) + OVER
        best, scored = np.zeros(len(self.sizes)), np.zeros(len(self.sizes), np.int64)
        held = self.holding(w)
        best[held] = 1.0
        of = np.searchsorted(self.ends, sharing, "right")
        found = [self.likely(w, sharing[(sharing >= self.starts[of]) & (sharing + window <= self.ends[of]) & ~held[of]], window, threshold)]
        for length in range(window - 1, size - 1, -1):  # those that the text's end shortens
            found.append(self.likely(w, self.ends[(self.sizes >= length) & ~held] - length, length, threshold))
        for k in np.flatnonzero((self.sizes < size) & ~held).tolist():
            low = self.joined[self.starts[k] : self.ends[k]]
            best[k], _, scored[k] = w.match(low, self.codes[self.starts[k] : self.ends[k]], self.pairs[self.starts[k] : self.ends[k] - 1], threshold)
        at, bounds = (np.concatenate(x) for x in zip(*found))
        of = np.searchsorted(self.ends, at, "right")
        for j in np.lexsort((at, -bounds, of)).tolist():
            k, i = int(of[j]), int(at[j])
            if bounds[j] <= best[k]:
                continue
            scored[k] += 1
            best[k] = max(best[k], SequenceMatcher(None, w.low, self.joined[i : min(i + window, int(self.ends[k]))]).ratio())
        best[best < threshold] = 0.0
        return best, scored


def fuzzy_matches(df: DataFrame, key: str, text: str, keywords: list[str], threshold: float) -> DataFrame:
    """(key, keyword, score, windows, scored) of every text and each of its ``keywords`` that reaches ``threshold``, in
    any case; a keyword that is contained scores 1. ``keywords`` are a profile's: they go to every task. An empty or null
    text and an empty keyword match nothing."""
    known = [w for w in map(Keyword, dict.fromkeys(keywords)) if w.low]
    short = [w for w in known if len(w.low) + OVER <= BYTE]
    kind = df.schema[key].dataType.simpleString()

    def solved(keys: pa.Array, lows: list[str]) -> pa.RecordBatch:
        texts = Texts(lows, known)
        sharing = dict(zip((w.word for w in short), texts.sharing(short, threshold)))
        n, m = len(lows), len(known)
        score, scored, windows = np.zeros((n, m)), np.zeros((n, m), np.int64), np.zeros((n, m), np.int64)
        for j, w in enumerate(known):
            windows[:, j] = np.maximum(1, texts.sizes - len(w.low) + 1)
            if w.word in sharing:
                score[:, j], scored[:, j] = texts.scores(w, sharing[w.word], threshold)
                continue
            for k, low in enumerate(lows):
                a, b = int(texts.starts[k]), int(texts.ends[k])
                score[k, j], _, scored[k, j] = w.match(low, texts.codes[a:b], texts.pairs[a : b - 1], threshold)
        words = pa.array([w.word for w in known], pa.string()).take(pa.array(np.tile(np.arange(m), n)))
        rows = keys.take(pa.array(np.repeat(np.arange(n), m)))
        return pa.RecordBatch.from_arrays([rows, words, *(pa.array(x.ravel()) for x in (score, windows, scored))], names=[key, "keyword", "score", "windows", "scored"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if known else ():
            at, lows, size = [], [], 0
            for k, t in enumerate(batch.column(1)):
                low = (t.as_py() or "").lower()
                if low:
                    at.append(k)
                    lows.append(low)
                    size += len(low) + 1
                if lows and (size >= BLOCK or k == batch.num_rows - 1):
                    yield solved(batch.column(0).take(pa.array(at, pa.int64())), lows)
                    at, lows, size = [], [], 0

    slim = spread(df.select(key, F.col(text).alias("__t")))
    return slim.mapInArrow(run, f"`{key}` {kind}, keyword string, score double, windows long, scored long")


def fuzzy_scores(df: DataFrame, key: str, text: str, keywords: list[str], threshold: float) -> DataFrame:
    """(key, score, keyword, windows, scored): each text's best keyword, the first in the alphabet of equals, with how many
    windows there were for all keywords and how many were scored; no keyword and 0 where none reaches ``threshold``."""
    found = fuzzy_matches(df, key, text, keywords, threshold).groupBy(key).agg(
        F.max("score").alias("score"), F.min_by("keyword", F.struct(-F.col("score"), "keyword")).alias("keyword"), F.sum("windows").alias("windows"), F.sum("scored").alias("scored")
    )
    return found.select(key, "score", F.when(F.col("score") > 0, F.col("keyword")).alias("keyword"), "windows", "scored")
