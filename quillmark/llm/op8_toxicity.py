"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed vectors for the word and for its first 4 and 6 bytes, so that
unseen compounds of a known stem still mean something. Filters of width 1, 2 and 3 slide over the whole
text, each is max-pooled, and a logistic layer turns the pooled values into a score. Language decides
only which threshold ``reject`` holds the score against, never the score.

The classifier is fitted on a bounded sample, ``SAMPLE`` labelled rows of each class and ``SAMPLE_BYTES`` of text, taken by hash. Class
weights restore the shares of all labelled rows, so that scores are probabilities.

Defined results: a null, blank or wordless text is scored like any other (all pooled values are those of
padding); rows with a null doc_id are scored and count as not held out; labels that are null or belong
to no document are ignored, and of contradicting labels of one id the toxic one counts; without usable
labels of both classes every score is the share of toxic labels, 0 if there are none; of several texts of one id the
one of least hash is learnt from; of a very long text all words are pooled; extra columns are kept by ``scored`` and ``reject``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, give_back, lean, plain, rebatched, renamed, word_list

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 4000
#: Bytes of their texts that are gathered on the driver, at most; rows come in the order of their ids' hashes.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.3
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
BUCKETS = 1 << 16
EPOCHS = 4
#: Gradient steps at least; a small sample is gone through more often.
STEPS = 200
BATCH = 32
RATE = 0.08
#: Words whose filter values a worker keeps at a time.
WORDS = 30_000
#: Words of a text that are convolved at a time; pieces overlap, so their size doesn't show.
PIECE = 1 << 15


def subword_ids(word: bytes) -> tuple[int, int, int]:
    crc = zlib.crc32
    return crc(word) % BUCKETS, crc(word[:4], 1) % BUCKETS, crc(word[:6], 2) % BUCKETS


@dataclass
class Model:
    """What scoring needs. ``rate`` is the score where no classifier could be fitted."""

    rate: float = 0.0
    embed: np.ndarray | None = None
    kernels: list[np.ndarray] = field(default_factory=list)  # for each width: (width, DIM, FILTERS)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias


class Scorer:
    """Scores texts. Each distinct word's part in every filter is worked out once."""

    def __init__(self, model: Model):
        self.model = model
        if model.embed is not None:
            # by offset: what the word that stands there adds to the filters that reach so far
            self.kernels = [np.concatenate([k[o] for k in model.kernels if len(k) > o], axis=1) for o in range(WIDTHS[-1])]
            self.bias = np.concatenate(model.biases)
            self._clear()

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.tables = [np.zeros((4096, k.shape[1]), np.float32) for k in self.kernels]  # row 0 is padding
        self.used = 1

    def _add(self, new: list[bytes]) -> None:
        end = self.used + len(new)
        vectors = self.model.embed[np.array(list(map(subword_ids, new)))].sum(axis=1)
        for k, kernel in enumerate(self.kernels):
            if end > len(self.tables[k]):
                more = np.zeros((max(2 * len(self.tables[k]), end), kernel.shape[1]), np.float32)
                more[: self.used] = self.tables[k][: self.used]
                self.tables[k] = more
            self.tables[k][self.used : end] = vectors @ kernel
        self.rows.update(zip(new, range(self.used, end)))
        self.used = end

    def _ids(self, words: list[bytes]) -> list[int]:
        try:
            return list(map(self.rows.__getitem__, words))
        except KeyError:
            new = list(set(words).difference(self.rows))
            if self.used + len(new) > WORDS:
                self._clear()
                new = list(set(words))
            self._add(new)
            return list(map(self.rows.__getitem__, words))

    def pooled(self, words: list[bytes]) -> np.ndarray:
        best, more = None, WIDTHS[-1] - 1
        for at in range(0, max(1, len(words)), PIECE):
            n = max(1, min(PIECE, len(words) - at))
            piece = words[at : at + n + more]
            ids = np.zeros(n + more, np.int64)
            ids[: len(piece)] = self._ids(piece)
            y = self.tables[0].take(ids[:n], axis=0)
            for o in range(1, WIDTHS[-1]):
                y[:, o * FILTERS :] += self.tables[o].take(ids[o : n + o], axis=0)
            here = y.max(axis=0)
            best = here if best is None else np.maximum(best, here)
        return np.maximum(best + self.bias, 0)

    def score(self, text: str | None) -> float:
        if self.model.embed is None:
            return self.model.rate
        return float(_sigmoid(self.model.logits(self.pooled(word_list(text)))))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str | None], labels: list[int], share: float, langs: list[str | None] | None = None, seed: int = 7) -> Model:
    """Fit a model; ``share`` is the toxic share that scores are to reflect. Every fifth text is kept
    out of the gradient steps and sets bias, scale and the thresholds by language."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(rate=share)
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = []
    for t in texts:
        docs.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in word_list(t)], np.int32))
    subs = np.zeros((len(vocabulary) + 1, 3), np.int32)
    subs[1:] = np.fromiter((k for w in vocabulary for k in subword_ids(w)), np.int32, 3 * len(vocabulary)).reshape(-1, 3)
    real = np.ones(len(subs), np.float32)
    real[0] = 0  # padding has no vector
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    gain = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)  # balanced while fitting

    most = WIDTHS[-1] - 1
    p = {"embed": rng.normal(0, 0.1, (BUCKETS, DIM)), "out": rng.normal(0, 0.1, len(WIDTHS) * FILTERS), "out_bias": np.zeros(1)}
    for w in WIDTHS:
        p[f"k{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in p.items()}

    def forward(i: int):
        words = np.concatenate([docs[i], np.zeros(2 * most, np.int32)])
        x = p["embed"][subs[words]].sum(axis=1) * real[words][:, None]
        n, pooled, where = max(1, len(docs[i])), [], []
        for w in WIDTHS:
            z = sum(x[o : n + o] @ p[f"k{w}"][o] for o in range(w))
            at = z.argmax(axis=0)
            pooled.append(z[at, np.arange(FILTERS)] + p[f"b{w}"])
            where.append(at)
        return words, x, np.concatenate(pooled), where

    held = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~held)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(fit)))):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            g = {k: np.zeros_like(v) for k, v in p.items() if k != "embed"}
            rows, grads = [], []
            part = fit[at : at + BATCH]
            for i in part:
                words, x, pooled, where = forward(i)
                active = pooled > 0
                h = np.where(active, pooled, 0)
                d = gain[i] * (_sigmoid(h @ p["out"] + p["out_bias"][0]) - y[i]) / len(part)
                g["out"] += d * h
                g["out_bias"] += d
                dh = d * p["out"] * active
                for k, w in enumerate(WIDTHS):
                    dz = dh[k * FILTERS : (k + 1) * FILTERS]
                    g[f"b{w}"] += dz
                    on = np.flatnonzero(dz)
                    for o in range(w):
                        spots = where[k][on] + o
                        g[f"k{w}"][o][:, on] += x[spots].T * dz[on]
                        back = (p[f"k{w}"][o][:, on] * dz[on]).T * real[words[spots]][:, None]
                        for s in range(3):
                            rows.append(subs[words[spots]][:, s])
                            grads.append(back)
            for k, v in g.items():
                seen[k] += v * v
                p[k] -= RATE * v / np.sqrt(seen[k])
            if rows:
                flat, back = np.concatenate(rows), np.concatenate(grads)
                unique, inverse = np.unique(flat, return_inverse=True)
                v = np.zeros((len(unique), DIM), np.float32)
                np.add.at(v, inverse, back)
                seen["embed"][unique] += v * v
                p["embed"][unique] -= RATE * v / np.sqrt(seen["embed"][unique])

    model = Model(share, p["embed"], [p[f"k{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["out"], float(p["out_bias"][0]))
    scorer = Scorer(model)
    raw = np.array([model.logits(scorer.pooled(word_list(texts[i]))) for i in np.flatnonzero(held)])
    _calibrate(model, raw, y[held], weight[held])
    if langs is not None:
        named = np.array([str(x) for x in langs], object)[held]
        model.thresholds = _thresholds(_sigmoid(raw * model.scale + model.shift), y[held], weight[held], named)
    model.out, model.out_bias = model.out * model.scale, model.out_bias * model.scale + model.shift
    return model


def _calibrate(model: Model, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Scale and shift that fit the logits to the labels by weighted Newton steps (Platt's method)."""
    scale, shift = 1.0, 0.0
    target = y * 0.998 + 0.001
    for _ in range(50):
        q = _sigmoid(raw * scale + shift)
        r, c = weight * (q - target), weight * q * (1 - q)
        grad = np.array([(r * raw).sum() + 0.01 * (scale - 1), r.sum()])
        hess = np.array([[(c * raw * raw).sum() + 0.01, (c * raw).sum()], [(c * raw).sum(), c.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        scale, shift = max(0.05, scale - step[0]), shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.scale, model.shift = float(scale), float(shift)


def _thresholds(score: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: np.ndarray, least: int = 20) -> dict[str, float]:
    """For each language with ``least`` texts of either class, the threshold of least weighted error,
    the nearest to the common one among equals."""
    found = {}
    grid = sorted(np.round(np.arange(0.05, 0.96, 0.05), 2), key=lambda t: abs(t - THRESHOLD))
    for lang in np.unique(langs):
        of = langs == lang
        if min((y[of] == 1).sum(), (y[of] == 0).sum()) >= least:
            errors = [(weight[of] * ((score[of] >= t) != (y[of] == 1))).sum() for t in grid]
            found[str(lang)] = float(grid[int(np.argmin(errors))])
    return found


def _fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, by_language: bool = True, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on at most ``sample`` labelled documents of each class outside the held-out fold."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(_fold("doc_id") != 2)
    )
    order = F.xxhash64(F.lit(11), "doc_id")
    picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample).collect() for k in (0, 1)]
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    rows = [(r.doc_id, int(r.toxic)) for part in picked for r in part]
    if not rows:
        return Model(rate=share)
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame(rows, "doc_id long, __y int"))  # 2 * sample rows at most
    text, lang = F.col("text").cast("string"), (F.col("lang") if by_language else F.lit(None)).cast("string")
    each = docs.select(F.col("doc_id").cast("long"), F.struct(F.xxhash64(text), text.alias("text"), lang.alias("lang")).alias("x")).join(ids, "doc_id")
    texts, _ = cut(each.groupBy("doc_id", "__y").agg(F.min("x").alias("x")).select("doc_id", "x.text", "x.lang", "__y"), "sample")
    sizes = texts.select("doc_id", "__y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()
    wanted, left = [], sample_bytes
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r.doc_id).encode(), 5), r.doc_id)):
        if r.size <= left:
            wanted.append(r.doc_id)
            left -= r.size
    few = F.broadcast(spark.createDataFrame([(i,) for i in wanted], "doc_id long"))
    found = sorted(map(tuple, texts.join(few, "doc_id").collect()), key=lambda r: (zlib.crc32(str(r[0]).encode(), 5), r[0]))
    model = train([r[1] for r in found], [r[-1] for r in found], share, [r[2] for r in found] if by_language else None)
    del found
    give_back()  # the driver has other things to do
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and, in the last column, whatever the others are called,
    the score."""
    names = docs.columns if keep is None else keep
    rows, short = plain(docs)
    return _scored(rows, model, short[text_col], [short[c] for c in names]).toDF(*names, "score")


def _scored(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and score; the text goes to Python once, whether it is kept or not."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    also = text in keep and dict(docs.dtypes)[text] == "string"
    slim = docs.select(*keep) if also else docs.select(*keep, F.col(text).cast("string").alias("text"))
    read = text if also else "text"
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in rebatched(batches, 512):
            scores = pa.array([scorer.score(t.as_py()) for t in batch.column(read)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], names=[*keep, "score"])

    return slim.mapInArrow(lean(score), schema)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those whose score reaches their language's threshold."""
    rows, short = plain(docs)
    limit = F.lit(THRESHOLD)
    if model.thresholds:
        table = F.create_map(*(F.lit(x) for kv in model.thresholds.items() for x in kv))
        limit = F.coalesce(table[F.col(short["lang"])], limit)
    return renamed(_scored(rows, model, short["text"], rows.columns).where(F.col("score") < limit), docs)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, fit(docs, labels), keep=["doc_id"])
    return found.select(
        "doc_id",
        (_fold("doc_id") == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
