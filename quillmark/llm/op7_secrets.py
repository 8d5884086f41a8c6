"""Secret scan: three fixed patterns, and character Markov models for what they miss.

Two first-order models, of random strings and of ordinary identifiers, are trained from labelled
samples; a token whose log-likelihood ratio exceeds a threshold is a secret. Random samples are drawn from
the alphabets that keys use; ordinary ones are words, paths and identifiers joined from words of at most
``SAMPLE_DOCS`` documents and ``SAMPLE_BYTES`` of text, taken by hash. The threshold is the one that ``FALSE_SHARE`` of the ordinary
samples exceed, and at least ``FLOOR``. Judged are all runs of ``LEAST`` or more characters that keys are made of;
shorter ones are too little evidence for either model, and are found by the patterns only.

Defined results: a null or empty text has no spans; positions count code points, ends are exclusive;
repeated rows and null ids are kept; a very long text is searched whole, by one row; an empty table gives an empty table; extra columns are kept by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import lean, plain, rebatched

# The patterns of the base kinds, with the least length of each.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more among the maximal runs
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "markov")

LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SAMPLE_DOCS = 1000
#: Bytes of their texts, at most; what doesn't fit in what is left is passed over.
SAMPLE_BYTES = 16 << 20
#: Words that ordinary identifiers are made of.
WORD = re.compile(r"(?<!\S)[A-Za-z]{2,15}(?!\w)")
SAMPLES = 6000
FALSE_SHARE = 1e-3
FLOOR = 12.0
_INDEX = np.zeros(128, np.int64)
for _k, _c in enumerate(CLASSES):
    _INDEX[ord(_c)] = _k + 1


@dataclass
class Markov:
    """ratio[a, b]: how much likelier b after a is in random strings, as a log; row 0 stands for the start."""

    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        ids = _INDEX[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratio[0, ids[0]] + self.ratio[ids[:-1], ids[1:]].sum())


def _log_transitions(tokens: list[str]) -> np.ndarray:
    n = len(CLASSES) + 1
    counts = np.full((n, n), 0.5)
    for t in tokens:
        ids = np.r_[0, _INDEX[np.frombuffer(t.encode("ascii"), np.uint8)]]
        np.add.at(counts, (ids[:-1], ids[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def labelled_samples(words: list[str], n: int = SAMPLES, seed: int = 3) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), ``n`` of each."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = CLASSES[:26], CLASSES[26:52], CLASSES[52:62]
    alphabets = [digits + "abcdef", digits + "ABCDEF", lower + upper + digits, upper + digits, lower + digits, lower + upper + digits + "+/", lower + upper + digits + "-_"]
    random = ["".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(16, 49))) for i in range(n)]
    words = [w for w in words if re.fullmatch(r"[A-Za-z]+", w)] or ["value", "name", "count", "index", "table", "result"]
    joins = [("_", str.lower), ("-", str.lower), ("", str.title), ("", str.lower), ("/", str.lower), ("_", str.upper), ("", str)]
    ordinary = []
    while len(ordinary) < n:
        join, case = joins[len(ordinary) % len(joins)]
        parts = [case(words[k]) for k in rng.integers(0, len(words), rng.integers(2, 6))]
        if rng.random() < 0.3:
            parts.append(str(rng.integers(0, 100_000)))
        text = join.join(parts)
        while len(text) < 16:
            text += join + case(words[rng.integers(0, len(words))])
        ordinary.append(text)
    return random, ordinary


def train(words: list[str]) -> Markov:
    random, ordinary = labelled_samples(words)
    cut = len(random) * 4 // 5
    model = Markov(_log_transitions(random[:cut]) - _log_transitions(ordinary[:cut]), 0.0)
    held = [model.score(t) for t in ordinary[cut:]]
    model.threshold = max(FLOOR, float(np.quantile(held, 1 - FALSE_SHARE)))
    return model


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS) -> Markov:
    """Train on the distinct words of at most ``sample`` documents and ``SAMPLE_BYTES`` of text. Tasks take the texts apart;
    the driver gets their distinct words."""
    keyed = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("k"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    # first the least hashes of distinct texts, which are small, then those texts alone
    last = keyed.select("k").distinct().orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    if last is None:
        return train([])
    sizes = keyed.where(F.col("k") <= last).groupBy("k").agg(F.max(F.octet_length("t")).alias("size")).orderBy("k").limit(sample).collect()
    wanted, left = [], SAMPLE_BYTES
    for k, size in sizes:
        if size <= left:
            wanted.append((k,))
            left -= size
    few = F.broadcast(docs.sparkSession.createDataFrame(wanted, "k long"))  # at most ``sample`` rows
    schema = pa.schema([("w", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        for batch in rebatched(batches, 256):
            for t in batch.column("t"):
                words.update(WORD.findall(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], schema=schema)

    return train(sorted(r.w for r in keyed.join(few, "k").select("t").mapInArrow(lean(run), "w string").distinct().collect()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every match of the fixed patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Markov) -> list[tuple[int, int, int]]:
    """Tokens that read as random and that no base span covers."""
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if model.score(m.group()) > model.threshold and not any(a <= start and end <= b for a, _, b in base):
            found.append((start, 3, end))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, model: Markov, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), and in the last column, whatever the others are
    called, found: array<struct<kind, start, stop, base>>."""
    names = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows, short = plain(docs)
    slim = rows.select(*(short[c] for c in names), F.col(short[text_col]).cast("string").alias("text"))
    kind = "array<struct<kind:string,start:long,stop:long,base:boolean>>"
    schema = slim.drop("text").withColumn("found", F.lit(None).cast(kind)).schema
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markov = held.value
        for batch in rebatched(batches, 1024):
            out = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + added_spans(text, base, markov))
                out.append([{"kind": KINDS[k], "start": a, "stop": b, "base": k < 3} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, arrow)], names=[*batch.schema.names[:-1], "found"])

    return slim.mapInArrow(lean(run), schema).toDF(*names, "found")


def query(docs: DataFrame) -> DataFrame:
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")
    return scan(docs, fit(docs), keep=["doc_id"]).select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(text(F.filter("found", lambda s: s.base)), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
