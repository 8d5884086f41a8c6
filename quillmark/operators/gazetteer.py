"""Names of a table found in texts by one automaton: a trie of all names with links from each failed match to the longest
one that may still go on.

A text is read once, however many names there are. Names count on word boundaries, in any case and with any blanks between
their words. The automaton is built from the table once, by the driver, as long as names are reference data of a checked
size; it goes to the workers as a broadcast value and each unpacks it once. Names may be
dealt to several automata, which the texts pass in turn within one task, so the plan doesn't grow with the table.

Longer tables stay distributed: texts give the runs of as many words as names have, those that a filter of a fixed size lets
through, and these are joined to the names. Neither the driver nor a task then holds the names.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.shared import cut

#: Characters of the names of one automaton, and of all names that go to automata: longer tables are joined.
PART, MOST = 4_000_000, 1_000_000
#: Bits of the filter of a joined table's names, in pages, and rows that a task hands on at once.
FILTER, PAGE, ROWS = 1 << 26, 1 << 15, 100_000

_WORD = re.compile(r"[^\W_]+")
_UNPACKED: dict[str, list] = {}


def phrase(name: str) -> str:
    """Lower-cased words with one blank around each."""
    return " ".join(["", *(w.lower() for w in _WORD.findall(name)), ""]) if _WORD.search(name) else ""


def automata(names: list[tuple[str, str, int]]) -> list[bytes]:
    """Packed automata of (name, label, rank); what names that are spelt alike stand for goes with one entry."""
    known: dict[str, set[tuple[int, str, str]]] = {}
    for name, label, rank in names:
        if p := phrase(name):
            known.setdefault(p, set()).add((rank, label, name))
    packed, now, size = [], ahocorasick.Automaton(), 0
    for p, meanings in sorted(known.items()):
        now.add_word(p, (len(p), sorted(meanings)))
        size += len(p)
        if size >= PART:
            now.make_automaton()
            packed.append(pickle.dumps(now))
            now, size = ahocorasick.Automaton(), 0
    if size:
        now.make_automaton()
        packed.append(pickle.dumps(now))
    return packed


def occurrences(text: str, machines: list) -> Iterator[tuple[int, int, int, str, str]]:
    """(begin, end, rank, label, name) of all names in the text, overlapping ones too; places are characters of ``text``."""
    words = list(_WORD.finditer(text))
    low = [m[0].lower() for m in words]
    flat, ends = f" {' '.join(low)} ", None
    for machine in machines:
        for last, (size, meanings) in machine.iter(flat):
            ends = ends or list(accumulate((len(w) + 1 for w in low), initial=0))  # of words in ``flat``, with the blank before each
            begin, end = words[bisect_left(ends, last - size + 1)].start(), words[bisect_left(ends, last) - 1].end()
            yield from ((begin, end, *meaning) for meaning in meanings)


def longest(found: Iterator[tuple]) -> list[tuple]:
    """Of overlapping occurrences the one that begins first, of those the longest, of those the one of least rank; then on
    behind it."""
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1], x[2:])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


_OUT = "begin int, end int, rank int, label string, name string, before string"


def _known(names: DataFrame) -> DataFrame:
    """(p, n, bit, rank, label, name): the names by their phrase, its number of words and its place in the filter."""
    schema = pa.schema([("p", pa.string()), ("n", pa.int32()), ("bit", pa.int32()), ("rank", pa.int32()), ("label", pa.string()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = [phrase(x).strip(" ") for x in batch.column("name").to_pylist()]
            bits = [_bit(p) for p in phrases]
            columns = [pa.array(phrases), pa.array([p.count(" ") + 1 for p in phrases], pa.int32()), pa.array(bits, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in ("rank", "label", "name"))], schema=schema).filter(pa.array([bool(p) for p in phrases]))

    return names.mapInArrow(run, "p string, n int, bit int, rank int, label string, name string").distinct()


def _bit(p: str) -> int:
    return zlib.crc32(p.encode("utf-8", "surrogatepass")) % FILTER


def _filter(known: DataFrame) -> bytes:
    """The filter's bits: 8 MB at most, whatever the number of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for at in batch.column("at").to_pylist():
                bits = np.zeros(PAGE, bool)
                bits[at] = True
                packed.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(packed, pa.binary())], names=["page", "bits"])

    pages = known.select(F.floor(F.col("bit") / PAGE).cast("int").alias("page"), (F.col("bit") % PAGE).alias("at")).groupBy("page").agg(F.collect_set("at").alias("at"))  # of a page's own
    out = bytearray(FILTER // 8)
    for r in pages.mapInArrow(run, "page int, bits binary").collect():  # a filter of a fixed size
        out[r.page * PAGE // 8 : (r.page + 1) * PAGE // 8] = r.bits
    return bytes(out)


def _before(t: str, begin: int) -> str:
    return t[max(0, begin - 9) : begin].rstrip()[-1:]


def _joined(texts: DataFrame, key: str, kind: str, names: DataFrame, every: bool) -> DataFrame:
    """``matches`` with names that stay distributed. ``texts`` have the key and __t."""
    spark = texts.sparkSession
    known, _ = cut(_known(names), "names")
    sizes = [r.n for r in known.select("n").distinct().orderBy("n").collect()]  # numbers of words
    bits = spark.sparkContext.broadcast(_filter(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            at, out = [], [[] for _ in range(4)]
            for k, t in enumerate(batch.column(2)):
                t = t.as_py()
                words = list(_WORD.finditer(t)) if t else []
                low = [m[0].lower() for m in words]
                for n in sizes:
                    for i in range(len(low) - n + 1):
                        p = " ".join(low[i : i + n])
                        b = _bit(p)
                        if held[b >> 3] >> (b & 7) & 1:
                            begin = words[i].start()
                            at.append(k)
                            for column, v in zip(out, (p, begin, words[i + n - 1].end(), _before(t, begin))):
                                column.append(v)
                if at and (len(at) >= ROWS or k == batch.num_rows - 1):
                    rows = pa.array(at, pa.int64())
                    arrays = [pa.array(v, x) for v, x in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *arrays], names=["rid", key, "p", "begin", "end", "before"])
                    at, out = [], [[] for _ in range(4)]

    rows = texts.select(F.monotonically_increasing_id().alias("rid"), key, "__t")
    runs, _ = cut(rows.mapInArrow(run, f"rid long, `{key}` {kind}, p string, begin int, end int, before string"), "runs")
    found = runs.join(known.drop("n", "bit"), "p").select("rid", key, "begin", "end", "rank", "label", "name", "before")
    if every:
        return found.drop("rid")
    x = ["begin", "end", "rank", "label", "name", "before"]
    told = found.groupBy("rid").agg(F.first(key).alias(key), F.collect_list(F.struct(*x)).alias("x"))  # of a text's own
    schema = pa.schema([("begin", pa.int32()), ("end", pa.int32()), ("rank", pa.int32()), *((c, pa.string()) for c in x[3:])])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, some in enumerate(batch.column("x").to_pylist()):
                best = longest(tuple(y[c] for c in x) for y in some)
                at += [k] * len(best)
                out += best
            columns = [pa.array([y[j] for y in out], f.type) for j, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *columns], names=[key, *x])

    return told.select(key, "x").mapInArrow(pick, f"`{key}` {kind}, {_OUT}")


def matches(df: DataFrame, key: str, text: str, names: DataFrame, every: bool = False) -> DataFrame:
    """(key, begin, end, rank, label, name, before): where names (name, label and, if there, rank) occur in each text, on
    word boundaries, and the last character before that isn't blank. By default the leftmost longest ones, which don't overlap; with ``every`` all of them. Null and empty
    texts and names match nothing."""
    spark = df.sparkSession
    rank = F.col("rank") if "rank" in names.columns else F.lit(0)
    slim = names.where("name is not null").select("name", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"), rank.cast("int").alias("rank"))
    slim, _ = cut(slim, "names")
    kind, own = df.schema[key].dataType.simpleString(), uuid.uuid4().hex
    if slim.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0] > MOST:
        return _joined(df.select(key, F.col(text).alias("__t")), key, kind, slim, every)
    sent = spark.sparkContext.broadcast(automata([tuple(r) for r in slim.collect()]))  # checked above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own not in _UNPACKED:
            _UNPACKED.clear()  # those of earlier jobs
            _UNPACKED[own] = [pickle.loads(x) for x in sent.value]
        machines = _UNPACKED[own]
        for batch in batches:
            at, out = [], [[] for _ in range(6)]
            for k, t in enumerate(batch.column(1)):
                t = t.as_py()
                if not t:
                    continue
                found = occurrences(t, machines)
                for x in sorted(found) if every else longest(found):
                    at.append(k)
                    for column, v in zip(out, (*x, _before(t, x[0]))):
                        column.append(v)
            arrays = [pa.array(v, p) for v, p in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=[key, "begin", "end", "rank", "label", "name", "before"])

    return df.select(key, F.col(text).alias("__t")).mapInArrow(run, f"`{key}` {kind}, {_OUT}")


# Ranks of what tells a country: a state behind a comma, a city, another name of it.
STATE, CITY, ALIAS = range(3)


def country_names(spark, states: list[str], cities: list[str], aliases: dict[str, str], home: str = "United States") -> DataFrame:
    """The table of names by which ``countries`` goes."""
    rows = [*((s, home, STATE) for s in states), *((c, home, CITY) for c in cities), *((a, x, ALIAS) for a, x in aliases.items())]
    return spark.createDataFrame(rows, "name string, label string, rank int")


def countries(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, country): the country that each text names: by a state behind a comma, else by a city, else by the
    longest other name (the first of equals). Names count on word boundaries, so that "in" isn't found in
    "Berlin"; texts that name none are left out."""
    found = matches(df, key, text, names, every=True)
    best = F.struct("rank", (-F.length("name")).alias("size"), "begin")
    return found.where((F.col("rank") != STATE) | (F.col("before") == ",")).groupBy(key).agg(F.min_by("label", best).alias("country"))
