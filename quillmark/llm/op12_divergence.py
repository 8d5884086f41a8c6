"""How far the sources of a language are from each other in their words: an audit by shards that DuckDB aggregates.

Every task counts the terms of its documents in DuckDB, so that what is shuffled are counts. These go to
shards by a hash of language and term, and SQL over a shard adds the counts up and keeps the terms of enough documents.
With the totals of groups and languages, which Spark adds up, the shards are visited again: SQL gives every shard's
part of the sum of each pair of sources and its best terms of each group. Spark merges sums and rankings.

Counts are sparse. A term that neither of two sources has adds the same to their sum as any other such term; one
that only one has adds an amount that depends on its count alone. So a shard pairs the sources that share a term,
and what the rest adds comes from how many terms of a source have which count. All arithmetic is in integers.

Defined results: null texts, languages and sources are empty strings; a text without terms counts for nothing but makes
its source appear; repeated rows are documents of their own, whatever their ids; equal values are ranked by the item's bytes;
a language without kept terms has sums of 0; a language with a single source has no pairs; a very long text is
read whole, as one batch; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import cut, give_back, partitions, sized_batches

LEAST_DOCS = 3
TOP = 200
#: Bytes of text that become terms at a time, and rows of counts that a task gathers before it gives them on.
BATCH_BYTES, GATHERED = 4 << 20, 400_000
#: What DuckDB may hold in a task; beyond that it spills.
MEMORY = "300MB"

_UNIT = 1_000_000_000
#: a-z for letters in either case, bytes beyond ASCII as they are, 0 for what ends a term.
_TERM = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)


@contextmanager
def database() -> Iterator[duckdb.DuckDBPyConnection]:
    """A DuckDB of a task's own, with a folder to spill to that goes with it."""
    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
        yield con
    give_back()


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(the text that each term is of; the terms, in order): letters and what is beyond ASCII, A-Z lower-cased."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = _TERM[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = (ends - ends[0])[:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]  # a term doesn't go on in the next text
    starts = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return np.searchsorted(ends[1:] - ends[0], starts, "right").astype(np.int32), terms


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with database() as con:
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, c BIGINT, docs BIGINT)")

        def gathered() -> Iterator[pa.RecordBatch]:
            found = con.execute("SELECT lang, source, term, sum(c)::BIGINT AS c, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL").to_arrow_table().cast(_COUNTS)
            con.execute("TRUNCATE counts")
            yield from found.to_batches(max_chunksize=100_000)

        rows = 0
        for batch in sized_batches(batches, "text", BATCH_BYTES):
            at, terms = terms_of(batch.column("text"))
            con.register("words", pa.table({"doc": pa.array(at), "term": terms}))
            con.register("docs", pa.table({"doc": pa.array(np.arange(batch.num_rows, dtype=np.int32)), "lang": batch.column("lang"), "source": batch.column("source")}))
            rows += con.execute(
                """INSERT INTO counts SELECT lang, source, term, sum(c), count(*)
                   FROM (SELECT doc, term, count(*) AS c FROM words GROUP BY doc, term) JOIN docs USING (doc) GROUP BY lang, source, term"""
            ).fetchone()[0]
            con.unregister("words")
            con.unregister("docs")
            if rows >= GATHERED:
                yield from gathered()
                rows = 0
        yield from gathered()


def _in_shards(rows: DataFrame, sql: str, schema: pa.Schema, ddl: str) -> DataFrame:
    """``sql`` over each shard of ``rows`` by lang and term, which it knows as the table ``shard``."""
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    have = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with database() as con:
            con.register("arriving", pa.RecordBatchReader.from_batches(have, (b.cast(have) for b in batches)))
            con.execute("CREATE TABLE shard AS SELECT * FROM arriving")
            con.unregister("arriving")
            for batch in con.execute(sql).to_arrow_reader(100_000):
                yield batch.cast(schema)

    return rows.repartition(partitions(rows.sparkSession), "lang", "term").mapInArrow(run, ddl)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, c, head): how often each source has each kept term of its language; head is 1 in one row of
    every (lang, term)."""
    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    parts = named.mapInArrow(_count, "lang string, source string, term string, c long, docs long")
    sql = f"""WITH added AS (SELECT lang, source, term, sum(c)::BIGINT AS c, sum(docs)::BIGINT AS docs FROM shard GROUP BY ALL)
              SELECT lang, source, term, c, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS head FROM added
              QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {int(least_docs)}"""
    kept = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("head", pa.int64())])
    return _in_shards(parts, sql, kept, "lang string, source string, term string, c long, head long")


def share(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (c + 1) / (n + v)) as a long, without overflow."""
    return F.call_function("div", F.lit(_UNIT).cast("decimal(10,0)") * (c + 1).cast("decimal(20,0)"), n + v) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


_PARTS = f"""
WITH held AS (
  SELECT *, sum(c) OVER (PARTITION BY lang, term) AS lang_c FROM shard
), shares AS (
  SELECT lang, source, term, 1 + ({_UNIT}::HUGEINT * (c + 1)) // (n + v) AS p, 1 + {_UNIT} // (n + v) AS p0,
         1 + ({_UNIT}::HUGEINT * (lang_c + 1)) // (lang_n + v) AS q FROM held
), exact AS (
  SELECT lang, source, term, p::BIGINT AS p, p0::BIGINT AS p0, q::BIGINT AS q FROM shares
), pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         sum(((a.p - b.p) * (a.p - b.p)) // b.p - ((a.p - b.p0) * (a.p - b.p0)) // b.p0 - ((a.p0 - b.p) * (a.p0 - b.p)) // b.p + ((a.p0 - b.p0) * (a.p0 - b.p0)) // b.p0) AS value
  FROM exact a JOIN exact b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM exact WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {{top}}
)
SELECT lang, source, 'pair' AS part, item, value::DECIMAL(38, 0) AS value FROM pairs
UNION ALL SELECT lang, source, 'term', item, value::DECIMAL(38, 0) FROM terms
"""


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distances to the others of its language ('pair'), and the
    ``top`` terms by which it stands out from the language ('term')."""
    counts, _ = cut(term_counts(docs, least_docs, lang_col, source_col, text_col), "counts")
    groups = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.sum("head").alias("v"))
    by_lang = totals.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    none = F.lit(0).cast("long")
    known = groups.join(totals.drop("v"), ["lang", "source"], "left").join(by_lang, "lang", "left")
    known, _ = cut(known.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("n", "lang_n", "v"))), "groups")

    rows = counts.join(known, ["lang", "source"]).select("lang", "source", "term", "c", "n", "v", "lang_n")
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])
    parts, _ = cut(_in_shards(rows, _PARTS.format(top=int(top)), kind, "lang string, source string, part string, item string, value decimal(38,0)"), "parts")

    floor = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v")))  # the share of a term that a source doesn't have
    bases = known.select("lang", "source", "v", floor.alias("p0"))
    others = bases.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    p0, q0 = F.col("p0"), F.col("q0")
    apart = F.col("source") != F.col("item")
    all_pairs = bases.join(others, "lang").where(apart).select("lang", "source", "item", F.coalesce(F.col("v").cast("decimal(20,0)") * distance(p0, q0), F.lit(0)).cast("decimal(38,0)").alias("value"))
    # so many terms of a source have this count; against a source without them they add more than the floor, either way
    held = counts.groupBy("lang", "source", "c").agg(F.count(F.lit(1)).alias("m")).join(known, ["lang", "source"])
    held = held.select("lang", "source", "m", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), floor.alias("p0"))
    p, m = F.col("p"), F.col("m").cast("decimal(20,0)")
    there = F.struct("source", "item", (m * (distance(p, q0) - distance(p0, q0))).cast("decimal(38,0)").alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (m * (distance(q0, p) - distance(q0, p0))).cast("decimal(38,0)").alias("value"))
    one_sided = held.join(others, "lang").where(apart).select("lang", F.explode(F.array(there, back)).alias("x")).select("lang", "x.*")
    shared = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    sums = all_pairs.unionByName(one_sided).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    best = parts.where("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"))
    return ranked.unionByName(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))


def query(docs: DataFrame) -> DataFrame:
    return divergence(docs)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (
  SELECT k, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), found AS (
  SELECT lang, source, term, count(*) AS c FROM words GROUP BY lang, source, term
), counts AS (
  SELECT groups.lang, groups.source, kept.term, coalesce(c, 0) AS c FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v) AS p,
         1 + (1000000000::HUGEINT * (sum(c) OVER (PARTITION BY lang, term) + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q
  FROM counts JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM ranked
QUALIFY part = 'pair' OR rank <= 200
"""
