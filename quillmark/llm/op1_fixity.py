"""Merkle fixity audit of WARC replicas.

Records are laid out in the order of their identifiers, which gives each an offset; a leaf is an ordered
range of offsets, its digest that of its records' digests and of where each stands in the range. Every level joins 16
nodes in one until a root remains. The catalogue says with which identifier each range begins. A replica has a tree of
its own: its records stand where its own index says, or in the order of its identifiers, are dealt to ranges by
those beginnings, and are hashed by their places there, so that a record that is missing, longer or out of place
changes its own range only. Trees are compared from their roots down; only what lies below a mismatching node is looked
at again, and only records of mismatching ranges are compared.

Defined results: a null payload is a record of its own kind, different from an empty one; null identifiers
come first; records of one identifier are told apart by their digests, and equal ones counted; a record that the replica
lacks is ``damaged`` if it has another one of that identifier instead, else ``missing``; one that the catalogue lacks is
``extra``; one that stands before or behind others than in the catalogue is ``moved``; empty copies have an empty tree
and nothing to report; a record longer than a range is a range of its own; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import cut, partitions, placed

#: Bytes of the ranges that the leaves stand for.
RANGE_BYTES = 1 << 20
FANOUT = 16
_HEADER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", offset_col: str | None = None) -> DataFrame:
    """(id, digest, size, c, place) of the distinct records, c of each: header and payload as they would stand in the
    file, and, where ``offset_col`` tells, the least offset at which one does."""
    body = F.col(f"`{body_col}`").cast("string")
    record = F.concat(
        F.lit(_HEADER), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "),
        F.coalesce(F.octet_length(body).cast("string"), F.lit("-")), F.lit("\r\n\r\n"), F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"),
    )
    place = F.col(f"`{offset_col}`").cast("long") if offset_col else F.lit(None).cast("long")
    slim = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("size"), place.alias("place"))
    return slim.groupBy("id", "digest", "size").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("place"))


def _dealt(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` in ranges of ``order``, with the number of their range as part, written once."""
    rows, _ = cut(rows, name)  # dealing by range reads it twice
    return cut(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()), name)[0]


def _told(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a row for each range


def laid_out(found: DataFrame) -> DataFrame:
    """``found`` with the offset of each record's first copy, in identifier order. Sizes are summed within sorted
    partitions; only a total for each partition passes through the driver."""
    order = [F.col("id").asc_nulls_first(), "digest"]
    dealt = _dealt(found, order, "records")
    bases, at = [], 0
    for part, size in sorted(map(tuple, dealt.groupBy("part").agg(F.sum(F.col("size") * F.col("c"))).collect())):
        bases.append((part, at))
        at += size
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed(dealt).withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("c")).over(before), F.lit(0)))
    return sums.join(_told(found.sparkSession, bases, "part int, base long"), "part").select(*found.columns, (F.col("base") + F.col("before")).alias("offset"))


def beginnings(ours: DataFrame) -> DataFrame:
    """(id, digest, range) with which each range of the catalogue begins; an empty digest stands before all of its id."""
    first = ours.groupBy("range").agg(F.min(F.struct("offset", "id", "digest")).alias("f")).select("range", "f.id", "f.digest", "f.offset")
    ids = ours.groupBy("id").agg(F.min("offset").alias("least"))
    own = first.join(ids.withColumnRenamed("id", "i"), F.col("id").eqNullSafe(F.col("i")))
    return own.select("id", F.when(F.col("offset") == F.col("least"), "").otherwise(F.col("digest")).alias("digest"), "range")


def ranged(theirs: DataFrame, begin: DataFrame) -> DataFrame:
    """The replica's records with the range to which their identifier belongs: that which began last before it."""
    both = theirs.select("id", "digest", "size", "c", "place", F.lit(None).cast("long").alias("range")).unionByName(
        begin.select("id", "digest", F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("c"), F.lit(None).cast("long").alias("place"), "range")
    )
    order = [F.col("id").asc_nulls_first(), "digest", F.col("c") > 0]
    dealt = _dealt(both, order, "ranged")
    carried, last = [], None
    for r in sorted(dealt.groupBy("part").agg(F.max("range").alias("top")).collect(), key=lambda r: r.part):
        carried.append((r.part, last))
        last = r.top if r.top is not None else last
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = placed(dealt).withColumn("here", F.max("range").over(so_far)).join(_told(theirs.sparkSession, carried, "part int, carried long"), "part")
    return told.where("c > 0").select("id", "digest", "size", "c", "place", F.coalesce("here", "carried", F.lit(0)).alias("range"))


def overhang(theirs: DataFrame, ours: DataFrame, range_bytes: int) -> DataFrame:
    """``theirs``, laid out, with ranges of bounded bytes: what a range of the replica has beyond ``range_bytes`` goes to
    further ranges, by the replica's own offsets, behind all of the catalogue's. A replica that is longer than its
    catalogue, or has records behind its end, thus has more leaves and no longer ones; as the catalogue lacks these
    leaves, all their records are compared."""
    starts = theirs.groupBy("range").agg(F.min("offset").alias("start"))
    last = ours.agg(F.coalesce(F.max("range"), F.lit(-1)).alias("last"))  # one row
    told = theirs.join(starts, "range").crossJoin(F.broadcast(last))
    beyond = F.col("offset") - F.col("start") >= range_bytes
    return told.withColumn("range", F.when(beyond, F.col("last") + 1 + F.floor(F.col("offset") / range_bytes)).otherwise(F.col("range")).cast("long")).drop("start", "last")


def _joined(order: Column, digest: Column) -> Column:
    """The digest over a node's children in order; a node has few, by size of range or by fan-out."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), digest.alias("d")))), lambda x: x.d), ""), 256)


def leaves(found: DataFrame) -> DataFrame:
    """(node, digest) of the ranges of ``found`` (range, offset and records): what stands there, and where from the
    range's first record on."""
    start = found.groupBy("range").agg(F.min("offset").alias("start"))
    what = F.concat_ws(":", (F.col("offset") - F.col("start")).cast("string"), "digest", F.col("c").cast("string"))
    return found.join(start, "range").groupBy(F.col("range").alias("node")).agg(_joined(F.struct("offset", "id", "digest"), what).alias("digest"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """The levels of the tree from the leaves up to a single root."""
    levels = [cut(leaf, "level")[0]]
    while levels[-1].count() > 1:
        up = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(_joined(F.col("node"), F.col("digest")).alias("digest"))
        levels.append(cut(up.withColumnRenamed("up", "node"), "level")[0])
    return levels


def mismatching(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """The leaves that differ, found by descending from the roots through differing nodes only."""
    wanted, height = None, max(len(ours), len(theirs))
    for k in reversed(range(height)):
        a, b = (levels[k] if k < len(levels) else levels[0].limit(0) for levels in (ours, theirs))
        if wanted is not None:
            below = F.floor(F.col("node") / FANOUT).cast("long") == F.col("up")
            a, b = (x.join(wanted.withColumnRenamed("node", "up"), below, "left_semi") for x in (a, b))
        both = a.select("node", F.col("digest").alias("x")).join(b.select("node", F.col("digest").alias("y")), "node", "full")
        wanted, _ = cut(both.where("not x <=> y").select("node"), "differing")
        if wanted.isEmpty():
            break  # nothing below can differ
    return wanted


def audit(catalogue: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records of the catalogue laid out with their ranges, findings).

    Both take what ``records`` returns. A finding has id, digest, range, offset (where that copy has it), size, n (how
    many equal records it is about) and status (``damaged``, ``missing``, ``moved`` or ``extra``).
    """
    ours, _ = cut(laid_out(catalogue.drop("place")).withColumn("range", F.floor(F.col("offset") / range_bytes).cast("long")), "catalogue")
    placed = ranged(replica, beginnings(ours))
    own, _ = cut(placed, "placed")
    theirs, _ = cut(overhang(laid_out(own), ours, range_bytes).select("id", "digest", "size", "c", "range", F.coalesce("place", "offset").alias("offset")), "replica")
    bad = mismatching(tree(leaves(ours)), tree(leaves(theirs))).withColumnRenamed("node", "range")
    x, _ = cut(ours.join(bad, "range", "left_semi").select("id", "digest", "size", "c", "range", "offset"), "x")
    y, _ = cut(theirs.join(bad, "range", "left_semi").select("id", "digest", "size", "c", "range", "offset"), "y")
    right = y.select(*(F.col(c).alias(f"y_{c}") for c in y.columns))
    met, _ = cut(x.join(right, F.col("id").eqNullSafe(F.col("y_id")) & (F.col("digest") == F.col("y_digest")), "full"), "met")
    here, there = F.coalesce("c", F.lit(0)), F.coalesce("y_c", F.lit(0))
    lost = met.where(here > there).select("id", "digest", "range", "offset", "size", (here - there).alias("n"))
    new = met.where(there > here).select(F.coalesce("y_id", "id").alias("id"), F.coalesce("y_digest", "digest").alias("digest"), F.col("y_range").alias("range"), F.col("y_offset").alias("offset"), F.col("y_size").alias("size"), (there - here).alias("n"))
    ids = lambda df, c: df.select(F.col("id").alias(c)).distinct()
    there_too = ids(new, "i").withColumn("too", F.lit(True))
    here_too = ids(lost, "i").withColumn("too", F.lit(True))
    gone = lost.join(there_too, F.col("id").eqNullSafe(F.col("i")), "left").withColumn("status", F.when(F.col("too"), "damaged").otherwise("missing"))
    extra = new.join(here_too, F.col("id").eqNullSafe(F.col("i")), "left").where("too is null").withColumn("status", F.lit("extra"))
    kept = met.where(F.col("c").isNotNull() & F.col("y_c").isNotNull())
    rank = lambda o: F.row_number().over(Window.partitionBy("range").orderBy(o, "id", "digest"))  # noqa: E731  within a range of bounded bytes
    moved = kept.select("id", "digest", "range", "offset", "size", F.least("c", "y_c").alias("n"), rank("offset").alias("mine"), rank("y_offset").alias("its")).where("mine <> its").withColumn("status", F.lit("moved"))
    names = ["id", "digest", "range", "offset", "size", "n", "status"]
    found, _ = cut(gone.select(*names).unionByName(extra.select(*names)).unionByName(moved.select(*names)), "findings")
    return ours, found


def replica_of(pages: DataFrame) -> DataFrame:
    """A second copy with known faults, for want of a real one: every 97th payload has its last character
    replaced, every 211th record is gone, every 503rd has grown."""
    n = F.col("page_id")
    html = F.when(n % 97 == 13, F.concat(F.expr("substring(html, 1, length(html) - 1)"), F.lit("\u007f"))).when(n % 503 == 7, F.concat("html", F.lit("<!-- -->"))).otherwise(F.col("html"))
    return pages.withColumn("html", html).where("page_id is null or page_id % 211 <> 5")


def query(pages: DataFrame) -> DataFrame:
    """Every record of the catalogue, where it stands, its digest and what the audit says of the replica."""
    ours, found = audit(records(pages), records(replica_of(pages)))
    named = found.where("status <> 'extra'").groupBy(F.col("id").alias("i"), F.col("digest").alias("d")).agg(F.min_by("status", F.col("status") == "moved").alias("status"), F.max(F.when(F.col("status") != "moved", F.col("n"))).alias("n"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    each = ours.join(named, same, "left").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    hit = F.col("status").isNotNull() & (F.col("j") >= F.col("c") - F.coalesce("n", "c"))  # of equal records the last are those that are gone
    offset = F.col("offset") + F.col("j") * F.col("size")
    return each.select(
        F.col("id").alias("page_id"), offset.alias("record_offset"), "size", F.floor(offset / RANGE_BYTES).cast("long").alias("leaf"), F.col("digest").alias("record_sha256"), F.when(hit, F.col("status")).otherwise("intact").alias("status")
    )


SQL = """
WITH rec AS (
  SELECT page_id, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || coalesce(octet_length(encode(html))::VARCHAR, '-') || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS r FROM pages
), laid AS (
  SELECT page_id, sha256(r) AS record_sha256, octet_length(r)::BIGINT AS size,
         coalesce(sum(octet_length(r)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset FROM rec
)
SELECT page_id, record_offset, size, record_offset // 1048576 AS leaf, record_sha256,
       CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 97 = 13 OR page_id % 503 = 7 THEN 'damaged' ELSE 'intact' END AS status
FROM laid
"""
