"""Keyed stores as functions of DataFrames: what a merge would write, without mutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import SITES


def filled(c: Column) -> Column:
    """Null where the value is null or an empty string."""
    return F.when(c.cast("string") == "", F.lit(None)).otherwise(c)


def upsert(store: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), tombstones: DataFrame | None = None) -> DataFrame:
    """``store`` after ``new`` came in: filled values overwrite, columns in ``keep`` stay as they were once
    set, keys in ``tombstones`` (key) don't come back, unknown keys are added."""
    if tombstones is not None:
        new = new.join(tombstones.select(key), key, "left_anti")
    value = [c for c in store.columns if c != key]
    right = new.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in value), F.lit(True).alias("__new"))
    left = store.withColumn("__old", F.lit(True))

    def merge(c: str) -> Column:
        a, b = F.col(c), F.col(f"__{c}")
        return (F.coalesce(filled(a), b) if c in keep else F.coalesce(filled(b), a)).alias(c)

    return left.join(right, key, "full").select(key, *map(merge, value))


def _in_turn(new: DataFrame, keys: list[str], order: list | None, empty_counts: bool) -> DataFrame:
    """One row for each key: of each column the last value that counts, in the order of ``order``."""
    by = F.struct(*(order or [F.lit(0)]))
    value = [c for c in new.columns if c not in keys]
    counts = lambda c: F.col(c).isNotNull() if empty_counts else filled(F.col(c)).isNotNull()
    return new.groupBy(*keys).agg(*(F.max_by(c, F.when(counts(c), by)).alias(c) for c in value))


def upsert_jobs(store: DataFrame, new: DataFrame, tombstones: DataFrame | None = None, sites: tuple[str, ...] = SITES, order: list | None = None) -> DataFrame:
    """``store`` (url and any columns) after the postings ``new`` came in, in the order of ``order``. Filled values
    overwrite, but never a status, nothing of a posting that is dismissed, and no institute by the name of a job site, unless
    what stands there is one too or nothing. Urls that are not there are added, unless they are in ``tombstones`` (url)."""
    value = [c for c in store.columns if c != "url"]
    known = new.select(*(c for c in new.columns if c in store.columns), *(order or [])) if order else new.select(*(c for c in new.columns if c in store.columns))
    known = known.where("url is not null")
    if "institute" in known.columns:  # among what comes, a site's name gives way as well
        site = F.lower(F.trim(F.coalesce("institute", F.lit("")))).isin(*sites)
        known = known.withColumn("__site", F.when(site, F.col("institute"))).withColumn("institute", F.when(~site, F.col("institute")))
    came = _in_turn(known, ["url"], order, empty_counts=False).withColumn("__came", F.lit(True))
    have = [c for c in value if c in came.columns]
    right = came.select("url", "__came", *(["__site"] if "__site" in came.columns else []), *(F.col(c).alias(f"__{c}") for c in have))
    both = store.withColumn("__here", F.lit(True)).join(right, "url", "full")
    if tombstones is not None:
        gone = tombstones.select("url", F.lit(True).alias("__gone")).distinct()
        both = both.join(gone, "url", "left").where("__here or __gone is null").drop("__gone")
    fixed = F.col("__here").isNotNull() & (F.coalesce(F.col("status"), F.lit("")) == "dismissed") if "status" in value else F.lit(False)

    def merged(c: str) -> Column:
        a = F.col(c)
        if c not in have:
            return a
        b = F.col(f"__{c}")
        if c == "status":
            return F.when(F.col("__here").isNotNull(), a).otherwise(b)
        if c == "institute":
            old_site = F.lower(F.trim(F.coalesce(a, F.lit("")))).isin(*sites)
            b = F.coalesce(b, F.when(filled(a).isNull() | old_site, F.col("__site")))
        return F.when(fixed, a).otherwise(F.coalesce(filled(b), a))

    return both.select("url", *(merged(c).alias(c) for c in value)).select(*store.columns)


def upsert_people(store: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("name", "institute"), order: list | None = None) -> DataFrame:
    """``store`` after the people ``new`` came in, in the order of ``order``: known by name and institute, where null is a
    value like others; what isn't null overwrites, empty strings too; others are added."""
    value = [c for c in store.columns if c not in keys]
    came = _in_turn(new.select(*(c for c in new.columns if c in store.columns), *(order or [])), list(keys), order, empty_counts=True)
    have = [c for c in value if c in came.columns]
    right = came.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__{c}") for c in have), F.lit(True).alias("__came"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = store.withColumn("__here", F.lit(True)).join(right, on, "full")
    name = lambda k: F.when(F.col("__here").isNotNull(), F.col(k)).otherwise(F.col(f"__{k}")).alias(k)
    return both.select(*(name(k) for k in keys), *((F.coalesce(F.col(f"__{c}"), F.col(c)) if c in have else F.col(c)).alias(c) for c in value)).select(*store.columns)


def insert_or_ignore(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return store.unionByName(new.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def overlay(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``base`` with the filled values of ``more`` on top, by key; rows are neither added nor dropped."""
    shared = [c for c in more.columns if c != key]
    right = more.select(key, *(F.col(c).alias(f"__{c}") for c in shared))
    return base.join(right, key, "left").select(*(F.coalesce(filled(F.col(f"__{c}")), F.col(c)).alias(c) if c in shared else F.col(c) for c in base.columns))


def append_missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.unionByName(others.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def deleted(earlier: DataFrame, later: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of ``earlier`` that are still known but gone from ``later``: removed by hand."""
    return earlier.select(key).join(known.select(key), key, "left_semi").join(later.select(key), key, "left_anti").distinct()


def run_log(results: DataFrame, source: str, started: str, error: str) -> DataFrame:
    """One line a source: how many records it gave, how many failed, when it began and ended, and its status: ``ok``,
    ``partial`` or ``failed``."""
    bad = F.count_if(F.coalesce(F.col(error).cast("string"), F.lit("")) != "")
    status = F.when(F.col("errors") == 0, "ok").when(F.col("found") > 0, "partial").otherwise("failed")
    return results.groupBy(source).agg((F.count(F.lit(1)) - bad).alias("found"), bad.alias("errors"), F.min(started).alias("began"), F.max(started).alias("ended")).withColumn("status", status)


def dismissed(store: DataFrame, tombstones: DataFrame, key: str, status: str = "status") -> DataFrame:
    """``store`` with the status of all that has been dismissed set to that."""
    marked = tombstones.select(key, F.lit(True).alias("__gone")).distinct()
    return store.join(marked, key, "left").withColumn(status, F.when(F.col("__gone"), "dismissed").otherwise(F.col(status))).drop("__gone")


def exported(store: DataFrame, keys: DataFrame, key: str, status: str = "status") -> DataFrame:
    """``store`` with what has been exported marked, but for what was dismissed meanwhile."""
    marked = keys.select(key, F.lit(True).alias("__out")).distinct()
    return store.join(marked, key, "left").withColumn(status, F.when(F.col("__out") & (F.col(status) != "dismissed"), "exported").otherwise(F.col(status))).drop("__out")


def upsert_edges(store: DataFrame, new: DataFrame, a: str = "a", b: str = "b", order: list | None = None) -> DataFrame:
    """Undirected edges (a, b, shared, recent) after those of ``new`` (a, b, shared) came one by one in the order of
    ``order`` (columns of ``new``; by default the lesser share first), in either orientation. An edge that isn't there
    yet is put in with what it shares as ``recent``; each later one raises ``shared`` if it has more, and counts
    one in ``recent``. One row for each pair."""
    turned = lambda df: df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    first = F.struct(*(order or ["shared"]), F.col("shared").alias("__shared"))
    came = turned(new).groupBy(a, b).agg(F.max("shared").alias("__most"), F.min(first).getField("__shared").alias("__first"), F.count(F.lit(1)).alias("__n"))
    known = turned(store).select(a, b, "shared", "recent")
    both = known.join(came, [a, b], "full")
    kinds = {f.name: f.dataType for f in store.schema}
    recent = F.when(F.col("__n").isNull(), F.col("recent")).when(F.col("recent").isNull(), F.col("__first") + F.col("__n") - 1).otherwise(F.col("recent") + F.col("__n"))
    return both.select(a, b, F.greatest("shared", "__most").cast(kinds["shared"]).alias("shared"), recent.cast(kinds["recent"]).alias("recent"))


def merge_edges(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Undirected edges in one orientation: greatest weight and how often each came."""
    return edges.groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.max(weight).alias(weight), F.count(F.lit(1)).alias("times"))


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    first = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
