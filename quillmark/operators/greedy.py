"""Duplicates in the order of arrival: each posting joins the first slot it is found to belong to, or opens one.

A slot is known by what its first posting was looked up by (url; leader and place; leader; MinHash buckets), but is compared
as the fused posting that it has become. What a posting joins thus depends on all before it, but only on those with
which it shares a lookup, or which share one with these. Postings that lookups connect make up a component; components are
dealt to tasks, and in each the postings pass one by one, in order, by the slots of that component alone.

The order within a component can't be dealt out, so a component of any size is one task's. It costs little for each posting:
of a bucket it meets those slots alone whose place and leader leave a choice, in order until the first that it
joins, and buckets that no other posting has are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import dedup
from quillmark.operators.graph import components
from quillmark.shared import apart, cut, partitions


class Likeness:
    """The likeness of two texts by their common blocks, worked out no further than a bound needs; of an empty one 0."""

    def __init__(self, a: str, b: str):
        self.matcher = SequenceMatcher(None, a, b) if a and b else None
        self.value = None if self.matcher else 0.0
        if self.matcher and a == b:
            self.value = 1.0

    def over(self, bound: float, equal: bool = False) -> bool:
        """Is it above the bound, or, if ``equal``, at it?"""
        enough = (lambda x: x >= bound) if equal else (lambda x: x > bound)
        if self.value is None and enough(self.matcher.real_quick_ratio()) and enough(self.matcher.quick_ratio()):
            self.value = self.matcher.ratio()
        return self.value is not None and enough(self.value)

    def exact(self) -> float:
        if self.value is None:
            self.value = self.matcher.ratio()
        return self.value


@lru_cache(1 << 18)
def alike(a: str, b: str, bound: float) -> bool:
    """Are two places at least so alike?"""
    return a == b or Likeness(a, b).over(bound, equal=True)


@dataclass(slots=True)
class Posting:
    key: int
    url: str
    title: str
    institute: str
    person: str
    size: int
    buckets: tuple[str, ...] = ()


def same(a: Posting, b: Posting, threshold: float = dedup.THRESHOLD) -> bool:
    """``dedup.same_posting`` for two postings, with no more of the likenesses than it takes."""
    if a.url and a.url == b.url:
        return True
    known = bool(a.person and b.person)
    if known and a.person != b.person:
        return False
    placed = bool(a.institute and b.institute)
    title, place = Likeness(a.title, b.title), Likeness(a.institute, b.institute)
    if known:
        words = a.person.split()
        if len(words) >= 2 and all(len(w) > 1 for w in words):
            if not placed or title.over(dedup.FULL_NAME) or place.over(dedup.FULL_NAME):
                return True
        elif any(title.over(t) and (not p or (placed and place.over(p))) for t, p in dedup.ONE_NAME):
            return True
    if placed and a.institute == b.institute and title.over(dedup.SAME_PLACE[known], equal=True):
        return True
    # the place adds its whole weight at most
    if not title.over((threshold - dedup.PLACE - 1e-9) / dedup.TITLE):
        return False
    return dedup.TITLE * title.exact() + dedup.PLACE * (place.exact() if placed else 0.0) >= threshold


class Slots:
    """The slots of one component, in the order in which they were opened."""

    def __init__(self, threshold: float = dedup.THRESHOLD):
        self.threshold = threshold
        self.slots: list[Posting] = []
        self.firsts: list[tuple[int, str, str, tuple[str, ...]]] = []  # key, url, person and buckets of the first posting
        self.by_url: dict[str, int] = {}
        self.by_both: dict[tuple[str, str], int] = {}
        self.by_person: dict[str, list[int]] = {}
        self.by_bucket: dict[str, dict[tuple[str, bool], list[int]]] = {}  # by place, and whether there is a leader, as of now
        self.now_url: dict[str, set[int]] = {}  # of slots that have another url, or leader, than their first posting
        self.now_person: dict[str, set[int]] = {}

    def _near(self, job: Posting) -> Iterator[int]:
        """The slots of a bucket of ``job`` that it may join, in order. What ``same`` can't hold for is left out: unless the urls or
        the leaders are the same, one side must be without a leader, and, where the title alone isn't enough, both placed, alike."""
        bound = (self.threshold - dedup.TITLE) / dedup.PLACE - 1e-9
        alone = self.threshold <= dedup.TITLE
        found = []
        for b in job.buckets:
            for (place, led), at in self.by_bucket.get(b, {}).items():
                if not (led and job.person) and (alone or (place and job.institute and alike(job.institute, place, bound))):
                    found.append(at)
        others = (self.now_url.get(job.url, set()) if job.url else set()) | (self.now_person.get(job.person, set()) if job.person else set())
        own = set(job.buckets) if others else set()
        found.append(sorted(at for at in others if not own.isdisjoint(self.firsts[at][3])))
        last = -1
        for at in merge(*found):
            if at != last:
                yield at
            last = at

    def _found(self, job: Posting) -> int | None:
        if job.url and job.url in self.by_url:
            return self.by_url[job.url]
        both = self.by_both.get((job.person, job.institute)) if job.person and job.institute else None
        if both is not None and Likeness(job.title, self.slots[both].title).over(dedup.SAME_LEADER_THERE):
            return both
        for at in self.by_person.get(job.person, ()) if job.person else ():
            if same(job, self.slots[at], self.threshold):
                return at
        met = lambda at: job.person and self.firsts[at][2] == job.person
        return next((at for at in self._near(job) if not met(at) and same(job, self.slots[at], self.threshold)), None)

    def _become(self, at: int, new: Posting) -> None:
        """Slot ``at`` is compared as ``new`` from now on."""
        old, (_, url, person, buckets) = self.slots[at], self.firsts[at]
        self.slots[at] = new
        was, now = ((x.institute, bool(x.person)) for x in (old, new))
        for b in buckets if was != now else ():
            held = self.by_bucket[b]
            del held[was][bisect_left(held[was], at)]
            if not held[was]:
                del held[was]
            insort(held.setdefault(now, []), at)
        for known, first, x, y in ((self.now_url, url, old.url, new.url), (self.now_person, person, old.person, new.person)):
            if x != y:
                known.get(x, set()).discard(at)
                if y and y != first:
                    known.setdefault(y, set()).add(at)

    def place(self, job: Posting) -> int:
        """The key of the first posting of the slot that ``job`` joins or opens."""
        at = self._found(job)
        if at is None:
            at = len(self.slots)
            self.slots.append(job)
            self.firsts.append((job.key, job.url, job.person, job.buckets))
            if job.url:
                self.by_url[job.url] = at
            if job.person:
                self.by_person.setdefault(job.person, []).append(at)
                if job.institute:
                    self.by_both[job.person, job.institute] = at
            for b in job.buckets:
                self.by_bucket.setdefault(b, {}).setdefault((job.institute, bool(job.person)), []).append(at)
        else:  # the longer description wins, and takes over a leader that it lacks itself
            old = self.slots[at]
            best, other = (job, old) if job.size > old.size else (old, job)
            self._become(at, Posting(best.key, best.url, best.title, best.institute, best.person or other.person, best.size))
        return self.firsts[at][0]


def lookups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prepared rows with their ``buckets``, those that other postings have as well; (a, b): postings that share a lookup, tied
    to the least that has it). A bucket whose postings all have a leader ties none: only one leader's could be one."""
    texts = rows.groupBy("text").agg(F.min("k").alias("least"))
    banded = dedup.banded(texts.select(F.col("least").alias("k"), "text"), "k", "text").groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "digest"))), lambda b: b.digest).alias("buckets"))
    known, _ = cut(rows.join(apart(texts.join(apart(banded.withColumnRenamed("k", "least")), "least").select("text", "buckets")), "text"), "lookups")
    named = lambda p, c: F.when(F.col(c) != "", F.array(F.concat(F.lit(p), F.col(c)))).otherwise(F.array().cast("array<string>"))
    buckets = F.transform("buckets", lambda b, i: F.concat(F.lit("b"), i.cast("string"), F.lit("-"), b))
    each = known.select("k", "person", F.explode(F.concat(named("u", "url"), named("p", "person"), buckets)).alias("by"))
    least = each.groupBy("by").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"), (F.min("person") == "").alias("unled")).where("n > 1").drop("n")
    shared, _ = cut(each.join(apart(least), "by").select("k", "by", "first", "unled"), "shared")
    bucket = F.col("by").startswith("b")
    held = known.drop("buckets").join(apart(shared.where(bucket).groupBy("k").agg(F.collect_list("by").alias("buckets"))), "k", "left")
    ties = shared.where((F.col("k") != F.col("first")) & (~bucket | F.col("unled")))
    return held.withColumn("buckets", F.coalesce("buckets", F.array().cast("array<string>"))), ties.select(F.col("k").alias("a"), F.col("first").alias("b")).distinct()


def ordered_groups(jobs: DataFrame, key: str, threshold: float = dedup.THRESHOLD, most: int | None = None) -> DataFrame:
    """(k, grp): every posting's key, and the key of the first posting of its slot, in the order of ``key``.

    Postings are slim here (no descriptions), and a task holds the slots of one component at a time.
    With ``most``, a component of more postings is refused with an error that names it."""
    rows, _ = cut(dedup.prepared(jobs, key).join(apart(jobs.select(F.col(key).cast("long").alias("k"), F.length(F.coalesce("description", F.lit(""))).cast("long").alias("size"))), "k"), "prepared")
    known, ties = lookups(rows)
    roots, _ = cut(components(ties), "roots")
    held = known.join(apart(roots.withColumnRenamed("node", "k")), "k", "left").withColumn("root", F.coalesce("root", "k"))
    if most is not None:
        held, _ = cut(held, "components")
        large = held.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).orderBy(F.desc("n")).limit(1).collect()
        if large:
            raise ValueError(f"the component of posting {large[0].root} has {large[0].n} postings, more than {most}: use order='components', or raise most")
    columns = ["root", "k", "url", "title", "institute", "person", "size", "buckets"]
    schema = pa.schema([("k", pa.int64()), ("grp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, slots = None, Slots(threshold)
        for batch in batches:
            keys, groups = [], []
            for r, k, *rest, buckets in zip(*(batch.column(c).to_pylist() for c in columns)):
                if r != root:
                    root, slots = r, Slots(threshold)
                keys.append(k)
                groups.append(slots.place(Posting(k, *rest, tuple(buckets))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(groups, pa.int64())], schema=schema)

    dealt = held.select(*columns).repartition(partitions(jobs.sparkSession), "root").sortWithinPartitions("root", "k")
    return dealt.mapInArrow(run, "k long, grp long")
