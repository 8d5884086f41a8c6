"""A keyed store with versions: an append-only log of changes, snapshots, and reads as of a version.

Writers append batches of changes, each under a number that only one of them can get, so late ones neither overwrite nor
wait for others. A reader picks a version and sees the batches up to it, whatever is written meanwhile. A full
refresh reads one version, works for as long as it takes, and appends its changes with the version it read; what others wrote
in between stays, key by key. Compaction writes a snapshot of a version, from which later reads start; the log before it
may then be dropped.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS, _LOG, _SNAPSHOTS = "marks", "log", "snapshots"


class VersionedStore:
    """A store of rows with a ``key`` under ``path``, in a folder that all machines see. Columns are those of ``schema`` (DDL)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.columns = spark.createDataFrame([], schema).columns

    def _file(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self, kind: str) -> dict[int, str]:
        """Version -> what its mark says."""
        fs, where = self._file(kind)
        if not fs.exists(where):
            return {}
        out = {}
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name.isdigit():
                stream = fs.open(status.getPath())
                out[int(name)] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return out

    def _claim(self, kind: str, version: int, says: str) -> bool:
        """Puts up a mark, if nobody else has: it is written aside and renamed, which fails where there is one."""
        fs, aside = self._file(kind, f".{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(says.encode()))
        stream.close()
        target = self.spark._jvm.org.apache.hadoop.fs.Path(aside.getParent(), f"{version:012d}")
        done = not fs.exists(target) and fs.rename(aside, target)
        if not done:
            fs.delete(aside, False)
        return done

    def version(self) -> int:
        """The last version that is whole; 0 before the first."""
        return max(self._numbers(_MARKS), default=0)

    def append(self, changes: DataFrame, deletes: bool = False, seen: int | None = None) -> int:
        """Writes a batch of rows to put in, or of keys to take out, and returns its version. With ``seen``, the version
        that the batch was worked out from, a key that others have changed since keeps what they wrote. Of several rows of
        one key in a batch any one counts, so a batch should have one each."""
        at = f"{_LOG}/{uuid.uuid4().hex}"
        rows = changes.select(self.key) if deletes else changes.select(*self.columns)
        missing = [F.lit(None).cast(t).alias(c) for c, t in self.spark.createDataFrame([], self.schema).dtypes if c not in rows.columns]
        rows.select("*", *missing).select(*self.columns, F.lit(deletes).alias("__gone")).write.parquet(f"{self.path}/{at}")
        while True:
            version = self.version() + 1
            if self._claim(_MARKS, version, f"{at} {version - 1 if seen is None else seen}"):
                return version

    def _changes(self, low: int, high: int) -> DataFrame | None:
        """All changes of versions above ``low`` up to ``high``, with their version and the one that each was worked out from."""
        found = []
        for version, says in sorted(self._numbers(_MARKS).items()):
            if low < version <= high:
                at, seen = says.rsplit(" ", 1)
                frame = self.spark.read.schema(f"{self.schema}, __gone boolean").parquet(f"{self.path}/{at}")
                found.append(frame.withColumns({"__version": F.lit(version).cast("long"), "__seen": F.lit(int(seen)).cast("long")}))
        return reduce(DataFrame.unionByName, found) if found else None

    def as_of(self, version: int | None = None) -> DataFrame:
        """The rows of the store at a version, by default the last one."""
        top = self.version() if version is None else version
        snapshots = {v: at for v, at in self._numbers(_SNAPSHOTS).items() if v <= top}
        base = max(snapshots, default=0)
        state = ", ".join([self.schema, "__gone boolean", "__version long"])
        rows = self.spark.read.schema(state).parquet(f"{self.path}/{snapshots[base]}") if base else self.spark.createDataFrame([], state)
        return self._state(rows, base, top).where("not __gone").select(*self.columns)

    def _state(self, rows: DataFrame, base: int, top: int) -> DataFrame:
        """The last change of each key. One that was worked out from a version before another's change of the key doesn't
        count: the others' is the later word. So the changes of a key are gone through in order, as an aggregate over few."""
        new = self._changes(base, top)
        if new is None:
            return rows
        every = rows.withColumn("__seen", F.col("__version")).unionByName(new)
        step = F.struct("__version", "__seen", "__gone", F.struct(*self.columns).alias("row"))
        listed = every.groupBy(self.key).agg(F.sort_array(F.collect_list(step)).alias("steps"))
        last = F.aggregate(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(1))), F.get("steps", F.lit(0)), lambda now, x: F.when(x["__seen"] >= now["__version"], x).otherwise(now))
        return listed.select(last.alias("s")).select("s.row.*", F.col("s.__gone").alias("__gone"), F.col("s.__version").alias("__version"))

    def compact(self, version: int | None = None) -> int:
        """Writes a snapshot of a version; deletions are kept in it, with their versions, so that late writers still meet them."""
        top = self.version() if version is None else version
        snapshots = {v: at for v, at in self._numbers(_SNAPSHOTS).items() if v <= top}
        base = max(snapshots, default=0)
        if base == top:
            return top
        state = ", ".join([self.schema, "__gone boolean", "__version long"])
        rows = self.spark.read.schema(state).parquet(f"{self.path}/{snapshots[base]}") if base else self.spark.createDataFrame([], state)
        at = f"{_SNAPSHOTS}-data/{uuid.uuid4().hex}"
        self._state(rows, base, top).write.parquet(f"{self.path}/{at}")
        self._claim(_SNAPSHOTS, top, at)
        return top
