"""Keyed state that expires, over streams whose records come in any order within the watermark's delay.

Records wait in a list of their key until the watermark has passed them; a timer then hands them over in the order of time to
a machine of the key, so the answer doesn't depend on the order of arrival. What a machine knows is a map from items
to a few numbers and an instant until which they matter; another timer drops items when that has passed, and a key that
knows nothing more has no state left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "at long, id long, item string, failed boolean, value double"
_KNOWN = "a double, b double, until long"


class Machine:
    """What happens to the records of one key: ``take`` gets what is known of the record's item, or None, and returns (what
    is known from now on, or None; a row of the answer). ``until`` is the instant in milliseconds up to which it matters."""

    answer = ""

    def take(self, known: tuple[float, float, int] | None, at: int, failed: bool, value: float) -> tuple[tuple[float, float, int] | None, tuple]:
        raise NotImplementedError


class NegativeCache(Machine):
    """A lookup after one that failed is skipped for ``ttl`` seconds from then."""

    answer = "looked_up long, skipped long"

    def __init__(self, ttl: float):
        self.ttl = int(ttl * 1000)

    def take(self, known, at, failed, value):
        if known and at < known[2]:
            return known, (0, 1)
        return ((0.0, 0.0, at + self.ttl) if failed else None), (1, 0)


class Breaker(Machine):
    """``limit`` failures in a row open a circuit for ``cooldown`` seconds; then one call is let through, which closes it or
    opens it again. Failures are forgotten after ``memory`` seconds without a call that was made."""

    answer = "called long, rejected long"

    def __init__(self, limit: int, cooldown: float, memory: float = 7 * 86_400.0):
        self.limit, self.cooldown, self.memory = limit, int(cooldown * 1000), int(memory * 1000)

    def take(self, known, at, failed, value):
        failures, opened = (int(known[0]), known[1]) if known and at < known[2] else (0, 0.0)
        if failures >= self.limit and at < opened:
            return known, (0, 1)
        if not failed:
            return None, (1, 0)
        failures += 1
        opened = float(at + self.cooldown) if failures >= self.limit else 0.0
        return (float(failures), opened, at + max(self.memory, self.cooldown)), (1, 0)


class Changes(Machine):
    """Whether an item's value, a number such as a hash of 53 bits, differs from the one before it, if that came within
    ``memory`` seconds."""

    answer = "first long, changed long, unchanged long"

    def __init__(self, memory: float):
        self.memory = int(memory * 1000)

    def take(self, known, at, failed, value):
        new = (value, 0.0, at + self.memory)
        if known is None or at >= known[2]:
            return new, (1, 0, 0)
        return new, ((0, 1, 0) if known[0] != value else (0, 0, 1))


def _plain(r) -> tuple[int, int, str, bool, float]:
    at, id_, item, failed, value = r
    return int(at), int(id_), str(item), bool(failed), float(value)


class _InOrder(StatefulProcessor):
    def __init__(self, machine: Machine, key: str):
        self.machine, self.key = machine, key
        self.columns = [c.split()[0] for c in machine.answer.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.known = handle.getMapState("known", "item string", _KNOWN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [_plain(r) for frame in rows for r in zip(*(frame[c].tolist() for c in ("at", "id", "item", "failed", "value")))]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new) + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(map(_plain, self.waiting.get())) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        # a call to the state costs more than a record: it is read and written once, not for each of them
        before = {item: tuple(value) for (item,), value in self.known.iterator()} if self.known.exists() else {}
        known, totals = dict(before), [0] * len(self.columns)
        for at, _, item, failed, value in due:
            new, answer = self.machine.take(known.get(item), at, failed, value)
            totals = [a + b for a, b in zip(totals, answer)]
            if new is not None:
                known[item] = new
            else:
                known.pop(item, None)
        if later:
            if due:
                self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        known = {item: new for item, new in known.items() if new[2] > now}
        for item, new in known.items():
            if before.get(item) != new:
                self.known.updateValue((item,), new)
        for item in before.keys() - known.keys():
            self.known.removeKey((item,))
        left = [int(new[2]) for new in known.values()]
        for at in {*(r[0] + 1 for r in later[:1]), *([min(left)] if left else [])}:
            self.handle.registerTimer(at)
        yield pd.DataFrame({self.key: [key[0]], **{c: [n] for c, n in zip(self.columns, totals)}}) if due else pd.DataFrame()

    def close(self) -> None:
        pass


def answered(stream: DataFrame, by: str, machine: Machine, failed: str, item: str = "''", value: str = "0D", order: str = "event_id", delay: str = "1 day") -> DataFrame:
    """(by, and the machine's counts, to be summed) of the records of a stream with an event time ``ts``: those of one
    key, and within it of one ``item``, meet ``machine`` in the order of time and ``order``. The session needs ``ROCKS`` as
    its state store. Records that are later than ``delay`` are dropped, and so are those without a key."""
    kind = dict(stream.dtypes)[by]
    rows = stream.where(F.col(by).isNotNull()).withWatermark("ts", delay).select(by, "ts", F.unix_millis("ts").alias("at"), F.expr(order).cast("long").alias("id"), F.expr(item).cast("string").alias("item"), F.expr(failed).alias("failed"), F.expr(value).cast("double").alias("value"))
    return rows.groupBy(by).transformWithStateInPandas(statefulProcessor=_InOrder(machine, by), outputStructType=f"{by} {kind}, {machine.answer}", outputMode="Append", timeMode="EventTime")


def ended(stream: DataFrame, last: DataFrame, by: str, key: object, days: int = 3650) -> DataFrame:
    """``stream`` and a record of a ``key`` of its own far behind ``last`` (one row, ts), which ends what still waits."""
    from quillmark.shared import scratch

    spark, mark = stream.sparkSession, scratch(stream.sparkSession, "end-of-stream")
    others = [F.lit(key if c == by else None).cast(t).alias(c) for c, t in stream.dtypes if c != "ts"]
    rows = last.select((F.col("ts").cast("timestamp") + F.make_interval(days=F.lit(days))).alias("ts"), *others).select(*stream.columns)
    rows.write.parquet(mark)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(mark))


def state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What the stream at ``checkpoint`` holds under ``name`` ('waiting' or 'known'), a row for each key and entry."""
    return spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "true").load(checkpoint)
