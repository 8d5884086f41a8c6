"""Streaming jobs over an ``events`` table: each reads it as a stream, to its end, and returns what
its sink holds. The sinks write tables, so a failed micro-batch is simply repeated."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.shared import scratch


def events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    found = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")  # a pattern serves a file as well as a folder
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, key: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs ``stream`` over all there is and returns its sink: of updates the last for each key counts."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession, "stream")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{at}/sink/batch={epoch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    schema = stream.schema.add("epoch", "long")
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/sink")
    return (key(found) if key else found).drop("epoch")


def _latest(*keys: str) -> Callable[[DataFrame], DataFrame]:
    def pick(found: DataFrame) -> DataFrame:
        rest = [c for c in found.columns if c not in keys]
        return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))

    return pick


def tumbling(spark: SparkSession, d: str, size: str) -> DataFrame:
    counts = events(spark, d).withWatermark("ts", "1 day").groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(counts.select(F.col("window.start").alias("start"), "event_type", "n"), "update", _latest("start", "event_type"))


def sliding(spark: SparkSession, d: str, size: str, step: str) -> DataFrame:
    counts = events(spark, d).withWatermark("ts", "1 day").groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(counts.select(F.col("window.start").alias("start"), "event_type", "n"), "update", _latest("start", "event_type"))


def sessions(spark: SparkSession, d: str, gap: str) -> DataFrame:
    """Sessions as they end: a session is written, and its state forgotten, once the watermark has passed its gap. A last
    event, far ahead and of no user, ends those that are still open when the stream does."""
    ahead = spark.read.parquet(f"{d}/events.parquet").agg((F.max("ts").cast("timestamp") + F.expr("interval 3650 days")).alias("ts"))
    mark = scratch(spark, "end-of-stream")
    ahead.select(F.lit(None).cast("long").alias("user_id"), "ts").write.parquet(mark)
    end = spark.readStream.schema("user_id long, ts timestamp").parquet(mark)
    stream = events(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "ts").union(end).withWatermark("ts", "1 day")
    counts = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return drained(counts.select("user_id", F.col("w.start").alias("start"), "n"), "append").where("user_id is not null")


def first_seen(spark: SparkSession, d: str, delay: str = "7 days") -> DataFrame:
    """Each (user, event type) once, however often it comes. State is kept for ``delay`` of event time; what comes
    again after that meets the sink's key."""
    keys = ["user_id", "event_type"]
    stream = events(spark, d).select(*keys, "ts").withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys)
    return drained(stream, "append", lambda found: found.dropDuplicates(keys))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """How often each user's event type changed, in the order of time. State is the last type and a count;
    a micro-batch's rows are sorted before they meet it."""
    def step(key, frames, state):
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        for kind in rows.event_type:
            n += last is not None and kind != last
            last = kind
        state.update((last, n))
        yield pd.DataFrame({"user_id": [key[0]], "n_changes": [n]})

    counted = events(spark, d).groupBy("user_id").applyInPandasWithState(step, "user_id long, n_changes long", "last string, n long", "update", "NoTimeout")
    return drained(counted, "update", _latest("user_id")).where("n_changes > 0")


class Circuit:
    """A breaker: ``limit`` failures in a row open it for ``cooldown`` seconds; then one call is let through, which
    closes it or opens it again."""

    def __init__(self, limit: int, cooldown: float, failures: int = 0, until: float = 0.0):
        self.limit, self.cooldown, self.failures, self.until = limit, cooldown, failures, until

    def allows(self, now: float) -> bool:
        return self.failures < self.limit or now >= self.until

    def told(self, ok: bool, now: float) -> None:
        self.failures = 0 if ok else self.failures + 1
        if self.failures >= self.limit:
            self.until = now + self.cooldown


def circuits(stream: DataFrame, by: str, failed: str, limit: int, cooldown: float) -> DataFrame:
    """(by, n_calls, n_rejected) so far, of calls (by, ts, event_id, ``failed``): a call that its source's open circuit
    rejects is not made and tells nothing. State is the breaker's; calls of a micro-batch come in order of time."""
    def step(key, frames, state):
        failures, until, calls, rejected = state.get if state.exists else (0, 0.0, 0, 0)
        circuit = Circuit(limit, cooldown, failures, until)
        for r in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples():
            now = r.ts.timestamp()
            calls += 1
            if circuit.allows(now):
                circuit.told(not r.failed, now)
            else:
                rejected += 1
        state.update((circuit.failures, circuit.until, calls, rejected))
        yield pd.DataFrame({by: [key[0]], "n_calls": [calls], "n_rejected": [rejected]})

    calls = stream.select(by, "ts", "event_id", F.expr(failed).alias("failed"))
    return calls.groupBy(by).applyInPandasWithState(step, f"{by} {dict(stream.dtypes)[by]}, n_calls long, n_rejected long", "failures long, until double, calls long, rejected long", "update", "NoTimeout")


def negative_cache(stream: DataFrame, by: str, failed: str, ttl: float, delay: str = "1 day") -> DataFrame:
    """(by, n_looked_up, n_skipped) of each micro-batch, to be summed, of lookups: after one that failed, those of the
    next ``ttl`` seconds are skipped. State is dropped when the watermark passes its end, so only keys that failed
    lately are held."""
    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else 0.0
        looked = skipped = 0
        for r in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples():
            now = r.ts.timestamp()
            if now < until:
                skipped += 1
                continue
            looked += 1
            if r.failed:
                until = now + ttl
        if until:
            state.update((until,))
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({by: [key[0]], "n_looked_up": [looked], "n_skipped": [skipped]})

    lookups = stream.withWatermark("ts", delay).select(by, "ts", "event_id", F.expr(failed).alias("failed"))
    return lookups.groupBy(by).applyInPandasWithState(step, f"{by} {dict(stream.dtypes)[by]}, n_looked_up long, n_skipped long", "until double", "update", "EventTimeTimeout")


def content_changes(stream: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, content_hash, n_snippets, changed) of every page that comes: changed if its text differs from the last
    seen and has sentences with one of ``words``. State is a hash."""
    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(frames).sort_values("at").itertuples():
            out.append((k[0], r.content_hash, r.n_snippets, bool(last is not None and last != r.content_hash and r.n_snippets > 0)))
            last = r.content_hash
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "content_hash", "n_snippets", "changed"])

    seen = stream.select(key, "at", X.content_hash(text).alias("content_hash"), F.size(X.snippets(text, words)).alias("n_snippets"))
    return seen.groupBy(key).applyInPandasWithState(step, f"{key} {dict(stream.dtypes)[key]}, content_hash string, n_snippets int, changed boolean", "content_hash string", "append", "NoTimeout")


def breaker(log: DataFrame, by: str, order: list[str], failed, limit: int) -> DataFrame:
    """``log`` with whether its source's circuit is open: ``limit`` failures in a row before this row."""
    w = Window.partitionBy(by).orderBy(*order)
    runs = log.withColumn("__run", F.sum((~failed).cast("int")).over(w))
    before = Window.partitionBy(by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("open", F.coalesce(F.sum(failed.cast("int")).over(before), F.lit(0)) >= limit).drop("__run")
