"""State that expires: answers in any order of arrival, and nothing left behind."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.streaming import expiring
from quillmark.streaming.expiring import Breaker, Changes, NegativeCache

SCHEMA = "event_id long, ts timestamp, user_id long, kind string, failed boolean, value double"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, expiring.ROCKS)
    yield spark
    spark.conf.set(name, old)


def plain(rows, machine):
    """The machine over each key's and item's records in order, with nothing forgotten but by itself."""
    known, out = {}, {}
    for i, ts, user, kind, failed, value in sorted(rows, key=lambda r: (r[1], r[0])):
        at = int(ts.timestamp() * 1000)
        new, answer = machine.take(known.get((user, kind)), at, failed, value)
        known[user, kind] = new
        out[user] = [a + b for a, b in zip(out.get(user, [0] * len(answer)), answer)]
    return out


def run(spark, stream, at):
    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={epoch}")

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")


@pytest.mark.parametrize("machine", [NegativeCache(3600.0), Breaker(2, 5400.0, 7200.0), Changes(3 * 3600.0)], ids=lambda m: type(m).__name__)
def test_any_order_and_no_state_left(rocks, tmp_path, machine):
    import datetime

    spark, rng, begin = rocks, random.Random(4), datetime.datetime(2026, 1, 1)
    rows = [(k, begin + datetime.timedelta(seconds=rng.randrange(86_400)), rng.randrange(6), rng.choice("ab"), rng.random() < 0.5, float(rng.randrange(3))) for k in range(500)]
    shuffled = rng.sample(rows, len(rows))
    for k in range(3):
        spark.createDataFrame(shuffled[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = expiring.answered(stream, "user_id", machine, "coalesce(failed, false)", item="kind", value="coalesce(value, 0D)", order="coalesce(event_id, -1)", delay="2 days")
    run(spark, out, tmp_path)
    held = expiring.state(spark, f"{tmp_path}/state", "waiting")
    assert held.count() == 500  # all within the delay
    last = (9999, begin + datetime.timedelta(days=3650), -1, "end", False, 0.0)
    spark.createDataFrame([last], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = run(spark, out, tmp_path)  # goes on from its checkpoint
    names = [c.split()[0] for c in machine.answer.split(", ")]
    got = {r.user_id: [r[c] for c in names] for r in found.groupBy("user_id").agg(*(F.sum(c).alias(c) for c in names)).collect()}
    assert got == plain(rows, machine) and all(sum(v) == n for (u, v), n in zip(sorted(got.items()), [x for _, x in sorted(Counter(r[2] for r in rows).items())]))
    assert expiring.state(spark, f"{tmp_path}/state", "waiting").where("key.user_id >= 0").count() == 0
    assert expiring.state(spark, f"{tmp_path}/state", "known").where("key.user_id >= 0").count() == 0  # expired as well


def test_query_counts_all_events(rocks, spark):
    from quillmark.plans import catalog
    from tests.conftest import SF

    rows = catalog.QUERIES["j08_cache_in_order"](spark, SF).collect()
    assert sum(r.looked_up + r.skipped for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count() and sum(r.skipped for r in rows) > 0
