"""Calls side by side, paged streams, the newest file, and whose profile is whose."""

import json
import os
import threading
import time

from pyspark.sql import functions as F

from quillmark.operators import authors
from quillmark.sources import enrich, latest
from quillmark.sources.paged import PagedInterface


def test_bounded_concurrency(spark, tmp_path):
    at = str(tmp_path)

    def complete(row):
        name = f"{at}/{os.getpid()}-{threading.get_ident()}-{row['host']}"
        open(name, "w").close()
        running = [f for f in os.listdir(at) if f.endswith("-" + row["host"])]
        everyone, began = os.listdir(at), time.time()
        time.sleep(0.05)
        os.remove(name)
        if row["k"] % 10 == 3:
            raise ValueError("no answer")
        return {"said": f"{len(running)} {len(everyone)} {began} {time.time()}", "k": -1, "other": 1}

    rows = [(k, f"h{k % 3}", "old", f"e{k}") for k in range(120)]
    df = spark.createDataFrame(rows, "k int, host string, said string, error string").coalesce(1)
    got = enrich.enriched(df, complete, ["said"], in_flight=8, host=F.col("host"), a_host=3, wanted=F.col("k") < 110).collect()
    spans = [tuple(map(float, r[2].split()[2:])) for r in got if r[2] != "old"]
    assert sum(b - a for a, b in spans) > 2 * (max(b for _, b in spans) - min(a for a, _ in spans))  # they run side by side
    assert got[0].__fields__ == ["k", "host", "said", "error", "error"] and sorted(r[0] for r in got) == list(range(120))
    for r in got:
        if r[0] >= 110:
            assert (r[2], r[4]) == ("old", None)
        elif r[0] % 10 == 3:
            assert (r[2], r[4]) == ("old", "ValueError: no answer")
        else:
            assert 1 <= int(r[2].split()[0]) <= 3 and r[4] is None and r[3] == f"e{r[0]}"
    one = enrich.enriched(df, complete, ["said"], in_flight=4).collect()
    assert [r[0] for r in one] == list(range(120))  # the order stays
    assert max(int(r[2].split()[1]) for r in one if r[0] % 10 != 3) == 4
    assert enrich.enriched(df.limit(0), complete, ["said"]).collect() == []


def test_paged_stream_goes_on_where_it_was(spark, tmp_path):
    (tmp_path / "api").mkdir()
    for query, pages in (("a", 3), ("b", 1), ("c", 4)):
        for k in range(pages):
            answer = {"items": [{"id": f"{query}{k}{i}"} for i in range(2)], "next": str(k + 1) if k + 1 < pages else None}
            (tmp_path / "api" / f"{query}-{k}.json").write_text(json.dumps(answer))
    spark.dataSource.register(PagedInterface)

    def run(batches):
        seen = []
        stream = spark.readStream.format("paged").option("folder", str(tmp_path / "api")).option("queries", "a,b,c").option("requests", "1").load()
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, k: seen.append((k, [tuple(r) for r in df.collect()]))).start()
        until = time.time() + 60
        while sum(bool(x) for _, x in seen) < batches and time.time() < until:
            time.sleep(0.2)
        query.stop()
        return seen

    first, second = run(3), run(5)
    found = {}
    for k, rows in first + second:
        found[k] = rows or found.get(k, [])
    ids = [json.loads(r[3])["id"] for k in sorted(found) for r in found[k]]
    assert ids == [f"{q}{k}{i}" for q, pages in (("a", 3), ("b", 1), ("c", 4)) for k in range(pages) for i in range(2)]


def test_latest_file(spark, tmp_path):
    for k, (name, at) in enumerate([("b.txt", 2000), ("a.txt", 3000), ("c.txt", 3000), ("x.csv", 9000), ("fixed.txt", 10)]):
        (tmp_path / name).write_text(f"line {name}\n")
        os.utime(tmp_path / name, (at, at))
    name = lambda path: path and path.rsplit("/", 1)[1]
    assert name(latest.latest(spark, str(tmp_path), "fixed.txt", "*.txt")) == "fixed.txt"
    assert name(latest.latest(spark, str(tmp_path), "gone.txt", "*.txt")) == "c.txt" and name(latest.latest(spark, str(tmp_path))) == "x.csv"
    assert latest.latest(spark, str(tmp_path), pattern="*.pdf") is None
    rows = spark.read.option("pathGlobFilter", "*.txt").text(str(tmp_path))
    assert [(r.value, r.latest_file) for r in latest.of_latest(rows).collect()] == [("line c.txt", "c.txt")]
    assert [r.value for r in latest.of_latest(rows, "fixed.txt").collect()] == ["line fixed.txt"]


def test_disambiguation(spark):
    people = spark.createDataFrame([(1, "Ada Byron", "ETH Zurich"), (2, "Ada Byron", None), (3, "José Muñoz", "Basel"), (4, "Nobody Known", "x"), (5, None, "x"), (6, "Ada Byron", "ETH Zurich")], "id int, name string, institute string")
    profiles = spark.createDataFrame(
        [("p1", "Ada Byron", "University of Basel", 40, 200, 9000), ("p2", "A. Byron", "ETH Zurich, Switzerland", 10, 20, 100), ("p3", "Ada Byron", "ETH Zurich", 9, 900, 10), ("p4", "Jose Munoz", None, None, None, None), ("p5", "Jorge Munoz", "Basel", 99, 1, 1), ("p6", "Albert Byron", "ETH Zurich", 99, 9, 9), ("p7", None, "x", 1, 1, 1)],
        "profile string, name string, affiliations string, h_index int, papers int, citations int",
    )
    got = {r.id: (r.profile, r.there) for r in authors.disambiguated(people, profiles, "id").collect()}
    assert got[2] == ("p6", False) or got[2] == ("p1", False)
    assert got[1] == got[6] and got[1][1] and set(got) == {1, 2, 3, 6}
    assert got[3][0] in ("p4", "p5")
