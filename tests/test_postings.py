"""Fetching, state, ranks and reports against plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import institutes, lookup, ranking, recommend, report, store
from quillmark.plans import catalog, postings
from quillmark.sources import fetch
from quillmark.streaming import jobs
from tests.conftest import SF


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.waits.append(s)
        self.now += s


def answers(*given):
    left = list(given)

    def transport(url, headers):
        assert headers["User-Agent"]
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    return transport


def test_fetcher_tries_again_and_backs_off():
    clock = Clock()
    f = fetch.Fetcher(answers((503, ""), TimeoutError("slow"), (200, "ok"), (404, "no"), (200, "b")), clock=clock, sleep=clock.sleep)
    assert f.get("http://a/1") == (200, "ok", None, 3)
    assert 1.0 <= clock.waits[0] <= 1.2 and 2.0 <= clock.waits[1] <= 2.4
    assert f.get("http://a/2") == (404, None, "status 404", 1)
    assert f.get("http://a/3")[0] == 200 and clock.waits[-1] == pytest.approx(1.0)  # the host's pause


def test_fetcher_leaves_a_failing_host_alone():
    clock = Clock()
    f = fetch.Fetcher(answers(*[(500, "")] * 4, (200, "x"), *[(500, "")] * 3, (200, "y")), pause=0, retries=0, limit=3, cooldown=60, clock=clock, sleep=clock.sleep)
    assert [f.get("http://a/")[2] for _ in range(5)] == ["status 500"] * 3 + ["circuit open"] * 2
    clock.now += 61
    assert f.get("http://a/")[2] == "status 500" and f.get("http://a/")[2] == "circuit open"  # half open, and open again
    clock.now += 61
    assert f.get("http://a/")[0] == 200 and [f.get("http://a/")[0] for _ in range(3)] == [500] * 3


def test_fetched(spark):
    def transport(url, headers):
        if "bad" in url:
            raise ValueError("no such host")
        return (200, url.upper())

    rows = [(1, "http://a/1"), (2, "http://b/2"), (3, "http://bad/3"), (4, None)]
    df = spark.createDataFrame(rows, "id long, url string")
    got = {r.id: (r.status, r.body, r.error, r.tries) for r in fetch.fetched(df, transport, pause=0.0, backoff=0.0).collect()}
    assert got == {1: (200, "HTTP://A/1", None, 1), 2: (200, "HTTP://B/2", None, 1), 3: (None, None, "ValueError: no such host", 4), 4: (None, None, "no url", 0)}
    batches = fetch.id_batches(spark.range(230).repartition(3), "id").collect()
    assert sorted(i for b in batches for i in b.ids) == list(range(230)) and max(len(b.ids) for b in batches) <= 50
    assert fetch.pages("http://x/?p={page}", 1, 3) == ["http://x/?p=1", "http://x/?p=2", "http://x/?p=3"]


def calls(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        by.setdefault(r.user_id, []).append((r.ts.timestamp(), r.event_type == "error"))
    return by


def test_negative_cache(spark):
    got = {r.user_id: (r.n_looked_up, r.n_skipped) for r in catalog.QUERIES["j06_negative_cache"](spark, SF).collect()}
    want = {}
    for user, seen in calls(spark).items():
        until = looked = skipped = 0
        for at, failed in seen:
            if at < until:
                skipped += 1
                continue
            looked += 1
            until = at + 6 * 3600 if failed else until
        want[user] = (looked, skipped)
    assert got == want and sum(s for _, s in want.values()) > 0


def test_circuits(spark):
    got = {r.user_id: (r.n_calls, r.n_rejected) for r in catalog.QUERIES["j07_circuit_breaker"](spark, SF).collect()}
    want = {}
    for user, seen in calls(spark).items():
        run = until = rejected = 0
        for at, failed in seen:
            if run >= 2 and at < until:
                rejected += 1
                continue
            run = run + 1 if failed else 0
            until = at + 12 * 3600 if run >= 2 else until
        want[user] = (len(seen), rejected)
    assert got == want and sum(r for _, r in want.values()) > 0


def test_content_changes(spark, tmp_path):
    page = lambda k, t: (k, t, "We have an open position for a postdoc in cells. " * (t % 2) + f"Version {t // 2} of the page stays here.")
    rows = [page("a", 1), page("a", 3), page("a", 3 + 1), page("b", 1)]
    spark.createDataFrame(rows, "k string, at int, text string").write.parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema("k string, at int, text string").parquet(str(tmp_path / "pages"))
    got = jobs.drained(jobs.content_changes(stream, "k", "text", ["postdoc"]), "append").collect()
    assert sorted((r.k, r.n_snippets, r.changed) for r in got) == [("a", 0, False), ("a", 1, False), ("a", 1, True), ("b", 1, False)]


def test_ranks_equal_sorted_lists(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i long").repartition(5)
    got = {r.i: r.rank for r in ranking.ranked(df, ["g"], [F.desc("v"), "i"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = k
    assert got == want
    assert sorted(r.rank for r in ranking.global_rank(df, ["i"]).collect()) == list(range(1, 3001))
    assert ranking.ranked(df.limit(0), ["g"], ["i"]).count() == 0


def test_long_rule_lists_match_as_short_ones(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    rules = [(word(rng.randrange(0, 8)), f"l{k}") for k in range(60)]
    rows = [(k, word(rng.randrange(0, 14))) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, t string")
    table = lookup.rules_table(spark, rules)
    for both_ways in (False, True):
        want = {k: next((x for p, x in rules if p in t or (both_ways and t in p)), None) for k, t in rows}
        for few in (2000, 0):
            monkeypatch.setattr(lookup, "FEW_RULES", few)
            assert {r.k: r.label for r in lookup.first_match(df, "t", table, both_ways=both_ways).collect()} == want


def test_seeds_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(rng.randrange(1, 5))]) for k in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")

    def cos(a, b):
        n = max(len(a), len(b))
        a, b = a + [0.0] * (n - len(a)), b + [0.0] * (n - len(b))
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    seeds = [v for _, v in rows[:9]]
    for block in (2000, 3):
        monkeypatch.setattr(recommend, "SEED_BLOCK", block)
        got = {r.k: r.best for r in recommend.nearest_seed(df, df.where("k < 9"), "k", "v").collect()}
        assert all(got[k] == pytest.approx(max(cos(v or [], s) for s in seeds)) for k, v in rows)
    assert {r.best for r in recommend.nearest_seed(df, df.limit(0), "k", "v").collect()} == {0.0}


def test_rankings_from_json():
    text = '{"tiers": {"1": {"institutions": ["ETH"]}, "x": {}}, "companies": {"top_companies": {"institutions": ["Roche"], "tier_equivalent": 2}, "companies": ["GSK"]}, "tier_lookup_aliases": {"Poly": "ETH"}}'
    found = institutes.Ranking.from_json(text)
    assert found == institutes.Ranking([("Poly", "ETH")], [("ETH", 1), ("Roche", 2), ("GSK", 3)], ["Roche", "GSK"])
    assert institutes.Ranking.from_json("") == institutes.Ranking()


def test_reports_and_stores(spark):
    assert report.complete(["US", "EU", "Korea", "Other", "PIs"]) == ["Dashboard"] and report.subject("2026-03-01", 1, 0) == "2026-03-01: 1 new posting"
    assert len(report.JOB_COLUMNS) == 36 and len(report.PI_COLUMNS) == 11
    bare = report.job_columns(spark.createDataFrame([(1, "T")], "k long, title string"), "k").first()
    assert bare["Title"] == "T" and bare["Tier"] == "" and bare["Info URL 2"] == "" and bare["Match Score"] is None
    log = spark.createDataFrame([("a", datetime(2026, 1, 1), None), ("a", datetime(2026, 1, 2), "x"), ("b", datetime(2026, 1, 3), "y")], "s string, t timestamp, e string")
    assert {(r.s, r.found, r.errors, r.status) for r in store.run_log(log, "s", "t", "e").collect()} == {("a", 1, 1, "partial"), ("b", 0, 1, "failed")}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.unwrapped(F.lit("https://s/l/?uddg=https%3A%2F%2Fa.org%2Fx%3Fy%3D1&rut=2"))) == "https://a.org/x?y=1" and one(X.unwrapped(F.lit("http://a/b"))) == "http://a/b"


def test_names_of_places(spark):
    df = spark.createDataFrame([(n,) for n in postings.NAMES], "n string")
    got = {r.n: r.tier for r in institutes.with_tier(df, "n", postings.RANKING).collect()}
    assert got == postings._TIERS
