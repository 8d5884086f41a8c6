"""What large inputs need: little work for each window, state or name, and no limit on a group."""

import inspect
import random
import types

import numpy as np
import pytest

from quillmark.operators import dedup, fuzzy, gazetteer, greedy
from quillmark.plans import catalog, extraction
from quillmark.streaming import expiring
from tests.conftest import SF


def _one_by_one(texts, word, threshold):
    out = []
    for low in texts:
        codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        best, _, scored = fuzzy.Keyword(word).match(low, codes, fuzzy._pairs(codes), threshold)
        out.append((best, scored))
    return out


@pytest.mark.parametrize("block", [64, fuzzy.BLOCK])
def test_texts_side_by_side_score_as_one_by_one(monkeypatch, block):
    monkeypatch.setattr(fuzzy, "BLOCK", block)
    rng = random.Random(9)
    words = ["straße", "protein engineering", "\x00a\x00", "ab" * 20, "the", "aaabbb", "a" * 70]
    texts = ["".join(rng.choice("\x00\x01abeghinoprst ß") for _ in range(rng.randrange(1, 150))) for _ in range(40)]
    texts += [w[1:] + "x" + w[:-1] for w in words] + ["a", "\x01", "a" * 69, "xx protein enginering"]
    known = [fuzzy.Keyword(w) for w in words]
    for threshold in (0.3, 0.6, 0.75, 1.0):
        side = fuzzy.Texts(texts, known)
        for w, sharing in zip(known, side.sharing(known, threshold)):
            best, scored = side.scores(w, sharing, threshold)
            assert list(zip(best.tolist(), scored.tolist())) == _one_by_one(texts, w.word, threshold), (w.word, threshold)


def test_few_windows_are_compared_at_all(spark, monkeypatch):
    sought = []
    common = fuzzy.Keyword.common
    monkeypatch.setattr(fuzzy.Keyword, "common", lambda self, grid: sought.append(len(grid)) or common(self, grid))
    texts = [r.text.lower() for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0").orderBy("doc_id").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    known = extraction.fuzzy_keywords(spark, SF)
    run = df.select("i", "t").toArrow().to_batches()
    plan = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, **_: plan.update(rows=[r for b in f(iter(run)) for r in b.to_pylist()]))
    fuzzy.fuzzy_matches(df, "i", "t", known, 0.75)
    assert len(plan["rows"]) == len(texts) * len(known)
    assert 0 < sum(sought) < sum(r["windows"] for r in plan["rows"]) / 100


def test_texts_are_dealt_to_all_tasks(spark):
    one = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "k int, t string").coalesce(1)
    assert fuzzy.fuzzy_matches(one, "k", "t", ["text"], 0.8).rdd.getNumPartitions() >= 16


class _Plain:
    """Slots with no index: each posting looks at all, in order."""

    def __init__(self):
        self.firsts, self.now = [], []

    def place(self, job):
        near = [set(f.buckets) & set(job.buckets) for f in self.firsts]
        both = [i for i, f in enumerate(self.firsts) if job.person and job.institute and (f.person, f.institute) == (job.person, job.institute)]
        led = [i for i, f in enumerate(self.firsts) if job.person and f.person == job.person]
        at = next((i for i, f in enumerate(self.firsts) if job.url and f.url == job.url), None)
        if at is None and both and greedy.Likeness(job.title, self.now[both[-1]].title).over(dedup.SAME_LEADER_THERE):
            at = both[-1]
        if at is None:
            at = next((i for i in [*led, *(i for i, n in enumerate(near) if n)] if greedy.same(job, self.now[i])), None)
        if at is None:
            self.firsts.append(job)
            self.now.append(job)
            return job.key
        old = self.now[at]
        best, other = (job, old) if job.size > old.size else (old, job)
        self.now[at] = greedy.Posting(best.key, best.url, best.title, best.institute, best.person or other.person, best.size)
        return self.firsts[at].key


def _postings(n, seed):
    rng = random.Random(seed)
    words = "yeast plant cell gene".split()
    places = ["", "eth zurich", "university of basel", "university of basle", "kth"]
    return [greedy.Posting(k, rng.choice(["", f"u{rng.randrange(n)}"]), " ".join(rng.choices(words, k=3)) + rng.choice("xyz"), rng.choice(places), rng.choice(["", "", "ada byron", "bock", f"noa nr{rng.randrange(20)}"]), rng.randrange(9), tuple({f"b{rng.randrange(8)}" for _ in range(3)})) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_slots_found_by_their_index(seed):
    plain, slots = _Plain(), greedy.Slots()
    posts = _postings(400, seed)
    want = [plain.place(p) for p in posts]
    assert [slots.place(p) for p in posts] == want and 20 < len(set(want)) < 390


def test_postings_of_one_bucket_meet_few_slots(monkeypatch):
    met = []
    same = greedy.same
    monkeypatch.setattr(greedy, "same", lambda *a: met.append(1) or same(*a))
    slots = greedy.Slots()
    posts = [greedy.Posting(k, "", f"yeast genetics {k}", "eth zurich", "" if k % 4 == 1 else f"noa nr{k}", 1, ("b0",)) for k in range(1000)]
    assert len({slots.place(p) for p in posts}) > 700
    assert len(met) < 3 * len(posts)  # not the square of the bucket


def test_components_have_no_limit():
    assert inspect.signature(greedy.ordered_groups).parameters["most"].default is None


def test_long_tables_of_names_stay_distributed(spark, monkeypatch):
    rng = random.Random(7)
    words = ["new", "york", "city", "san", "jose", "Köln", "İz", "a", "b"]
    names = [(" ".join(rng.choices(words, k=rng.randrange(1, 4))), f"L{k % 5}", k % 3) for k in range(80)] + [("", "x", 0), (None, "y", 0), ("?!", "z", 0)]
    texts = ["".join((w.upper() if rng.random() < 0.3 else w) + rng.choice([" ", ", ", "_", "\n", "x", "-"]) for w in rng.choices(words, k=12)) for _ in range(60)] + ["", None, "...", "new  york"]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "i int, t string")  # two texts a key
    table = spark.createDataFrame(names, "name string, label string, rank int")
    want = [sorted(map(tuple, gazetteer.matches(df, "i", "t", table, every=e).collect())) for e in (True, False)]
    monkeypatch.setattr(gazetteer, "MOST", 10)
    monkeypatch.setattr(gazetteer, "automata", None)  # nothing is collected into one
    assert [sorted(map(tuple, gazetteer.matches(df, "i", "t", table, every=e).collect())) for e in (True, False)] == want
    assert len(want[0]) > len(want[1]) > 100


class _State:
    """A list or a map as the stream's state has it, which counts what it is asked."""

    def __init__(self):
        self.rows, self.held, self.calls = [], {}, 0

    def __getattribute__(self, name):
        if name not in ("rows", "held", "calls") and not name.startswith("__"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(object.__getattribute__(self, "rows") or self.held)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))


def test_state_is_asked_once_a_timer():
    rng = random.Random(2)
    machine = expiring.NegativeCache(60.0)
    runner = expiring._InOrder(machine, "k")
    timers = []
    runner.handle = types.SimpleNamespace(registerTimer=timers.append)
    runner.waiting, runner.known = _State(), _State()
    rows = [(rng.randrange(10**6), k, rng.choice("ab"), rng.random() < 0.5, 0.0) for k in range(1000)]
    runner.waiting.rows = rows
    plain, totals = {}, np.zeros(2, int)
    for now in (400_000, 400_000, 10**6 + 1, 10**7):
        out = list(runner.handleExpiredTimer(("u",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None))
        totals += sum(int(f.looked_up.sum()) for f in out if len(f)), sum(int(f.skipped.sum()) for f in out if len(f))
        assert all(v[2] > now for v in runner.known.held.values())
        assert sorted(runner.waiting.rows) == sorted(r for r in rows if r[0] >= now)
    want = np.zeros(2, int)
    for at, _, item, failed, value in sorted(rows):
        plain[item], answer = machine.take(plain.get(item), at, failed, value)
        want += answer
    assert totals.tolist() == want.tolist() and totals.min() > 0
    assert not runner.known.held and runner.waiting.calls + runner.known.calls < 50
