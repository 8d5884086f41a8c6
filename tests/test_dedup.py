"""Duplicate postings: decisions, groups and fusion, against plain Python over all pairs."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import dedup, graph

COLUMNS = "k long, url string, title string, institute string, pi_name string, description string, field string, source string"


def jobs(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) if n != "k" else r.get("k", i) for n in names) for i, r in enumerate(rows)], COLUMNS)


def like(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def same(a, b):
    """The decision in plain words, on normalised values."""
    if a["url"] and a["url"] == b["url"]:
        return True
    t, p = like(a["title"], b["title"]), like(a["institute"], b["institute"])
    x, y = a["person"], b["person"]
    if x and y and x != y:
        return False
    if x and x == y:
        if a["institute"] and a["institute"] == b["institute"] and t > 0.4:
            return True
        words = x.split()
        if len(words) >= 2 and all(len(w) > 1 for w in words):
            if t > 0.3 or p > 0.3 or not a["institute"] or not b["institute"]:
                return True
        elif t > 0.7 or (t > 0.35 and p > 0.3) or (p > 0.5 and t > 0.25):
            return True
    if a["institute"] and a["institute"] == b["institute"] and t >= (0.6 if x and y else 0.85):
        return True
    return 0.6 * t + 0.4 * p >= 0.85


CASES = [
    (dict(title="Anything", institute="A", url="http://u/1"), dict(title="Else", institute="B", url="http://u/1"), True),
    (dict(title="Postdoc in yeast genetics", institute="MIT", pi_name="Ada Byron"), dict(title="Post-Doc in yeast genetics", institute="Massachusetts Institute of Technology", pi_name="ada byron"), True),
    (dict(title="Postdoc in yeast genetics", institute="MIT", pi_name="Ada Byron"), dict(title="Postdoc in yeast genetics", institute="MIT", pi_name="Bob Noyce"), False),
    (dict(title="100%, Basel, fixed-term", institute="", pi_name="Ada Byron"), dict(title="Yeast genomics", institute="ETH Zürich", pi_name="Ada Byron"), True),
    (dict(title="Postdoctoral fellow in protein design", institute="UCL", pi_name="Bock"), dict(title="Postdoctoral fellow in protein design", institute="KTH", pi_name="Bock"), True),
    (dict(title="Cell biology", institute="UCL", pi_name="Bock"), dict(title="Quantum optics", institute="KTH", pi_name="Bock"), False),
    (dict(title="Postdoc in yeast genetics and ageing", institute="ETH Zürich"), dict(title="Postdoc in yeast genetics and ageing", institute="ETH Zurich"), True),
    (dict(title="Postdoc in yeast genetics", institute="ETH Zurich"), dict(title="Postdoc in plant ecology", institute="ETH Zurich"), False),
    (dict(title="Postdoc in yeast genetics", institute="nature"), dict(title="Postdoc in yeast genetics", institute="indeed"), False),
    (dict(title="Research Fellow - Yeast Genetics Group", institute="University of Basel"), dict(title="Yeast Genetics Group", institute="University of Basel, Faculty of Science"), True),
    (dict(title="", institute=""), dict(title="", institute=""), False),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_two_postings(spark, k):
    a, b, want = CASES[k]
    found = dedup.deduplicated(jobs(spark, [a, b]), "k")
    assert found.count() == (1 if want else 2)


def test_normalised_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.dedup_title(F.lit("Post Doctoral  Researcher - cells"))) == one(X.dedup_title(F.lit("postdoc researcher: cells"))) == "cells"
    assert one(X.dedup_institute(F.lit("University of California, Davis"))) == "uc davis"
    assert one(X.dedup_institute(F.lit("LinkedIn"))) == one(X.dedup_institute(F.lit("Stipendier Sverige"))) == one(X.dedup_institute(F.lit(""))) == ""


def test_groups_equal_all_pairs(spark):
    rng = random.Random(3)
    words = "yeast plant cell gene protein design ageing optics quantum neural map fold".split()
    rows = []
    for k in range(160):
        if rows and rng.random() < 0.5:
            r = dict(rng.choice(rows))
            change = rng.choice(["title", "institute", "pi_name", "none", "url"])
            if change == "title":
                r["title"] += " " + rng.choice(words)
            elif change == "institute":
                r["institute"] = rng.choice(["", "ETH Zurich", r["institute"]])
            elif change == "pi_name":
                r["pi_name"] = rng.choice([None, "Ada Byron", "Bock"])
            if change != "url":
                r["url"] = f"http://u/{k}"
        else:
            r = dict(title="Postdoc in " + " ".join(rng.sample(words, 4)), institute=rng.choice(["ETH Zurich", "MIT", "KTH", "", "Basel"]), pi_name=rng.choice([None, None, "Bock", "Ada Byron", "Cy Young"]), url=f"http://u/{k}")
        rows.append(r | {"k": k, "description": "d" * rng.randrange(9), "source": rng.choice("xy"), "field": rng.choice([None, "", f"f{k}"])})
    df = jobs(spark, rows)
    ready = {r.k: r.asDict() for r in dedup.prepared(df, "k").collect()}
    blocks = {}
    for r in dedup.banded(dedup.prepared(df, "k"), "k", "text").collect():
        blocks.setdefault((r.band, r.digest), set()).add(r.k)
    for k, r in ready.items():
        for name in ("url", "person"):
            if r[name]:
                blocks.setdefault((name, r[name]), set()).add(k)
    root = {k: k for k in ready}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for held in blocks.values():
        for a, b in itertools.combinations(sorted(held), 2):
            if same(ready[a], ready[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {k: find(k) for k in ready}
    assert {r.k: r.grp for r in dedup.grouped(df, "k").select("k", "grp").collect()} == want
    assert 20 < len(set(want.values())) < 150

    def merge(a, b):  # two postings into one, the later into the earlier
        keep, other = (a, b) if len(a["description"]) >= len(b["description"]) else (b, a)
        out = dict(keep)
        for c in ("pi_name", "field"):
            out[c] = out.get(c) or other.get(c)
        if keep["source"] != other["source"] and out["pi_name"] and other.get("pi_name") and other["url"]:
            out["alt"] = [*keep.get("alt", []), (other["url"], other["source"])]
        return out

    fused = {}
    for r in rows:
        g = want[r["k"]]
        fused[g] = merge(fused[g], r) if g in fused else r
    got = dedup.deduplicated(df, "k").collect()
    assert {r.grp: (r.k, r.title, r.pi_name or "", r.field or "", [tuple(a) for a in r.alt_urls]) for r in got} == {
        g: (r["k"], r["title"], r.get("pi_name") or "", r.get("field") or "", r.get("alt", [])) for g, r in fused.items()
    }
    assert sum(r.merged for r in got) == len(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_postings(spark):
    assert dedup.deduplicated(jobs(spark, []), "k").count() == 0


def test_nearest_seed_in_blocks(spark, monkeypatch):
    import math

    from quillmark.operators import recommend

    monkeypatch.setattr(recommend, "SEED_BLOCK", 3)
    monkeypatch.setattr(recommend, "ROW_BLOCK", 7)
    rng = random.Random(2)
    vector = lambda: rng.choice([None, [], [0.0, 0.0], *([[rng.gauss(0, 1) for _ in range(rng.randrange(1, 5))]] * 6)])
    rows, seeds = [(k % 20, vector()) for k in range(30)], [(k, vector()) for k in range(10)]

    def cosine(a, b):
        a, b = a or [], b or []
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    a, b = (spark.createDataFrame(x, "k int, v array<double>") for x in (rows, seeds))
    got = sorted((r.k, round(r.best, 9)) for r in recommend.nearest_seed(a, b, "k", "v").collect())
    assert got == sorted((k, round(max(cosine(v, s) for _, s in seeds if s is not None), 9)) for k, v in rows)
    assert {r.best for r in recommend.nearest_seed(a, b.limit(0), "k", "v").collect()} == {0.0}


def test_unled_postings_meet_by_place(spark):
    """Pairs are made of postings that can be one; what they join is what all pairs of a band, leader or url join."""
    rng = random.Random(5)
    rows = []
    for k in range(160):
        title = f"{rng.choice(['large ring', 'small bolt'])} {rng.choice(['standard', 'economy'])} {rng.choice('abcd') * rng.randrange(1, 5)}"
        rows.append((k, f"http://x/{k if k % 9 else 0}", title, rng.choice(["", "Institute abcdef", "Institute abcdeg", "Other place"]), rng.choice([None, None, "Ada Low", "Bob Hay"])))
    jobs = spark.createDataFrame(rows, "k long, url string, title string, institute string, pi_name string")
    made = dedup.prepared(jobs, "k").cache()
    p = {r.k: r for r in made.collect()}
    bands = {}
    for r in dedup.banded(made, "k", "text").collect():
        bands.setdefault((r.band, r.digest), set()).add(r.k)
    def ratio(x, y):
        return SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    root = {k: k for k in p}
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    met = {(a, b) for held in bands.values() for a in held for b in held if a < b}
    met |= {(a, b) for a in p for b in p if a < b and ((p[a].person and p[a].person == p[b].person) or p[a].url == p[b].url)}
    for a, b in met:
        x, y = p[a], p[b]
        t, i = ratio(x.title, y.title), ratio(x.institute, y.institute)
        led, known = bool(x.person) and x.person == y.person, bool(x.person and y.person)
        one = led and (not x.institute or not y.institute or t > 0.3 or i > 0.3)
        there = x.institute and x.institute == y.institute and t >= (0.6 if known else 0.85)
        if x.url == y.url or one or (not (known and not led) and (there or 0.6 * t + 0.4 * i >= 0.85)):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.k: r.grp for r in dedup.grouped(jobs, "k").collect()} == {k: find(k) for k in p}


def test_bands_compare_titles_once(spark, monkeypatch):
    """Postings of two titles at one place make one pair, however many they are, and links are those of all their pairs."""
    monkeypatch.setattr(dedup, "SLICE", 3)
    rng = random.Random(8)
    titles = ["".join(rng.choice("ab ") for _ in range(rng.randrange(5, 12))) for _ in range(25)]
    held = [("b", k, t, rng.choice(["u", "u", "v"]), rng.choice(["", "", "ada", "bob"]), titles.index(t) % 9) for k, t in enumerate(rng.choices(titles, k=400))]
    places = [("u", "u", 1.0, 1.0), ("v", "v", 1.0, 1.0), ("u", "v", 0.9, 0.7), ("v", "u", 0.7, 0.9)]
    alike = {x[:2]: x[2] for x in places}
    found = dedup.titled(spark.createDataFrame(held, "block string, k long, title string, institute string, person string, root long"))
    rows = {(r.institute, r.title, r.root): r.kmin for r in found.collect()}
    assert rows == {c: min(h[1] for h in held if (h[3], h[2], h[5]) == c) for c in {(h[3], h[2], h[5]) for h in held}}
    pairs = dedup.title_pairs(found, spark.createDataFrame(places, "i string, j string, p double, q double"))
    made = [frozenset((r.kmin_a, r.kmin_b)) for r in pairs.collect()]
    open_ = [(x, y) for x, y in itertools.combinations(held, 2) if x[5] != y[5] and "" in (x[4], y[4])]
    name = lambda h: rows[h[3], h[2], h[5]]
    assert len(made) == len(set(made)) and set(made) == {frozenset((name(x), name(y))) for x, y in open_} and 10 * len(made) < len(open_)
    edit = lambda a, b: 1 - edits(a, b) / max(len(a), len(b))
    for likeness, plain, threshold in ((dedup.ratio, like, 0.85), (dedup.ratio, like, 0.95), (dedup.edit_likeness, edit, 0.7)):
        want = set()
        for x, y in open_:  # in the order of their keys
            t = plain(x[2], y[2])
            if (x[3] == y[3] and t >= 0.85) or 0.6 * t + 0.4 * alike[x[3], y[3]] >= threshold:
                want.add(frozenset((name(x), name(y))))
        got = {frozenset(r) for r in dedup.decided_titles(pairs, likeness, threshold).collect()}
        assert got == want and 0 < len(want) < len(made)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]
