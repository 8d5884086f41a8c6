"""Names of a table in texts."""

import random
import re

from quillmark.operators import gazetteer
from quillmark.plans import catalog
from tests.conftest import SF


def plain(text, names):
    """All (begin, end, name) on word boundaries, found one name after the other."""
    found = set()
    for name in names:
        words = re.findall(r"[^\W_]+", name)
        if words and text:
            pattern = r"(?<![^\W_])" + r"(?:[\W_]+)".join(map(re.escape, words)) + r"(?![^\W_])"
            at = 0
            while m := re.compile(pattern, re.IGNORECASE).search(text, at):
                found.add((m.start(), m.end(), name))
                at = m.start() + 1
    return found


def leftmost_longest(found):
    out, end = [], 0
    for b, e, n in sorted(found, key=lambda x: (x[0], -x[1])):
        if b >= end:
            out.append((b, e, n))
            end = e
    return out


def test_every_and_longest(spark, monkeypatch):
    monkeypatch.setattr(gazetteer, "PART", 40)  # several automata
    rng = random.Random(24)
    words = ["new", "york", "city", "san", "jose", "Köln", "a", "b"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(60)}, key=str.lower)
    texts = ["".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) + rng.choice([" ", ", ", "_", "\n", "x", "-"]) for _ in range(12)) for _ in range(80)] + ["", None, "...", "new  york"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    table = spark.createDataFrame([(n, "L" + n) for n in names] + [("", "x"), (None, "y"), ("?!", "z")], "name string, label string")
    every, long = {}, {}
    for out, found in ((every, gazetteer.matches(df, "i", "t", table, every=True)), (long, gazetteer.matches(df, "i", "t", table))):
        for r in found.collect():
            assert r.label == "L" + r.name
            out.setdefault(r.i, []).append((r.begin, r.end, r.name))
    for i, t in enumerate(texts):
        assert set(every.get(i, [])) == plain(t, names), t
        assert long.get(i, []) == leftmost_longest(plain(t, names)), t


def test_countries(spark):
    names = gazetteer.country_names(spark, ["ca", "in"], ["boston"], {"germany": "Germany", "in": "India", "republic of korea": "South Korea", "korea": "Korea", "south korea": "South Korea"})
    texts = ["Berlin, Germany", "Palo Alto, CA", "Boston, Germany", "Republic of  Korea", "Korea (South Korea)", "Lab in Basel", "California", "", None, "Gary, IN 46401"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.country for r in gazetteer.countries(df, "i", "t", names).collect()}
    assert got == {0: "Germany", 1: "United States", 2: "United States", 3: "South Korea", 4: "South Korea", 5: "India", 9: "United States"}


def test_plan_does_not_grow(spark):
    df = spark.createDataFrame([(1, "x")], "i int, t string")
    plans = [gazetteer.matches(df, "i", "t", spark.createDataFrame([(f"name {k}", "x") for k in range(n)], "name string, label string"))._jdf.queryExecution().toString() for n in (2, 5000)]
    assert abs(len(plans[0]) - len(plans[1])) < 50


def test_query_has_names_in_all_texts(spark):
    assert catalog.QUERIES["g20_gazetteer"](spark, SF).count() > 0
