"""Fusion in the order of arrival, against the five steps in plain Python."""

import hashlib
import random

import pytest

from quillmark.operators import dedup, greedy
from tests.test_dedup import COLUMNS, jobs, like, same

P = (1 << 31) - 1


def buckets(text):
    parts = {text[i : i + 3] for i in range(max(1, len(text) - 2))}
    xs = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % P for s in parts]
    least = [min(((k * 1_103_515_245 % P + 1) * x + k * 12_345_677 % P) % P for x in xs) for k in range(1, 129)]
    return [",".join(map(str, least[b * 8 : b * 8 + 8])) for b in range(16)]


def decided(a, b):
    """The decision without the rule for one leader at one place, which is a step of its own here."""
    if a["person"] and a["person"] == b["person"] and a["institute"] and a["institute"] == b["institute"] and not (a["url"] and a["url"] == b["url"]):
        t, p = like(a["title"], b["title"]), like(a["institute"], b["institute"])
        words = a["person"].split()
        full = len(words) >= 2 and all(len(w) > 1 for w in words)
        return bool((full and (t > 0.3 or p > 0.3)) or (not full and (t > 0.7 or (t > 0.35 and p > 0.3) or (t > 0.25 and p > 0.5))) or t >= 0.6 or 0.6 * t + 0.4 * p >= 0.85)
    return same(a, b)


def in_order(rows):
    """{k: key of the slot's first posting}; every earlier slot is looked at, in order."""
    slots, out = [], {}
    for job in rows:
        job = {**job, "buckets": buckets(f"{job['title']} {job['institute']} {job['person']}")}
        hit = next((s for s in slots if job["url"] and s["keys"]["url"] == job["url"]), None)
        if hit is None and job["person"] and job["institute"]:
            met = [s for s in slots if (s["keys"]["person"], s["keys"]["institute"]) == (job["person"], job["institute"])]
            if met and like(job["title"], met[-1]["now"]["title"]) > 0.4:
                hit = met[-1]
        if hit is None and job["person"]:
            hit = next((s for s in slots if s["keys"]["person"] == job["person"] and decided(job, s["now"])), None)
        if hit is None:
            hit = next((s for s in slots if any(x == y for x, y in zip(s["keys"]["buckets"], job["buckets"])) and decided(job, s["now"])), None)
        if hit is None:
            slots.append({"keys": job, "now": job})
            hit = slots[-1]
        else:
            old = hit["now"]
            best, other = (job, old) if job["size"] > old["size"] else (old, job)
            hit["now"] = {**best, "person": best["person"] or other["person"]}
        out[job["k"]] = hit["keys"]["k"]
    return out


@pytest.fixture(scope="module")
def posts():
    rng = random.Random(306)
    stems = [" ".join(rng.choice("yeast plant cell gene protein virus brain immune marine soil enzyme tumour".split()) for _ in range(4)) for _ in range(150)]
    rows = []
    for k in range(2000):
        stem = rng.choice(stems).split()
        if rng.random() < 0.4:
            stem[rng.randrange(4)] = rng.choice(["ageing", "design", "models"])
        name = rng.choice([None, "", "Ada Byron", "Grace Hopper", "bock", "Bock", "L Meitner", f"Noa Nr{rng.randrange(40)}"])
        rows.append(dict(k=k, url=rng.choice([None, f"http://j/{rng.randrange(1500)}"]), title=rng.choice(["Postdoc: ", "Post-doctoral fellow in ", ""]) + " ".join(stem), institute=rng.choice(["", None, "ETH Zurich", "University of Basel", "University of Basle", f"Institute {rng.randrange(60)}"]), pi_name=name, description="d" * rng.randrange(30), field=None, source=f"s{k % 3}"))
    return rows


def test_order_of_arrival(spark, posts):
    table = jobs(spark, posts)
    plain = {r.k: r for r in dedup.prepared(table, "k").collect()}
    rows = [dict(k=k, url=plain[k].url, title=plain[k].title, institute=plain[k].institute, person=plain[k].person, size=len(posts[k]["description"])) for k in sorted(plain)]
    want = in_order(rows)
    assert {r.k: r.grp for r in greedy.ordered_groups(table, "k").collect()} == want and 100 < len(set(want.values())) < 1900
    shuffled = table.repartition(7, "description")
    assert {r.k: r.grp for r in greedy.ordered_groups(shuffled, "k").collect()} == want
    fused = dedup.deduplicated(table, "k", order="greedy").collect()
    assert len(fused) == len(set(want.values())) and sum(r.merged for r in fused) == 2000
    assert len(fused) != dedup.deduplicated(table, "k").count()  # components join more


def test_slots_know_their_first_posting_only(spark):
    rows = [
        dict(url="http://a", title="Postdoc in yeast genetics and ageing", institute="ETH Zurich", description="long enough"),
        dict(url="http://b", title="Postdoc in yeast genetics and ageing", institute="ETH Zurich", description="x"),
        dict(url="http://b", title="Unlike anything that came before it", institute="KTH", description=""),
    ]
    assert [r.grp for r in greedy.ordered_groups(jobs(spark, rows), "k").orderBy("k").collect()] == [0, 0, 2]
    assert [r.grp for r in dedup.grouped(jobs(spark, rows), "k").orderBy("k").collect()] == [0, 0, 0]


def test_same_is_the_decision(posts):
    rng = random.Random(5)
    for _ in range(4000):
        a, b = ({"url": p["url"] or "", "title": p["title"].lower(), "institute": (p["institute"] or "").lower(), "person": (p["pi_name"] or "").lower()} for p in rng.sample(posts, 2))
        x, y = (greedy.Posting(0, v["url"], v["title"], v["institute"], v["person"], 0) for v in (a, b))
        assert greedy.same(x, y) is decided(a, b)


def test_odd_components(spark):
    none = jobs(spark, []) if False else spark.createDataFrame([], COLUMNS)
    assert greedy.ordered_groups(none, "k").collect() == []
    rows = [dict(title=None, institute=None)] * 3 + [dict(url="http://a", title="t")] * 4
    assert sorted(r.grp for r in greedy.ordered_groups(jobs(spark, rows), "k").collect()) == [0, 1, 2, 3, 3, 3, 3]
    with pytest.raises(ValueError, match="more than 3"):
        greedy.ordered_groups(jobs(spark, rows), "k", most=3)
