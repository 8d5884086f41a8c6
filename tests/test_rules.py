"""Rules of reports and mails, and stores of postings and people, against plain Python."""

import datetime
import random
import re

from pyspark.sql import functions as F

from quillmark.functions import korean
from quillmark.operators import scoring, store

PROFILE = scoring.Profile(exclude=("history", "law"), student_titles=("phd student", "doctoral"), other_titles=("bachelor's", "nurse"), faculty_titles=("professor", "lecturer"), garbage_titles=("click here",), signals=("biolog", "genom"))
TODAY = datetime.date(2026, 6, 1)
COLUMNS = "k int, title string, field string, keywords string, description string, deadline string, posted string, region string, match_score double, tier int, institute string"


def postings(n):
    rng = random.Random(n)
    titles = ["Postdoc in yeast", "PhD student in cells", "Doctoral post-doc", "Nurse", "Research Fellow and nurse", "Professor of law", "Professor of cells", "Bachelor’s job", "Lecturer, postdoctoral", "Click here for posts", "short", "교수", "생명과학 연구원 모집", "은행 직원 모집합니다", "Post 2025 in cells", "Post 2027 in cells", "", None]
    pick = lambda *xs: rng.choice(xs)
    return [(k, rng.choice(titles), pick(None, "History of art", "genomics"), pick(None, "a law"), pick(None, "biology", "by law", "x"), pick(None, "", "2026-05-31", "2026-07-01", "soon"), pick(None, "2025-12-31", "2026-01-02", "bad"), pick(None, "US", "Korea"), pick(None, 0.0, 0.5), pick(None, 1, 3), None) for k in range(n)]


def plain_reason(r, bio):
    _, title, field, keywords, _, deadline, posted, region, *_ = r
    low = (title or "").lower()
    day = lambda x: datetime.date.fromisoformat(x) if x and re.fullmatch(r"\d{4}-\d\d-\d\d", x) else None
    research = any(w in low for w in scoring.RESEARCH_TITLES)
    if day(deadline) and day(deadline) < TODAY:
        return "expired"
    if any(int(y) < TODAY.year for y in re.findall(r"(?<!\d)(20\d{2})(?!\d)", low)):
        return "past year"
    if day(posted) and not deadline and day(posted).year < TODAY.year:
        return "stale"
    if any(w in " ".join(x or "" for x in (title, field, keywords)).lower() for w in PROFILE.exclude):
        return "keyword"
    for words, name in ((PROFILE.student_titles, "student"), (PROFILE.other_titles, "not research")):
        if any(w in low.replace("’", "'") for w in words):
            return None if research else name
    if any(w in low for w in PROFILE.faculty_titles) and region != "Korea" and not research:
        return "faculty"
    hangul = re.search("[가-힣]", low)
    if len(low.strip()) < (4 if hangul else 10):
        return "short"
    if any(w in low for w in PROFILE.garbage_titles):
        return "garbage"
    return "not of the field" if hangul and not bio else None


def plain_mail(r):
    _, title, field, keywords, description, _, _, region, score, tier, _ = r
    low, blob = (title or "").lower(), " ".join(x or "" for x in (title, field, keywords, description)).lower()
    research = any(w in low for w in scoring.RESEARCH_TITLES)
    if any(w in blob for w in PROFILE.exclude) or (any(w in low for w in PROFILE.other_titles) and not research):
        return False
    if any(w in low for w in PROFILE.faculty_titles) and region != "Korea" and not research:
        return False
    if len(low.strip()) < 10 or any(w in low for w in PROFILE.garbage_titles):
        return False
    return bool(score) or (tier or 9) <= 2 or any(w in blob for w in PROFILE.signals)


def test_rules(spark):
    rows = postings(800)
    df = spark.createDataFrame(rows, COLUMNS)
    got = df.select("k", scoring.left_out(df, PROFILE, F.lit(TODAY), korean.relevant("title")).alias("why"), scoring.worth_mailing(df, PROFILE).alias("mail"), korean.relevant("title").alias("bio")).collect()
    found = set()
    for r in got:
        assert r.why == plain_reason(rows[r.k], r.bio), rows[r.k]
        assert r.mail is plain_mail(rows[r.k]), rows[r.k]
        found.add(r.why)
    assert found == {None, "expired", "past year", "stale", "keyword", "student", "not research", "faculty", "short", "garbage", "not of the field"}
    few = df.select("k", "title")
    assert few.select(scoring.left_out(few, PROFILE, F.lit(TODAY)).alias("w"), scoring.worth_mailing(few, PROFILE)).count() == 800


def test_profile_from_yaml():
    got = scoring.Profile.from_yaml("keywords: [a]\nother_titles: [nurse]\nregions: {EU: 1}\n")
    assert (got.keywords, got.other_titles, got.regions, got.signals) == (("a",), ("nurse",), {"EU": 1}, ())


def test_store_of_postings(spark):
    kind = "url string, title string, institute string, status string"
    old = spark.createDataFrame([("a", "A", "ETH Zurich", "seen"), ("b", "B", "LinkedIn", "new"), ("c", "C", "Basel", "dismissed"), ("d", "D", None, None)], kind)
    new = [("a", "", "Indeed", "new", 1), ("a", "A2", None, "new", 2), ("b", None, "Indeed", None, 1), ("b", "B2", "KTH", "x", 2), ("b", "", "", "x", 3), ("c", "C2", "X", "new", 1), ("d", "D", "Glassdoor", "new", 1), ("e", "E", "indeed", "new", 1), ("f", "F", "x", "new", 1), (None, "N", "x", "new", 1)]
    table = spark.createDataFrame(new, kind + ", at int")
    gone = spark.createDataFrame([("f",), ("f",), ("a",)], "url string")
    got = {r.url: tuple(r)[1:] for r in store.upsert_jobs(old, table, gone, order=["at"]).collect()}
    assert got == {"a": ("A2", "ETH Zurich", "seen"), "b": ("B2", "KTH", "new"), "c": ("C", "Basel", "dismissed"), "d": ("D", "Glassdoor", None), "e": ("E", "indeed", "new")}


def test_store_of_people(spark):
    kind = "name string, institute string, h_index int, note string"
    old = spark.createDataFrame([("Ada", "ETH", 3, "x"), ("Ada", None, 4, "y"), ("Bob", "KTH", 5, None)], kind)
    new = spark.createDataFrame([("Ada", None, None, "", 2), ("Ada", None, 9, "z", 1), ("Ada", "ETH", 7, None, 1), ("Eve", None, 1, None, 1)], kind + ", at int")
    got = {(r.name, r.institute): (r.h_index, r.note) for r in store.upsert_people(old, new, order=["at"]).collect()}
    assert got == {("Ada", "ETH"): (7, "x"), ("Ada", None): (9, ""), ("Bob", "KTH"): (5, None), ("Eve", None): (1, None)}


def test_edges_count_merges(spark):
    old = spark.createDataFrame([(1, 2, 3, 3)], "a int, b int, shared int, recent int")
    new = spark.createDataFrame([(2, 1, 1, 1), (1, 2, 5, 2), (4, 3, 2, 3), (3, 4, 7, 4), (5, 6, 2, 5)], "a int, b int, shared int, at int")
    got = {(r.a, r.b): (r.shared, r.recent) for r in store.upsert_edges(old, new, order=["at"]).collect()}
    assert got == {(1, 2): (5, 5), (3, 4): (7, 3), (5, 6): (2, 2)}
