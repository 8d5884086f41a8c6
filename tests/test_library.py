from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import extract
from quillmark.functions import text as X
from quillmark.operators import dedup, graph, lookup, recommend, store
from quillmark.sources import html
from quillmark.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("Deadline: 2026-03-15.", "2026-03-15"),
        ("Apply by March 3, 2026 or 1 April 2026", "2026-03-03"),
        ("The closing date is 5th May 2026", "2026-05-05"),
        ("Applications must be received by 2026/01/09", "2026-01-09"),
        ("Started on 2024-01-01. No end.", None),
        ("Deadline 2026-13-40", None),
    ],
)
def test_deadline(text, want):
    assert extract.deadline(text) == want


def test_sections_and_fields():
    text = (
        "The Smith Lab studies how cells decide what they become and when.\nRequirements:\nA doctorate and patience with cells.\n"
        "We offer:\nUSD 60,000 - 65,000 per year for 2 years.\nHow to apply:\nSend a letter to jobs@lab.example.org by the deadline 2026-02-01. More at https://lab.example.org/jobs."
    )
    got = extract.fields(text)
    assert got["requirements"] == "A doctorate and patience with cells."
    assert got["summary"].startswith("The Smith Lab")
    assert (got["contact_email"], got["deadline"], got["duration"]) == ("jobs@lab.example.org", "2026-02-01", "2 years")
    assert got["info_urls"] == ["https://lab.example.org/jobs"] and got["salary"].startswith("USD 60,000")
    assert extract.fields("group of Prof. Ada Lovelace is hiring")["leader"] == "Ada Lovelace"
    assert extract.fields(None) == {} and extract.fields("") == {}


@given(st.text(max_size=200))
def test_extractors_take_any_text(text):
    assert set(extract.fields(text)) <= set(extract.NAMES)
    html.parse(text)
    X.html_to_text(text)


def test_normalisation(spark):
    assert one(spark, X.norm_title(F.lit("Post-Doctoral  fellow in Synthetic Biology"))) == "synthetic biology"
    assert one(spark, X.norm_title(F.lit("Postdoc: cells"))) == "postdoc: cells"
    assert one(spark, X.norm_institute(F.lit("The Université de Genève, Inc."))) == "universite de geneve"
    assert one(spark, X.clean_list(F.lit("- one\n- two\n3) three"))) == "one; two; three"
    assert one(spark, X.clean_text(F.lit("<b>a</b>\n---\n**b**  c"))) == "a | b c"
    assert one(spark, X.keyword_score(F.lit("Yeast and CRISPR"), ["crispr", "yeast", "phage"])) == 0.667
    assert one(spark, X.first_date(F.lit("2026-05-01 or 2025-12-31 or 2025-99-99"))) == date(2025, 12, 31)
    assert one(spark, X.strip_accents(F.lit("Łódź é"))) == "Łodz e"
    assert one(spark, X.strip_html(F.lit("<p>a<script>x</script></p><p>b &amp; c</p>"))) == "a\nb & c"
    assert one(spark, X.is_garbage_title(F.lit("박사후연구원"))) is False and one(spark, X.is_garbage_title(F.lit("short"))) is True


def test_page():
    page = html.parse("<title>T</title><table><tr><th>Field:</th><td>Bio <a href='/x'>more</a></td></tr></table><dl><dt>Country<dd>FR</dl>")
    assert page.title == "T" and page.pairs["Field"].startswith("Bio") and page.links == [("/x", "more")]


def test_upsert(spark):
    old = spark.createDataFrame([("a", "x", "I"), ("b", "", "J"), ("c", "z", None)], "k string, v string, inst string")
    new = spark.createDataFrame([("a", "", "agg"), ("b", "y", ""), ("d", "w", "K"), ("t", "t", "t")], "k string, v string, inst string")
    gone = spark.createDataFrame([("t",)], "k string")
    got = {tuple(r) for r in store.upsert(old, new, "k", keep=("inst",), tombstones=gone).collect()}
    assert got == {("a", "x", "I"), ("b", "y", "J"), ("c", "z", None), ("d", "w", "K")}
    assert store.upsert(old, new.limit(0), "k").count() == 3


def test_lookup_first_match_and_both_ways(spark):
    df = spark.createDataFrame([("mit media lab",), ("oxford",), (None,), ("nowhere",)], "inst string")
    rules = lookup.rules_table(spark, [("university of oxford", "1"), ("media", "2"), ("mit", "3")])
    got = {r.inst: r.label for r in lookup.first_match(df, "inst", rules, both_ways=True, least=5).collect()}
    assert got == {"mit media lab": "2", "oxford": "1", None: None, "nowhere": None}


def test_graph(spark):
    edges = graph.symmetric(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 4)], "a long, b long"), "a", "b")
    assert {tuple(r) for r in graph.within_hops(edges, spark.range(1, 2).toDF("node"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_decide_and_fuse(spark):
    def decide(ta, tb, ia, ib, pa, pb):
        a, b = ({"url": F.lit(""), "institute": F.lit(i), "person": F.lit(p)} for i, p in ((ia, pa), (ib, pb)))
        return one(spark, dedup.same_posting(dedup.ratio(F.lit(ta), F.lit(tb)), dedup.ratio(F.lit(ia), F.lit(ib)), a, b))

    assert decide("postdoc in yeast", "postdoc in yeast", "mit", "", "ada b", "ada b")
    assert not decide("same title", "same title", "mit", "mit", "ada b", "bob c")
    assert decide("postdoc in yeast genetics", "postdoc in yeast genetics", "mit", "mit", "", "")
    df = spark.createDataFrame([(1, 1, "short", None), (1, 2, "much longer", ""), (1, 3, "x", "pi"), (2, 4, "y", None)], "g long, k long, d string, p string")
    got = {tuple(r) for r in dedup.fuse(df, "g", "k", "d", ["p"]).collect()}
    assert got == {(1, 2, "much longer", "pi", 3), (2, 4, "y", None, 1)}


def test_cosine(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, recommend.cosine(a(1.0, 0.0), a(1.0, 0.0, 0.0))) == 1.0
    assert one(spark, recommend.cosine(a(0.0, 0.0), a(1.0, 2.0))) == 0.0


def test_breaker(spark):
    log = spark.createDataFrame([("s", i, x) for i, x in enumerate("okffffo".replace("k", "o"))], "source string, at long, status string")
    got = [r.open for r in jobs.breaker(log, "source", ["at"], F.col("status") == "f", 3).orderBy("at").collect()]
    assert got == [False, False, False, False, False, True, False]
