"""Pages as tables of nodes, against walks over a plain tree."""

from html.parser import HTMLParser

from quillmark.plans import catalog
from quillmark.sources import nodes
from tests.conftest import SF

POST = """<html><head><title>x</title><style>p{a:b}</style></head><body>
<ul id="menu"><li>One<li>Two <b>bold</b></ul>
<table class="board"><tr><th>Institute<td>ETH Zurich<tr><th>Deadline:</th><td> 2026-03-01 <br> 18:00 </td></tr></table>
<dl><dt>Place<dd>Basel<dt>Pay<dd>80,000 <i>CHF</i></dl>
<div class="row card"><h2>First post</h2><a href="#top">up</a><a href="/jobs/1">read</a></div>
<div class="row"><h2>Second post</h2><span onclick="go('/jobs/2'); return false">read</span></div>
<div class="row"><h2>Third post</h2><form action="/jobs?id=3"><input name=q></form></div>
<div class="row"><h2>Fourth post</h2><a href="javascript:void(0)">read</a></div>
<p>Contact person:<p>Ada Byron</p><p>Start: as soon as possible</p><p>https://lab.example.org/x</p>
<script>var x = "<p>Not: shown</p>";</script></body></html>"""


def table(spark, *pages):
    return nodes.nodes(spark.createDataFrame(list(enumerate(pages)), "k int, h string"), "k", "h").cache()


def test_tree(spark):
    rows = {r.node: r for r in table(spark, POST).collect()}
    assert sorted(rows) == list(range(len(rows)))
    for r in rows.values():
        if r.node:
            p = rows[r.parent]
            assert p.node < r.node <= r.last <= p.last
        inside = [x.node for x in rows.values() if r.node < x.node <= r.last]
        assert inside == list(range(r.node + 1, r.last + 1))
        places = [x.place for x in sorted(rows.values()) if x.parent == r.node]
        assert sorted(places) == list(range(len(places)))
    li = [r for r in rows.values() if r.tag == "li"]
    assert len(li) == 2 and {rows[r.parent].tag for r in li} == {"ul"}  # an item ends the one before
    assert [rows[r.parent].tag for r in rows.values() if r.tag in ("td", "th")] == ["tr"] * 4
    assert not any("shown" in (r.text or "") for r in rows.values())


def test_selection_texts_and_targets(spark):
    t = table(spark, POST, None, "", "<div class=row><div class=row>in</div></div>")
    rows = nodes.selected(t, "k", nodes.having("div", cls="row"))
    said = {(r.k, r.node): r.text for r in nodes.texts(t, "k", rows).collect()}
    assert [said[k] for k in sorted(said)] == ["First post\nup read", "Second post\nread", "Third post", "Fourth post\nread", "in", "in"]
    got = [(r.target, r.how) for r in nodes.targets(t, "k", rows).orderBy("k", "node").collect()]
    assert got == [("/jobs/1", "link"), ("/jobs/2", "onclick"), ("/jobs?id=3", "form")]
    inner = nodes.selected(t, "k", nodes.having(cls="row"), nodes.having("div"))
    assert inner.count() == 1 and nodes.selected(t, "k", nodes.having(name="menu"), nodes.having("li"), nodes.having("b")).count() == 1
    assert sorted(r.k for r in t.where("node = 0").collect()) == [0, 2, 3]


def test_pairs(spark):
    got = [(r.label, r.value, r.kind) for r in nodes.pairs(table(spark, POST), "k").orderBy("node", "kind").collect()]
    cells = [x[:2] for x in got if x[2] == "cell"]
    assert cells == [("Institute", "ETH Zurich"), ("Deadline", "2026-03-01\n18:00"), ("Place", "Basel"), ("Pay", "80,000 CHF")]
    lines = {x[0]: x[1] for x in got if x[2] == "line"}
    assert lines["Contact person"] == "Ada Byron" and lines["Start"] == "as soon as possible" and "https" not in lines


def test_descriptions(spark):
    long = "word " * 60
    pages = [
        f"<div class='job-description x'>{long}A</div><article>{long}{long}</article>",
        f"<article><p>{long}</p><p>B</p></article><div>{long * 3}</div>",
        f"<table><tr><td>{long}</td><td>C</td></tr></table><div>short</div>",
        f"<div><div><div>{long * 4}D</div></div><div>little</div></div>",
        "<div>too short</div>",
        f"<div class='description'>short</div><main>{long}E</main>",
    ]
    got = {r.k: (r.how, r.text[-1]) for r in nodes.descriptions(table(spark, *pages), "k").collect()}
    assert got == {0: ("known", "A"), 1: ("main", "B"), 2: ("table", "C"), 3: ("block", "D"), 5: ("main", "E")}
    cut = nodes.descriptions(table(spark, f"<main>{long * 100}</main>"), "k", most=500).first()
    assert len(cut.text) == 500


class _Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.words += data.split()


def test_query_takes_the_articles(spark):
    got = {r.page_id: r for r in catalog.QUERIES["n03_page_descriptions"](spark, SF).collect()}
    seen = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page = _Article()
        page.feed(r.html or "")
        if sum(map(len, page.words)) > 400:
            seen += 1
            assert got[r.page_id].how == "main" and got[r.page_id].text.split()[:2000] == " ".join(page.words)[:40_000].split()[:2000] or len(got[r.page_id].text) == nodes.MOST
    assert seen > 10
