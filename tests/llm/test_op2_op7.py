import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import op2_url_filter as op2
from quillmark.llm import op7_secrets as op7
from tests.llm.conftest import SF


def brute_url(url, rules=op2.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    best = max(fits, key=len, default=None)
    return host, path, best, rules[best] if best else "allow"


def test_urls_match_brute_force_and_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in op2.query(pages).collect()}
    assert got == {r.page_id: brute_url(r.url) for r in pages.select("page_id", "url").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert {r[0]: r[1:] for r in c.execute(op2.SQL).fetchall()} == got


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://com/en/x", "ftp://A.EXAMPLE.com/en/7?x", "x://example.net/de/8#y", "a://b://net/de/", "http://xcom/en/", "http://u@net:80/de/", "http://a.net/de/80", "http://com?/en/", "http://org/es/", "h://É.org/es/", "http://" + "a." * 50_000 + "com/en/" + "z" * 100_000]
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)] + [(None, "http://com/en/", "v")] * 2, "page_id long, url string, verdict string")
    got = op2.query(pages).collect()
    assert {r.page_id: tuple(r)[1:] for r in got if r.page_id is not None} == {k: brute_url(u) for k, u in enumerate(urls)}
    assert sum(r.page_id is None for r in got) == 2 and op2.query(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", [1, 2, 5])
def test_ties_do_not_depend_on_files(spark, part):
    rules = {"com/abc": "block", "x.com/a": "allow", "y.x.com/": "block", "com/": "allow", "net/a": "block"}
    urls = {"h://x.com/abc": "x.com/a", "h://y.x.com/abc": "y.x.com/", "h://z.com/abc": "com/abc", "h://b.com/x": "com/", "h://net/": None}
    for some in (rules, dict(reversed(rules.items()))):
        pages = spark.createDataFrame([(u,) for u in urls], "url string")
        got = {r.url: (r.rule, r.verdict) for r in op2.judged(pages, some, part=part).collect()}
        assert got == {u: (rule, rules[rule] if rule else "allow") for u, rule in urls.items()}


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    texts = [f"word{chr(97 + k)} " + "x" * 5000 + f" short{chr(97 + k)}" for k in range(20)] + ["huge " * 10_000]
    docs = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,)], "text string")
    seen = []
    monkeypatch.setattr(op7, "train", lambda words: seen.append(words) or "model")
    assert op7.fit(docs) == "model" and len(seen[-1]) == 41
    monkeypatch.setattr(op7, "SAMPLE_BYTES", 20_000)
    op7.fit(docs)
    assert 6 <= len(seen[-1]) <= 8 and "huge" not in seen[-1]
    assert op7.fit(docs.where("text is null")) == "model" and seen[-1] == []


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(op2, "keys", lambda strings: np.array([len(s) % 3 for s in strings], np.uint64))
    rules = {f"h{k}.example/{'p' * (k % 5)}": "block" if k % 2 else "allow" for k in range(40)}
    (tmp_path / "list").write_bytes(op2.pack(rules))
    index = op2.Index(str(tmp_path / "list"))
    for r, v in rules.items():
        (at,) = index.find([r.encode()])
        assert index.string(at) == r.encode() and op2.VERDICTS[index.verdicts[at]] == v
    assert index.find([b"absent", b"", b"h1.example/"]).tolist() == [-1, -1, -1]


def brute_spans(text):
    """Base spans by the contract's words: all matches of the open patterns, then the failing ones dropped."""
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "ſecret", "toKen", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef00", "x" * 7, "=abc", "é", "\n", "\U0001f600"]), max_size=25))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    assert op7.base_spans(text) == brute_spans(text)


def test_secrets_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = op7.query(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute_spans(texts[r.doc_id])
        kinds = [k for _, k, _ in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, range(3)))
        assert r.base_sha256 == op7.digest(base)
        assert set(op7.listed(base).split(",")) <= set(r.spans.split(","))


def test_markov_separates_held_out_samples():
    words = sorted({w for t in ["the quick brown fox jumps over a lazy dog while reading interesting configuration values"] for w in t.split()})
    model = op7.train(words)
    random, ordinary = op7.labelled_samples(words, 2000, seed=99)
    assert np.mean([model.score(t) > model.threshold for t in random]) > 0.95
    assert np.mean([model.score(t) > model.threshold for t in ordinary]) < 0.01


def test_odd_secrets(spark):
    rows = [(1, None), (2, ""), (3, "\U0001f600 token=abcdef"), (None, "x"), (None, "x"), (4, "w " * 200_000 + "AKIA" + "A" * 16), (5, "key xK9pQ2vL8mN4rT7wZ3bY6cF1 end")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in op7.query(docs).collect()}
    assert op7.query(docs).count() == 7
    assert got[3].spans == "assign:2:14" and got[4].spans == "access:400000:400020" and got[5].spans == "markov:4:28"
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == op7.digest([])
    assert op7.query(docs.limit(0)).count() == 0
