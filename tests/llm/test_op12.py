import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from quillmark.llm import op12_divergence as op12
from tests.llm.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, term string, part int"


def brute(rows, top=200):
    """All terms, sources and pairs, one by one."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= 3]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        mine = share(counts[lang, source])
        whole = share(sum((c for (g, _), c in counts.items() if g == lang), Counter()))
        pairs = [(other, sum(f(mine[t], q) for t, q in share(counts[lang, other]).items())) for g, other in groups if g == lang and other != source]
        terms = [(t, f(mine[t], whole[t])) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                out.append((lang, source, part, item, value, k + 1))
    return sorted(out)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(op12.SQL).fetchall())
    got = sorted(map(tuple, op12.query(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
    assert got == want and {r[2] for r in got} == {"pair", "term"}


def test_random_tables_match_brute_force(spark):
    rng = random.Random(12)
    words = ["a", "B", "Äpfel", "ÄPFEL", "x1y", "no_no", "的", "b", "rare" + "x" * 300, "\u0085"]
    rows = [(i % 50, " ".join(rng.choices(words, range(10, 0, -1), k=rng.randrange(9))), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", None])) for i in range(300)]
    rows += [(None, None, "en", "empty"), (1, "", "fr", "only"), (2, "one\ttwo", "it", "p"), (2, "one\ttwo", "it", "q")] + [(7, "same same row", "es", "s")] * 3
    rows = [(*r, "clash", 1) for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, op12.divergence(docs, top=5).collect()))
    assert got == brute([r[1:4] for r in rows], 5)
    assert op12.divergence(docs.limit(0)).collect() == []


def test_long_text_and_one_source(spark):
    rows = [(i, "word " * 400_000 + "end", "en", "s", "", 0) for i in range(3)]
    got = sorted(map(tuple, op12.divergence(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == []  # no other source, and no share above the language's


def test_terms_stay_within_texts():
    at, terms = op12.terms_of(pa.array(["ab", "cd e", None, "", "\x00F1g", "zü"])[1:])
    assert list(zip(at.tolist(), terms.to_pylist())) == [(0, "cd"), (0, "e"), (3, "f"), (3, "g"), (4, "zü")]
