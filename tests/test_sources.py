from datetime import date

from pyspark.sql import functions as F

from quillmark.functions import dates
from quillmark.operators import report, scoring
from quillmark.sources import feeds
from quillmark.sources.captured import CapturedPages
from tests.test_library import one


def test_captured_pages(spark, tmp_path):
    for q, p in (("a", 1), ("a", 2), ("b", 1)):
        (tmp_path / f"{q}-{p}.html").write_text(f"<p>{q}{p}</p>")
    spark.dataSource.register(CapturedPages)
    found = spark.read.format("captured").option("folder", str(tmp_path)).option("queries", "a,b").option("pages", "2").load()
    assert sorted((r.query, r.page, r.html) for r in found.collect()) == [("a", 1, "<p>a1</p>"), ("a", 2, "<p>a2</p>"), ("b", 1, "<p>b1</p>")]
    broken = spark.read.format("captured").option("fetch", "quillmark.absent:get").option("queries", "a").load()
    assert [r.error.split(":")[0] for r in broken.collect()] == ["ModuleNotFoundError"]


def test_rss_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>u</link></item><item><title>B</title></item></channel></rss>")
    assert sorted(r.title for r in feeds.rss(spark, str(tmp_path / "f.xml")).collect()) == ["A", "B"]


def test_dates(spark):
    as_of = F.lit("2026-06-01").cast("date")
    assert one(spark, dates.parse(F.lit("3rd March 2026"))) == date(2026, 3, 3)
    assert one(spark, dates.parse(F.lit("no date"))) is None
    assert one(spark, dates.without_year(F.lit("1 July"), as_of)) == date(2026, 7, 1)
    assert one(spark, dates.without_year(F.lit("5 Nov"), F.lit("2026-12-31").cast("date"))) == date(2026, 11, 5)
    assert one(spark, dates.without_year(F.lit("5 January"), F.lit("2026-12-31").cast("date"))) == date(2027, 1, 5)
    assert one(spark, dates.korean(F.lit("접수 26. 3. 1 ~ 26.4.15"))) == date(2026, 4, 15)
    assert one(spark, dates.relative(F.lit("30+ days ago"), as_of)) == date(2026, 5, 2)
    colours = {None: None, -5: "AAAAAA", 0: "CC0000", 45: "D17A71", 90: "D6F4E2", 400: "D6F4E2"}
    assert {n: one(spark, dates.urgency_colour(F.lit(n).cast("int"))) for n in colours} == colours


def test_report_sink_and_email(spark, tmp_path):
    jobs = spark.createDataFrame([("u1", "US", 1, False, date(2026, 6, 5), 0.5), ("u2", "Japan", None, True, None, 0.1)], "url string, region string, tier int, is_company boolean, deadline date, score double")
    rows = report.rows(jobs, F.lit("2026-06-01").cast("date"))
    report.write_sheets(rows, str(tmp_path / "out"))
    back = {r.url: (r.sheet, r.tier_label, r.days_left) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {"u1": ("US", "T1", 4), "u2": ("Other", "Company", None)}
    assert "&lt;b&gt;" in report.email([("<b>", 1)], [("t", "http://x?a=1&b=2")], "x")


def test_profile_and_order(spark):
    profile = scoring.Profile.from_yaml("keywords: [yeast]\nexclude: [physics]\n")
    assert profile.keywords == ("yeast",) and profile.exclude == ("physics",) and profile.regions["US"] == 1
    jobs = spark.createDataFrame([("b", "EU", 1, 5, "yeast"), ("a", "US", 2, None, ""), ("c", "US", 1, 9, "")], "url string, region string, tier int, h_index int, title string").withColumns({"field": F.lit(""), "description": F.lit("")})
    assert [r.url for r in scoring.ranked(scoring.scored(jobs, profile), profile).collect()] == ["c", "a", "b"]


def test_cards_and_registered_functions(spark):
    from quillmark.functions.register import register

    register(spark)
    page = '<ul><li class="job x"><h4><a href="/1">First <b>job</b></a></h4>Paris<br>now</li><li class="ad">no</li><li class="job"><a href="/2">Second</a></li></ul>'
    spark.createDataFrame([(1, page), (2, "<p>nothing</p>"), (3, None)], "k int, html string").createOrReplaceTempView("listing")
    got = spark.sql("SELECT k, c.* FROM listing, LATERAL parse_cards(html, 'div.job|li.job') c ORDER BY href").collect()
    assert [tuple(r) for r in got] == [(1, "/1", "First job", "First job Paris now"), (1, "/2", "Second", "Second")]
    row = spark.sql("SELECT norm_text('  A  b ') a, cosine_sim(array(1D, 0D), array(1D)) b, seq_ratio('abc', 'abd') c, strip_accents('é') d").first()
    assert (row.a, row.b, round(row.c, 3), row.d) == ("a b", 1.0, 0.667, "e")


def test_sqlite_and_workbook(spark, tmp_path):
    import sqlite3

    from quillmark.sources.tables import SqliteTable, read_workbook, write_workbook

    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("CREATE TABLE jobs (id INTEGER PRIMARY KEY, title TEXT, score REAL)")
    db.executemany("INSERT INTO jobs VALUES (?, ?, ?)", [(k, f"t{k} <&>", k / 2) for k in range(9)])
    db.commit()
    spark.dataSource.register(SqliteTable)
    found = spark.read.format("sqlite_table").option("path", str(tmp_path / "s.db")).option("dbtable", "jobs").option("partitions", "3").load()
    assert sorted((r.id, r.title, r.score) for r in found.collect()) == [(k, f"t{k} <&>", k / 2) for k in range(9)]
    write_workbook({"US": found.orderBy("id"), "EU": found.limit(0)}, str(tmp_path / "w.xlsx"))
    back = read_workbook(str(tmp_path / "w.xlsx"))
    assert back["US"][0] == ["id", "title", "score"] and back["US"][3] == ["2", "t2 <&>", "1.0"] and len(back["EU"]) == 1


def test_more_text_functions(spark):
    from quillmark.functions import extract
    from quillmark.functions import text as X

    a, b = X.split_preferred(F.lit("Degree in biology; Python is a plus; patience"))
    assert (one(spark, a), one(spark, b)) == ("Degree in biology; patience", "Python is a plus")
    a, b = X.split_preferred(F.lit("A degree.\nPreferred: CRISPR"))
    assert (one(spark, a), one(spark, b)) == ("A degree.", "CRISPR")
    assert one(spark, X.merge_distinct([F.lit("A b"), F.lit("a B"), F.lit(""), F.lit(None).cast("string"), F.lit("c")])) == "A b; c"
    assert one(spark, X.without_boilerplate(F.lit("Great job\nshow more\nGreat job\ntext"), ["^show more"])) == "Great job\ntext"
    assert one(spark, X.url_score(F.lit("https://bio.uni.edu/lab"), F.lit("uni.edu"), ["lab"])) == 6
    assert one(spark, X.full_name(F.lit("Ada Lovelace"))) and not one(spark, X.full_name(F.lit("A Lovelace")))
    assert one(spark, X.slug_words(F.lit("https://x.org/u/university-of-basel.html?q=1"))) == "University Of Basel"
    got = spark.range(1).select(*(c.alias(n) for n, c in extract.label_columns(F.lit("Full-time, fixed-term; PhD with CRISPR and Python")).items())).first()
    assert tuple(got) == ("Full-time, Fixed-term", "Doctorate", "Python, CRISPR")


def test_entry_without_training_data(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quillmark", tmp_path / "quillmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_structured_data_in_lists_and_graphs(spark):
    job = lambda t: '{"@type": "JobPosting", "title": "%s", "hiringOrganization": {"name": "x"}}' % t
    script = lambda body: f'<script type="application/ld+json">{body}</script>'
    html = script(job("one")) + script("[" + job("two") + ', {"@type": "Thing"}]') + script('{"@graph": [{"@type": "Org"}, ' + job("three") + "]}") + script(job("four").replace('"JobPosting"', '["JobPosting", "Thing"]')) + script("not json")
    df = spark.createDataFrame([(1, html), (2, None)], "k long, html string")
    assert sorted(r.title for r in feeds.postings(df, "html").collect()) == ["four", "one", "three", "two"]


def test_articles_in_full(spark):
    xml = "<S><PubmedArticle><PMID>7</PMID><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract><PubDate><Year>2024</Year><Month>05</Month></PubDate><Author><LastName>L</LastName><ForeName>F</ForeName><AffiliationInfo><Affiliation>MIT</Affiliation></AffiliationInfo></Author></PubmedArticle></S>"
    r = feeds.articles(spark.createDataFrame([(xml,)], "xml string"), "xml").first()
    assert (r.pmid, r.abstract, r.published, r.affiliations, r.last_author) == ("7", "a b", "2024-05", ["MIT"], "L")


def test_a_failing_source_does_not_stop_the_rest(spark):
    def bad():
        raise OSError("gone")

    found, failed = feeds.gathered({"a": lambda: spark.range(2), "b": bad, "c": lambda: spark.range(1).select("nothing")})
    assert found.count() == 2 and set(failed) == {"b", "c"} and failed["b"] == "OSError: gone"
    assert feeds.gathered({"b": bad})[0] is None
