"""Report tables, exclusion rules, dates and feeds, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import dates
from quillmark.operators import report, scoring
from quillmark.plans.catalog import query
from quillmark.session import table
from quillmark.shared import spread
from quillmark.sources import feeds

AS_OF = "1999-01-01"


def _as_of():
    return F.lit(AS_OF).cast("date")


def _jobs(spark, d):
    """Postings made of orders and their customers' nations and regions."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    region = F.when(F.col("r_name") == "AMERICA", "US").when(F.col("r_name") == "EUROPE", "EU").when(F.col("r_name") == "ASIA", "Asia").otherwise("Other")
    placed = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.select(
        F.concat(F.lit("u"), "o_orderkey").alias("url"), region.alias("region"), (F.col("o_custkey") % 6).cast("int").alias("tier"), (F.col("c_mktsegment") == "BUILDING").alias("is_company"),
        F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("deadline"), "o_totalprice", F.col("o_totalprice").alias("score"), "c_mktsegment", "o_orderkey",
    )


_JOBS = """
WITH j AS (SELECT 'u' || o_orderkey AS url, CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'EUROPE' THEN 'EU' WHEN 'ASIA' THEN 'Asia' ELSE 'Other' END AS region, (o_custkey % 6)::INT AS tier,
 c_mktsegment = 'BUILDING' AS is_company, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS deadline, o_totalprice AS score, c_mktsegment, o_orderkey
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query(
    "l01_report_rows",
    _JOBS
    + """SELECT url, sheet, tier_label, coalesce(date_diff('day', DATE '1999-01-01', deadline), -9999)::INT AS days_left, rank FROM (SELECT *, CASE WHEN region IN ('US', 'EU', 'Korea') THEN region ELSE 'Other' END AS sheet,
 CASE WHEN is_company THEN 'Company' WHEN tier BETWEEN 1 AND 4 THEN 'T' || tier ELSE '' END AS tier_label,
 row_number() OVER (PARTITION BY CASE WHEN region IN ('US', 'EU', 'Korea') THEN region ELSE 'Other' END ORDER BY CASE WHEN is_company THEN 0 ELSE tier END, score DESC, url) AS rank FROM j)""",
)
def l01(spark, d):
    return report.rows(_jobs(spark, d), _as_of()).select("url", "sheet", "tier_label", F.coalesce("days_left", F.lit(-9999)).alias("days_left"), F.col("rank").cast("long").alias("rank"))


@query(
    "l02_dashboard",
    _JOBS
    + """SELECT region, tier, c_mktsegment, grouping_id(region, tier, c_mktsegment)::BIGINT AS level, count(*) AS n, count(*) FILTER (WHERE x BETWEEN 0 AND 7) AS week, count(*) FILTER (WHERE x BETWEEN 8 AND 30) AS month,
 count(*) FILTER (WHERE x > 30) AS later, count(*) FILTER (WHERE x IS NULL) AS undated FROM (SELECT *, date_diff('day', DATE '1999-01-01', deadline) AS x FROM (SELECT * REPLACE ('t' || tier AS tier) FROM j)) GROUP BY GROUPING SETS ((region), (tier), (c_mktsegment), ())""",
)
def l02(spark, d):
    jobs = _jobs(spark, d).withColumn("tier", F.concat(F.lit("t"), "tier"))
    return report.dashboard(jobs, _as_of(), ["region", "tier", "c_mktsegment"])


@query("l03_increment", _JOBS + "SELECT url, score FROM j WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 UNION ALL SELECT url, -score FROM j WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 AND o_orderkey % 7 <> 0")
def l03(spark, d):
    jobs = _jobs(spark, d).select("url", "score", "o_orderkey")
    new = jobs.where("o_orderkey % 3 = 0").withColumn("score", -F.col("score"))
    return report.increment(jobs.where("o_orderkey % 2 = 0"), new, jobs.where("o_orderkey % 7 = 0")).select("url", "score")


@query("l04_urgency_colour", """SELECT o_orderkey, CASE WHEN d < 0 THEN 'AAAAAA' WHEN d IS NOT NULL THEN printf('%02X', floor((0.80::DOUBLE * (1 - x) + 0.84::DOUBLE * x) * 255)::INT) || printf('%02X', floor((0.0::DOUBLE * (1 - x) + 0.96::DOUBLE * x) * 255)::INT)
 || printf('%02X', floor((0.0::DOUBLE * (1 - x) + 0.89::DOUBLE * x) * 255)::INT) END AS colour FROM (SELECT *, least(90, d) / 90.0::DOUBLE AS x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN date_diff('day', DATE '1999-01-01', o_orderdate::DATE) % 120 END AS d FROM orders))""")
def l04(spark, d):
    days = F.when(F.col("o_orderkey") % 4 != 0, F.datediff("o_orderdate", _as_of()) % 120)
    return table(spark, d, "orders").select("o_orderkey", dates.urgency_colour(days).alias("colour"))


_KINDS = ["postdoc in yeast genetics", "phd student in physics", "research fellow 1997 intake", "nurse for the ward", "professor of chemistry", "lab", "scientist, marketing"]


@query(
    "l05_exclusion_reason",
    """WITH j AS (SELECT o_orderkey, list_extract(['postdoc in yeast genetics', 'phd student in physics', 'research fellow 1997 intake', 'nurse for the ward', 'professor of chemistry', 'lab', 'scientist, marketing'], (o_orderkey % 7)::INT + 1) AS title,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS deadline, o_orderdate::DATE AS posted, CASE WHEN o_orderkey % 2 = 0 THEN 'Korea' ELSE 'EU' END AS region FROM orders)
SELECT o_orderkey, CASE WHEN deadline < DATE '1999-01-01' THEN 'expired' WHEN contains(title, '1997') THEN 'past year' WHEN deadline IS NULL AND date_diff('day', posted, DATE '1999-01-01') > 120 THEN 'stale'
 WHEN contains(title, 'marketing') THEN 'keyword' WHEN contains(title, 'postdoc') THEN NULL WHEN contains(title, 'phd') THEN 'student' WHEN contains(title, 'nurse') THEN 'not research'
 WHEN contains(title, 'professor') AND region <> 'Korea' THEN 'faculty' WHEN length(title) < 10 THEN 'garbage' END AS reason FROM j""",
)
def l05(spark, d):
    o = table(spark, d, "orders")
    jobs = o.select(
        "o_orderkey", F.get(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 7).cast("int")).alias("title"), F.lit(None).cast("string").alias("field"),
        F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("deadline"), F.to_date("o_orderdate").alias("posted"), F.when(F.col("o_orderkey") % 2 == 0, "Korea").otherwise("EU").alias("region"),
    )
    return jobs.select("o_orderkey", scoring.exclusion(scoring.Profile(exclude=("marketing",)), _as_of()).alias("reason"))


@query("m01_parse_dates", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders")
def m01(spark, d):
    shown = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, shown("yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, shown("d MMMM yyyy")).when(k == 2, shown("MMM d, yyyy")).when(k == 3, shown("d/M/yyyy")).when(k == 4, F.concat(F.lit("posted on "), shown("yyyy-MM-dd"), F.lit(" here"))).otherwise(shown("yyyy.M.d"))
    return table(spark, d, "orders").select("o_orderkey", dates.parse(text).cast("string").alias("day"))


@query("m02_relative_text", "SELECT event_id, (ts::DATE - CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 7 * user_id WHEN 'error' THEN 30 * user_id WHEN 'signup' THEN 0 ELSE user_id END::INT)::VARCHAR AS day FROM events")
def m02(spark, d):
    kind, n = F.col("event_type"), F.col("user_id").cast("string")
    text = F.when(kind == "view", "yesterday").when(kind == "click", F.concat(n, F.lit(" weeks ago"))).when(kind == "error", F.concat(n, F.lit("+ months ago"))).when(kind == "signup", "5 hours ago").otherwise(F.concat(n, F.lit(" days ago")))
    return table(spark, d, "events").select("event_id", dates.told(dates.relative(text, F.to_date("ts"))).alias("day"))


@query("m03_korean_dates", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders")
def m03(spark, d):
    short = F.date_format("o_orderdate", "yy년 M월 d일")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1990.1.2 ~ "), short)).otherwise(F.date_format("o_orderdate", "yyyy. M. d"))
    return table(spark, d, "orders").select("o_orderkey", dates.korean(text).cast("string").alias("day"))


@query("m04_rss_items", "SELECT p_partkey, p_name AS title, 'http://feed/' || p_partkey AS link FROM part UNION ALL SELECT p_partkey, p_type, 'http://feed/x' FROM part")
def m04(spark, d):
    item = lambda t, u: F.concat(F.lit("<item><title>"), t, F.lit("</title><link>"), u, F.lit("</link><dc:creator>x</dc:creator></item>"))
    feed = F.concat(F.lit("<rss><channel>"), item(F.col("p_name"), F.concat(F.lit("http://feed/"), "p_partkey")), item(F.col("p_type"), F.lit("http://feed/x")), F.lit("</channel></rss>"))
    return feeds.rss_items(table(spark, d, "part").select("p_partkey", feed.alias("xml")), "xml").select("p_partkey", "title", "link")


@query("m05_json_ld", "SELECT p_partkey, p_name AS title, p_brand AS institute, 'FR' AS country FROM part")
def m05(spark, d):
    ld = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("name")).alias("hiringOrganization"), F.from_json(F.lit('{"address":{"addressCountry":"FR"}}'), "address struct<addressCountry:string>").alias("jobLocation")))
    page = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">'), ld, F.lit("</script></html>"))
    return feeds.postings(table(spark, d, "part").select("p_partkey", page.alias("html")), "html").select("p_partkey", "title", "institute", "country")


@query("m06_json_records", "SELECT event_id, event_type AS kind, user_id AS n FROM events UNION ALL SELECT event_id, 'x', -1 FROM events")
def m06(spark, d):
    one = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("n"))
    packed = F.to_json(F.struct(F.array(one, F.struct(F.lit("x").alias("kind"), F.lit(-1).cast("long").alias("n"))).alias("items")))
    return feeds.json_records(table(spark, d, "events").select("event_id", packed.alias("j")), "j", "kind: string, n: bigint", "$.items").select("event_id", "kind", "n")


@query("m07_articles", "SELECT c_custkey::VARCHAR AS pmid, c_name AS title, c_mktsegment AS last_author, 2000 + c_nationkey AS year FROM customer")
def m07(spark, d):
    author = lambda a: F.concat(F.lit("<Author><LastName>"), a, F.lit("</LastName><ForeName>F</ForeName></Author>"))
    xml = F.concat(
        F.lit("<Set><PubmedArticle><PMID>"), F.col("c_custkey").cast("string"), F.lit("</PMID><ArticleTitle>"), "c_name", F.lit("</ArticleTitle><PubDate><Year>"), (F.col("c_nationkey") + 2000).cast("string"),
        F.lit("</Year></PubDate>"), author(F.lit("First")), author(F.col("c_mktsegment")), F.lit("</PubmedArticle></Set>"),
    )
    return feeds.articles(spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")).select(xml.alias("xml")), "xml").select("pmid", "title", "last_author", "year")
