"""Queries over texts and pages: approximate keywords, names of a table, blocks of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import employer, extract
from quillmark.operators import fuzzy, gazetteer, scoring
from quillmark.plans.catalog import query
from quillmark.session import table
from quillmark.shared import cut
from quillmark.sources import nodes


def fuzzy_keywords(spark, d) -> list[str]:
    """A profile of 50 keywords: the second and third words of benchmark items, the first of the two misspelt."""
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    one = F.regexp_replace(F.get(words, F.lit(1)), "^(.)(.)", "$2$1")
    rows = table(spark, d, "benchmark").where(F.size(words) > 3).select("item_id", F.concat_ws(" ", one, F.get(words, F.lit(2))).alias("w"))
    return sorted({r.w for r in rows.orderBy("item_id").limit(50).collect()})


@query("g19_fuzzy_keywords")
def g19(spark, d):
    return fuzzy.fuzzy_scores(table(spark, d, "documents"), "doc_id", "text", fuzzy_keywords(spark, d), 0.75)


@query(
    "g20_gazetteer",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), n AS (SELECT DISTINCT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM conversations),
 names AS (SELECT DISTINCT w[1] || ' ' || w[2] AS name FROM n WHERE len(w) >= 2), p AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS name FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w))
 SELECT doc_id, name, count(*) AS times FROM p JOIN names USING (name) GROUP BY 1, 2""",
)
def g20(spark, d):
    """How often the openings of all conversations' turns, two words each, occur in all documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))
    names = table(spark, d, "conversations").select(words.alias("w")).where(F.size("w") >= 2).select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("name")).distinct()
    found = gazetteer.matches(table(spark, d, "documents"), "doc_id", "text", names.withColumn("label", F.col("name")), every=True)
    return found.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("times"))


@query(
    "n01_page_nodes",
    r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(p|li|h1|article|nav|footer|a|div|ul|table|tr|td)[ >]', 1)) AS tag FROM pages) GROUP BY 1, 2""",
)
def n01(spark, d):
    """How many elements of each of some kinds every page has."""
    table_ = nodes.nodes(table(spark, d, "pages"), "page_id", "html")
    return table_.where("tag in ('p', 'li', 'h1', 'article', 'nav', 'footer', 'a', 'div', 'ul', 'table', 'tr', 'td')").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "n02_navigation",
    r"""SELECT page_id, i::INT AS place, regexp_extract(x, '<a href="([^"]*)">', 1) AS target, regexp_extract(x, '<a href="[^"]*">([^<]*)</a>', 1) AS label
 FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM pages))""",
)
def n02(spark, d):
    """The entries of every page's navigation: where each leads and what it says."""
    all_, _ = cut(nodes.nodes(table(spark, d, "pages"), "page_id", "html"), "nodes")
    items = nodes.selected(all_, "page_id", nodes.having("nav"), nodes.having("li"))
    said = nodes.texts(all_, "page_id", items)
    return items.select("page_id", "node", "place").join(nodes.targets(all_, "page_id", items), ["page_id", "node"]).join(said, ["page_id", "node"]).select("page_id", "place", "target", F.col("text").alias("label"))


@query("n03_page_descriptions")
def n03(spark, d):
    all_, _ = cut(nodes.nodes(table(spark, d, "pages"), "page_id", "html"), "nodes")
    return nodes.descriptions(all_, "page_id")


#: The expected fields of postings that are made of the columns of all parts.
_FIELDS = """
WITH x AS (SELECT *, 'Ka' || translate(substr(md5('n' || p_partkey), 1, 6), '0123456789', 'aeiouaeiou') AS sur, DATE '2026-01-01' + (p_partkey % 300)::INT AS begin, DATE '2025-06-01' + (p_partkey % 200)::INT AS due,
  printf('%.2f', p_retailprice) AS price FROM part)
SELECT p_partkey, 'EUR ' || CASE WHEN p_retailprice >= 999.995 THEN format('{:,}', split_part(price, '.', 1)::BIGINT) WHEN price LIKE '%.00' THEN split_part(price, '.', 1) ELSE price END || ' per month' AS salary,
 p_size || ' months' AS duration, strftime(begin, '%B %-d, %Y') AS start_date, 'PhD in ' || p_type AS degree, CASE WHEN p_size % 2 = 0 THEN 'Full-time' ELSE 'Permanent' END AS contract, 'Ada ' || sur AS leader,
 due::VARCHAR AS deadline, 'jobs@' || lower(sur) || '.example.org' AS contact_email, 'https://' || lower(sur) || '.example.org/' || p_partkey AS info_url, p_name || ' and patience with cells' AS requirements, p_type || ' and free lunches' AS conditions,
 CASE WHEN p_size % 3 = 0 THEN p_brand || ' is a plus, says the group' END AS preferred FROM x
"""


@query("k07_posting_chain", _FIELDS)
def k07(spark, d):
    """All fields of postings made of the columns of all parts, by the one chain."""
    k, s = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    sur = F.concat(F.lit("Ka"), F.translate(F.substring(F.md5(F.concat(F.lit("n"), k)), 1, 6), "0123456789", "aeiouaeiou"))
    begin, due = (F.date_add(F.lit(day).cast("date"), (k % n).cast("int")) for day, n in (("2026-01-01", 300), ("2025-06-01", 200)))
    host = F.concat(F.lower(sur), F.lit(".example.org"))
    kind = F.when(F.col("p_size") % 2 == 0, "a full-time job").otherwise("a permanent job")
    plus = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Preferred qualifications:\n"), "p_brand", F.lit(" is a plus, says the group\n"))).otherwise("")
    text = F.concat(
        F.lit("We look for someone who likes "), "p_name", F.lit(", "), kind, F.lit(".\nPI: Dr. Ada "), sur, F.lit(". Salary: EUR "), F.format_string("%.2f", "p_retailprice"), F.lit(" per month. Appointment for up to "), s("p_size"),
        F.lit(" months. Starting date: "), F.date_format(begin, "MMMM d, yyyy"), F.lit(". Closing date: "), due.cast("string"), F.lit(". PhD in "), "p_type", F.lit(".\nContact: jobs@"), host, F.lit(" or https://"), host, F.lit("/"), k.cast("string"),
        F.lit(" .\nRequirements:\n"), "p_name", F.lit(" and patience with cells\n"), plus, F.lit("We offer:\n"), "p_type", F.lit(" and free lunches\n"),
    )
    found = extract.posting(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    names = ["salary", "duration", "start_date", "degree", "contract", "leader", "deadline", "contact_email"]
    return found.select("p_partkey", *names, F.get("info_urls", F.lit(0)).alias("info_url"), "requirements", "conditions", "preferred")


@query(
    "k08_employers",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'University of ' || x WHEN 1 THEN x || ' Institute for Science' ELSE 'Universität ' || x END AS name,
 CASE c_custkey % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'label' WHEN 2 THEN 'seeks' WHEN 3 THEN 'about' ELSE 'name' END AS kind FROM (SELECT c_custkey, 'Ka' || translate(substr(md5('e' || c_custkey), 1, 6), '0123456789', 'aeiouaeiou') AS x FROM customer)""",
)
def k08(spark, d):
    """Employers of postings made for all customers, each by another kind of evidence."""
    k = F.col("c_custkey")
    x = F.concat(F.lit("Ka"), F.translate(F.substring(F.md5(F.concat(F.lit("e"), k)), 1, 6), "0123456789", "aeiouaeiou"))
    name = F.when(k % 3 == 0, F.concat(F.lit("University of "), x)).when(k % 3 == 1, F.concat(x, F.lit(" Institute for Science"))).otherwise(F.concat(F.lit("Universität "), x))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Postdoc\nOrganisation/Company\n"), name, F.lit("\nDepartment of Physics")))
        .when(k % 5 == 1, F.concat(F.lit("Postdoc.\nEmployer: "), name, F.lit(", "), F.col("c_mktsegment")))
        .when(k % 5 == 2, F.concat(F.lit("Our School of Medicine is old. "), name, F.lit(" invites applications")))
        .when(k % 5 == 3, F.concat(F.lit("We study cells. About "), name, F.lit(". Founded long ago.")))
        .otherwise(F.concat(F.lit("Work with colleagues from "), name, F.lit(" and others.")))
    )
    return table(spark, d, "customer").select("c_custkey", employer.employer_of(text).alias("e")).select("c_custkey", "e.name", "e.kind")


@query(
    "l09_left_out",
    """WITH j AS (SELECT o_orderkey, ['Postdoc in cells', 'PhD student in cells', 'Doctoral post-doc of cells', 'Nurse of the ward', 'Professor of cells', 'short', 'Post of ' || year(o_orderdate) || ' in cells', 'Click here for posts'][1 + (o_orderkey % 8)::INT] AS title,
  CASE WHEN o_custkey % 7 = 0 THEN 'History' ELSE 'cells' END AS field, CASE o_custkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '' END AS deadline, CASE WHEN o_custkey % 2 = 0 THEN 'Korea' ELSE 'US' END AS region, o_orderdate FROM orders),
 y AS (SELECT *, lower(title) AS t, nullif(regexp_extract(title, '(20[0-9]{2})', 1), '')::INT AS y FROM j)
 SELECT o_orderkey, CASE WHEN deadline <> '' AND deadline::DATE < DATE '1998-05-01' THEN 'expired' WHEN y < 1998 THEN 'past year' WHEN coalesce(deadline, '') = '' AND year(o_orderdate) < 1998 THEN 'stale' WHEN field = 'History' THEN 'keyword'
  WHEN t LIKE '%phd student%' OR t LIKE '%doctoral%' THEN CASE WHEN t LIKE '%post-doc%' THEN NULL ELSE 'student' END WHEN t LIKE '%nurse%' THEN 'not research' WHEN t LIKE '%professor%' AND region <> 'Korea' THEN 'faculty' WHEN length(title) < 10 THEN 'short'
  WHEN t LIKE '%click here%' THEN 'garbage' END AS why FROM y""",
)
def l09(spark, d):
    """Why a report leaves out each of the postings that are made of all orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    titles = ("Postdoc in cells", "PhD student in cells", "Doctoral post-doc of cells", "Nurse of the ward", "Professor of cells", "short", None, "Click here for posts")
    named = F.array(*(F.lit(t) if t else F.concat(F.lit("Post of "), F.year("o_orderdate"), F.lit(" in cells")) for t in titles))
    jobs = table(spark, d, "orders").select(
        "o_orderkey", F.get(named, (k % 8).cast("int")).alias("title"), F.when(c % 7 == 0, "History").otherwise("cells").alias("field"),
        F.when(c % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(c % 3 == 1, "").alias("deadline"), F.when(c % 2 == 0, "Korea").otherwise("US").alias("region"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"),
    )
    profile = scoring.Profile(exclude=("history",), student_titles=("phd student", "doctoral"), other_titles=("nurse",), faculty_titles=("professor",), garbage_titles=("click here",))
    return jobs.select("o_orderkey", scoring.left_out(jobs, profile, F.lit("1998-05-01").cast("date")).alias("why"))
