"""Resolvers, extractors, state and report columns of postings, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import korean, people, terms
from quillmark.operators import institutes, ranking, report, store
from quillmark.plans.catalog import query
from quillmark.session import table
from quillmark.shared import spread
from quillmark.streaming import jobs

#: A ranking over the made-up institutes of ``_places``.
RANKING = institutes.Ranking(
    aliases=[("MIT", "Massachusetts Institute of Technology"), ("Poly Zürich", "ETH Zurich"), ("UCB", "University of California, Berkeley")],
    tiers=[("Massachusetts Institute of Technology", 1), ("ETH Zürich", 1), ("University of California", 2), ("Basel", 3), ("Roche", 2), ("GSK", 3), ("Novartis Institutes", 3)],
    companies=["Roche", "GSK", "Novartis Institutes"],
)
NAMES = ["MIT", "The Massachusetts Institute of Technology", "Poly Zurich, Zürich", "UCB", "UCB Pharma", "University of Basel", "Roche Diagnostics, Inc.", "GSK", "GSKX", "Novartis", "Nowhere College", ""]
_TIERS = {"MIT": 1, "The Massachusetts Institute of Technology": 1, "Poly Zurich, Zürich": 1, "UCB": 2, "UCB Pharma": 5, "University of Basel": 3, "Roche Diagnostics, Inc.": 2, "GSK": 3, "GSKX": 3, "Novartis": 3, "Nowhere College": 5, "": 5}
_COMPANIES = {"Roche Diagnostics, Inc.", "GSK", "Novartis"}
REGIONS = [("United States", "US"), ("USA", "US"), ("Germany", "EU"), ("United Kingdom", "EU"), ("UK", "EU"), ("South Korea", "Korea"), ("Korea", "Korea"), ("Japan", "Asia")]
COUNTRIES = ["United States", "united states of america", "West Germany", "UK", "uk", "Republic of Korea", "Narnia", ""]
_REGION_OF = {"United States": "US", "united states of america": "US", "West Germany": "EU", "UK": "EU", "uk": "EU", "Republic of Korea": "Korea", "Narnia": "Other", "": "Other"}


def _pick(values: list[str], k):
    return F.get(F.array(*map(F.lit, values)), F.pmod(k, F.lit(len(values))).cast("int"))


def _listed(values: list) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


@query("c16_tier_with_aliases", f"SELECT c_custkey, list_extract([{', '.join(str(_TIERS[n]) for n in NAMES)}], (c_custkey % {len(NAMES)})::INT + 1)::INT AS tier FROM customer")
def c16(spark, d):
    c = table(spark, d, "customer").select("c_custkey", _pick(NAMES, F.col("c_custkey")).alias("institute"))
    return institutes.with_tier(c, "institute", RANKING).select("c_custkey", "tier")


@query("c17_company", f"SELECT c_custkey, list_extract([{', '.join(str(n in _COMPANIES).upper() for n in NAMES)}], (c_custkey % {len(NAMES)})::INT + 1) AS is_company FROM customer")
def c17(spark, d):
    c = table(spark, d, "customer").select("c_custkey", _pick(NAMES, F.col("c_custkey")).alias("institute"))
    return institutes.with_company(c, "institute", RANKING).select("c_custkey", "is_company")


@query("c18_best_affiliation", f"SELECT o_custkey, min(list_extract([{', '.join(str(_TIERS[n]) for n in NAMES)}], (o_orderkey % {len(NAMES)})::INT + 1))::INT AS tier FROM orders GROUP BY 1")
def c18(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(_pick(NAMES, F.col("o_orderkey"))).alias("affiliations"))
    return institutes.best_tier(o, "o_custkey", "affiliations", RANKING)


@query("c19_region_both_ways", f"SELECT s_suppkey, list_extract({_listed([_REGION_OF[c] for c in COUNTRIES])}, (s_suppkey % {len(COUNTRIES)})::INT + 1) AS region FROM supplier")
def c19(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", _pick(COUNTRIES, F.col("s_suppkey")).alias("country"))
    return institutes.with_region(s, "country", REGIONS).select("s_suppkey", "region")


@query(
    "k04_terms",
    """SELECT p_partkey, '$' || format('{:,}', (50000 + p_partkey)::INT) || ' per year' AS salary, (1 + p_partkey % 5) || ' years' AS duration, 'March ' || (1 + p_partkey % 28) || ', 2026' AS start_date,
 'PhD in ' || p_name AS degree, CASE WHEN p_partkey % 2 = 0 THEN 'Full-time, Fixed-term' ELSE 'Part-time, Permanent' END AS contract FROM part""",
)
def k04(spark, d):
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    text = F.concat(
        F.lit("A "), F.when(k % 2 == 0, "full-time, fixed-term").otherwise("part-time permanent"), F.lit(" position. Salary: $"), s(50000 + k), F.lit(" per year. Duration: "), s(1 + k % 5),
        F.lit(" years; 7 years of research experience. Starting date: March "), s(1 + k % 28), F.lit(", 2026. PhD in "), "p_name", F.lit("; patience."),
    )
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", terms.terms(text, F.lit("")).alias("t")).select("p_partkey", "t.*")


_FIRST, _SUR = ["Ahmed", "Maria", "Feng", "Jennifer", "Sarah", "Joanna"], ["Badran", "Garcia", "Zhang", "Doudna", "Basta-Kaim"]


@query(
    "k05_leaders",
    f"""SELECT c_custkey, f || ' ' || s AS leader, s AS of_title FROM (SELECT c_custkey, list_extract({_listed(_FIRST)}, (c_custkey % 6)::INT + 1) AS f, list_extract({_listed(_SUR)}, (c_custkey % 5)::INT + 1) AS s FROM customer)""",
)
def k05(spark, d):
    k = F.col("c_custkey")
    first, sur = _pick(_FIRST, k), _pick(_SUR, k)
    name = F.concat_ws(" ", first, sur)
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("We work in the laboratory of Dr. "), name, F.lit(" at Basel.")))
        .when(k % 7 == 1, F.concat(F.lit("Cell Biology Group. PI: "), name, F.lit(". Apply now.")))
        .when(k % 7 == 2, F.concat(F.lit("under the supervision of Prof. Dr. "), name, F.lit(" on enzymes")))
        .when(k % 7 == 3, F.concat(F.lit("For inquiries contact "), name, F.lit(" (mail@x.org)")))
        .when(k % 7 == 4, F.concat(F.lit("Join Prof. "), name, F.lit("'s lab.")))
        .when(k % 7 == 5, F.concat(F.lit("the project is supervised by "), name, F.lit(", our dean")))
        .otherwise(F.concat(F.lit("About "), name, F.lit(", Group Leader")))
    )
    title = F.concat(F.lit("Postdoc in Dr. "), sur, F.lit("'s Lab"))
    return spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", people.leader_of(text).alias("leader"), people.leader_in_title(title).alias("of_title"))


@query("k06_korean_fields", "SELECT s_suppkey, '한국대학교 ' || s_suppkey AS institute, '연봉 ' || s_suppkey || '만원' AS pay, '합성생물학' AS field, s_suppkey % 3 = 0 AS relevant, CASE WHEN s_suppkey % 3 = 0 THEN '생명과학과' END AS department, (2020 + s_suppkey % 7) || '-03-' || lpad((1 + s_suppkey % 28)::VARCHAR, 2, '0') AS due FROM supplier")
def k06(spark, d):
    from quillmark.functions import dates

    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    text = F.concat(F.lit("모집기관: 한국대학교 "), k, F.lit("\n연구분야: 생명과학>합성생물학>기타\n급여: 연봉 "), k, F.lit("만원\n모집기간: 2019.01.02 ~ "), 2020 + k % 7, F.lit(".3."), 1 + k % 28)
    title = F.when(k % 3 == 0, "UNIST 생명과학과 Post-Doc. 모집").when(k % 3 == 1, "한화생명 검진센터 모집").otherwise("서울대학교 경영대학 교수 모집")
    f = s.select(k, korean.korean_fields(text).alias("f"), title.alias("title"))
    unit = F.when(korean.relevant("title"), korean.place_of("title")[1])
    return f.select("s_suppkey", "f.institute", F.substring(F.col("f.conditions"), 5, 100).alias("pay"), "f.field", korean.relevant("title").alias("relevant"), unit.alias("department"), dates.korean(F.col("f.deadline")).cast("string").alias("due"))


def _calls(spark, d):
    return jobs.events(spark, d).select("user_id", "ts", "event_id", "event_type")


@query("j06_negative_cache")
def j06(spark, d):
    found = jobs.negative_cache(_calls(spark, d), "user_id", "event_type = 'error'", 6 * 3600.0)
    return jobs.drained(found, "update", lambda x: x.groupBy("user_id").agg(F.sum("n_looked_up").alias("n_looked_up"), F.sum("n_skipped").alias("n_skipped"), F.max("epoch").alias("epoch")))


@query("j07_circuit_breaker")
def j07(spark, d):
    found = jobs.circuits(_calls(spark, d), "user_id", "event_type = 'error'", 2, 12 * 3600.0)
    return jobs.drained(found, "update", jobs._latest("user_id"))


@query("j08_cache_in_order")
def j08(spark, d):
    """Lookups by user and event type, in the order of time however they come; state goes when it has expired."""
    from quillmark.streaming import expiring

    rocks, name = expiring.ROCKS, "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, rocks)
    try:
        calls = jobs.events(spark, d).select("event_id", "ts", "user_id", "event_type")
        whole = expiring.ended(calls, table(spark, d, "events").agg(F.max("ts").alias("ts")), "user_id", -1)
        found = expiring.answered(whole, "user_id", expiring.NegativeCache(6 * 3600.0), "coalesce(event_type = 'error', false)", item="coalesce(event_type, '')", order="coalesce(event_id, -1)")
        return jobs.drained(found, "append", lambda x: x.where("user_id <> -1").groupBy("user_id").agg(F.sum("looked_up").alias("looked_up"), F.sum("skipped").alias("skipped"), F.max("epoch").alias("epoch")))
    finally:
        spark.conf.set(name, old)


@query(
    "l06_run_log",
    "SELECT event_type, found, errors, CASE WHEN errors = 0 THEN 'ok' WHEN found > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT event_type, count(*) FILTER (WHERE NOT (user_id % 3 = 0 OR event_type = 'error')) AS found, count(*) FILTER (WHERE user_id % 3 = 0 OR event_type = 'error') AS errors FROM (SELECT * REPLACE (CASE WHEN event_type = 'view' THEN 1 ELSE user_id END AS user_id) FROM events) GROUP BY 1)",
)
def l06(spark, d):
    e = table(spark, d, "events")
    user = F.when(F.col("event_type") == "view", 1).otherwise(F.col("user_id"))
    failing = F.when((user % 3 == 0) | (F.col("event_type") == "error"), "timeout")
    return store.run_log(e.withColumn("error", failing), "event_type", "ts", "error").select("event_type", "found", "errors", "status")


@query(
    "c20_edge_store",
    """SELECT least(a, b) AS a, greatest(a, b) AS b, max(shared) AS shared, arg_min(shared, (shared % 2, l_orderkey, l_linenumber)) + count(*) - 1 AS recent
 FROM (SELECT l_partkey AS a, l_suppkey AS b, l_quantity::BIGINT AS shared, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1, 2""",
)
def c20(spark, d):
    """Edges whose share is even come first, the others later and the other way round."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.round("l_quantity").cast("long").alias("shared"), "l_orderkey", "l_linenumber")
    turned = li.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "l_orderkey", "l_linenumber")
    order = ["l_orderkey", "l_linenumber"]
    none = li.where("false").select("a", "b", "shared", F.col("shared").alias("recent"))
    return store.upsert_edges(store.upsert_edges(none, li.where("shared % 2 = 0"), order=order), turned.where("shared % 2 <> 0"), order=order)


@query("c21_status_cascade", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'dismissed' WHEN o_orderkey % 3 = 0 THEN 'exported' ELSE o_orderstatus END AS status FROM orders")
def c21(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    gone = store.dismissed(o, o.where("o_orderkey % 5 = 0"), "o_orderkey")
    return store.exported(gone, o.where("o_orderkey % 3 = 0"), "o_orderkey")


@query(
    "l07_job_columns",
    """SELECT c_custkey, 'Company' AS tier, 'T' || c_custkey AS title, CASE WHEN c_custkey % 2 = 0 THEN 'Ada Byron' ELSE '' END AS pi, 'Basel' AS institute, 'stored ' || c_custkey AS requirements,
 CASE WHEN c_custkey % 3 = 0 THEN 'given' ELSE 'PhD in cells' END AS degree, 'http://a' AS url1, '' AS url3, 'http://alt' AS url2nd, c_acctbal AS score FROM customer""",
)
def l07(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    alt = F.array(F.struct(F.lit("http://alt").alias("url"), F.lit("s2").alias("source")))
    given = c.select(
        "c_custkey", F.lit(2).alias("tier"), F.lit(True).alias("is_company"), F.concat(F.lit("T"), k).alias("title"), F.when(k % 2 == 0, "Ada Byron").alias("pi_name"), F.lit("Basel").alias("institute"),
        F.concat(F.lit("stored "), k).alias("requirements"), F.when(k % 3 == 0, "given").alias("degree"), F.lit("PhD in cells; patience").alias("description"), F.array(F.lit("http://a"), F.lit("http://b")).alias("info_urls"),
        F.lit("http://x").alias("url"), alt.alias("alt_urls"), F.col("c_acctbal").alias("match_score"),
    )
    out = report.job_columns(given, "c_custkey")
    assert out.columns == ["c_custkey", *report.JOB_COLUMNS]
    pick = {"Tier": "tier", "Title": "title", "PI Name": "pi", "Institute": "institute", "Requirements (Full)": "requirements", "Degree Required": "degree", "Info URL 1": "url1", "Info URL 3": "url3", "Job URL 2": "url2nd", "Match Score": "score"}
    return out.select("c_custkey", *(F.col(f"`{a}`").alias(b) for a, b in pick.items()))


@query("l08_pi_columns", "SELECT s_suppkey, s_name AS name, 'T' || (1 + s_suppkey % 4) AS tier, coalesce(p, '') AS paper1 FROM (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'P' || s_suppkey END AS p FROM supplier)")
def l08(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    paper = F.struct(F.concat(F.lit("P"), k).alias("title"))
    given = s.select("s_suppkey", F.col("s_name").alias("name"), (1 + k % 4).cast("int").alias("tier"), F.when(k % 2 == 0, F.array(paper)).alias("papers"))
    return report.pi_columns(given, "s_suppkey").select("s_suppkey", F.col("Name").alias("name"), F.col("Tier").alias("tier"), F.col("`Recent Paper 1`").alias("paper1"))


@query("e08_url_argmax", "SELECT host, arg_max(page_id, (s, -page_id)) AS page_id FROM (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, 3 * contains(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), 'example')::INT + 2 * (contains(lower(url), 'en') OR contains(lower(url), 'page'))::INT AS s FROM pages) GROUP BY 1")
def e08(spark, d):
    from quillmark.functions import text as X

    scored = table(spark, d, "pages").select("page_id", X.url_host("url").alias("host"), X.url_score(F.col("url"), F.lit("example"), ["en", "page"]).alias("s"))
    return ranking.best(scored, ["host"], [F.col("s"), -F.col("page_id")], ["page_id"])


@query("d16_derived_totals", "SELECT r_name, count(*) FILTER (WHERE t IN (1, 2)) AS top, count(*) FILTER (WHERE t IN (3, 4)) AS middle, count(*) - count(*) FILTER (WHERE t BETWEEN 1 AND 4) AS unranked FROM (SELECT r_name, c_custkey % 6 AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def d16(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    placed = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("t", F.col("c_custkey") % 6)
    return report.tier_totals(placed, ["r_name"], F.col("t"))


@query("e09_global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def e09(spark, d):
    return ranking.global_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "rank")


_SCREENS = [
    ("Must be a U.S. citizen to apply.", "http://lab.edu/x", "Department of Neuroscience, University of Basel, Basel", "Biological sciences»Biology›Biology of cells|Chemistry", "Postdoc", "813 postdoc positions", "<p>Verifying: unusual activity</p>"),
    ("Open to all. Permanent residents may apply", "https://www.linkedin.com/in/x", "Somewhere else", "Physics", "Postdoc in x", "9 lives", "<html><script>let x = 1</script><body>hi</body></html>"),
    ("No limits here", "ftp://lab.edu", "Broad Institute, Cambridge", "", "Post-Doc", "We hire", "<p>" + "plain words " * 30 + "</p>"),
]


@query(
    "a12_screening",
    """SELECT c_custkey, list_extract([true, true, false], (c_custkey % 3)::INT + 1) AS citizens, list_extract([true, false, false], (c_custkey % 3)::INT + 1) AS lab, list_extract(['University of Basel', 'Somewhere else', 'Broad Institute'], (c_custkey % 3)::INT + 1) AS place,
 list_extract(['Biological sciences, Biology of cells, Chemistry', 'Physics', ''], (c_custkey % 3)::INT + 1) AS fields, list_extract([true, false, false], (c_custkey % 3)::INT + 1) AS listing, list_extract([true, false, false], (c_custkey % 3)::INT + 1) AS blocked, list_extract([true, true, false], (c_custkey % 3)::INT + 1) AS browser,
 list_extract(['Department of Neuroscience', '-', '-'], (c_custkey % 3)::INT + 1) AS unit, c_acctbal >= 10 AND c_nationkey >= 15 AS leads FROM customer""",
)
def a12(spark, d):
    from quillmark.functions import screening as S

    k = F.col("c_custkey")
    text, url, place, raw, title, desc, html = (_pick([r[i] for r in _SCREENS], k) for i in range(7))
    return table(spark, d, "customer").select(
        "c_custkey", S.citizens_only(text).alias("citizens"), S.lab_page(url).alias("lab"), S.institute_of(place).alias("place"), S.research_fields(raw).alias("fields"), S.listing_page(title, desc).alias("listing"),
        S.blocked_page(html).alias("blocked"), S.needs_browser(html).alias("browser"), F.coalesce(S.department(place), F.lit("-")).alias("unit"), S.leads_a_group(F.col("c_acctbal"), F.col("c_nationkey"), F.lit(3)).alias("leads"),
    )


@query("a13_site_employer", "SELECT s_suppkey, list_extract([true, false, true], (s_suppkey % 3)::INT + 1) AS site, list_extract(['Kim', 'Ada', 'Hong'], (s_suppkey % 3)::INT + 1) AS surname, list_extract(['United States', 'South Korea', 'United Kingdom'], (s_suppkey % 3)::INT + 1) AS country FROM supplier")
def a13(spark, d):
    from quillmark.functions import screening as S

    k = F.col("s_suppkey")
    where = S.country_in(_pick(["Lab in Boston, MA, now", "서울 south korea", "Oxford, uk and korea"], k), ["ma", "ny"], ["san diego"], {"korea": "Korea", "south korea": "South Korea", "uk and korea": "United Kingdom"})
    return table(spark, d, "supplier").select("s_suppkey", S.is_site(_pick(["LinkedIn ", "MIT", "Nature"], k)).alias("site"), S.surname_in_latin(_pick(["김철수", "Ada", "홍길동"], k)).alias("surname"), where.alias("country"))
