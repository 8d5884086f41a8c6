"""Filters, projections, merges, joins, aggregates, rankings and set operations, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import graph, lookup, ranking, recommend, store
from quillmark.plans.catalog import query
from quillmark.session import table
from quillmark.shared import parts_for

AS_OF = "1999-01-01"
FLAG_WORDS = ["the", "and", "tion", "der", "que"]
TIERS = [("gold", "1"), ("small", "2"), ("blue", "3"), ("ring", "4")]


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


@query(
    "a00_flagship",
    """
WITH s AS (
  SELECT doc_id, source, lang, length(text) AS n_chars,
    round_even(((contains(lower(text), 'the'))::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'tion')::INT
      + contains(lower(text), 'der')::INT + contains(lower(text), 'que')::INT) / 5.0, 3) AS score,
    CASE WHEN lang = 'en' THEN 1 WHEN lang IN ('de', 'fr') THEN 2 ELSE 3 END AS tier
  FROM documents WHERE text IS NOT NULL AND length(trim(text)) >= 10
), k AS (
  SELECT s.*, coalesce(quality, 1) AS quality FROM s LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0
)
SELECT doc_id, source, score, tier, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier, score DESC, n_chars DESC, doc_id) AS rank FROM k WHERE quality = 1
) WHERE rank <= 10
""",
)
def flagship(spark, d):
    docs, labels = _t(spark, d, "documents", "labels")
    scored = docs.where(~X.is_garbage_title("text")).select(
        "doc_id", "source", F.length("text").alias("n"), X.keyword_score("text", FLAG_WORDS).alias("score"),
        F.when(F.col("lang") == "en", 1).when(F.col("lang").isin("de", "fr"), 2).otherwise(3).alias("tier"),
    ).join(labels, "doc_id", "left").where("coalesce(toxic, 0) = 0 and coalesce(quality, 1) = 1")
    order = ["tier", F.desc("score"), F.desc("n"), "doc_id"]
    return ranking.top_n(scored, ["source"], order, 10).select("doc_id", "source", "score", "tier", "rank")


@query("a01_filter_sort_limit", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def a01(spark, d):
    (o,) = _t(spark, d, "orders")
    kept = o.where("o_orderstatus = 'O' and o_orderpriority = '2-HIGH' and o_orderdate >= timestamp '1997-01-01'")
    return kept.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("a02_since_filter", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type = 'signup'")
def a02(spark, d):
    return table(spark, d, "events").where("ts >= timestamp '2024-01-20' and event_type = 'signup'").select("event_id", "user_id")


@query("a03_null_or_empty_backfill", "SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR coalesce(lang, '') = ''")
def a03(spark, d):
    docs, labels = _t(spark, d, "documents", "labels")
    return docs.join(labels, "doc_id", "left").where("quality is null or coalesce(lang, '') = ''").select("doc_id", "source")


@query("a04_garbage_text", "SELECT p_partkey FROM part WHERE p_name IS NULL OR length(trim(p_name)) < CASE WHEN regexp_matches(trim(p_name), '[\\x{3000}-\\x{9fff}\\x{ac00}-\\x{d7af}]') THEN 4 ELSE 10 END")
def a04(spark, d):
    return table(spark, d, "part").where(X.is_garbage_title("p_name")).select("p_partkey")


@query(
    "a05_ordered_exclusion",
    """SELECT p_partkey, CASE WHEN p_size > 45 THEN 'size' WHEN contains(p_name, 'gold') THEN 'keep' WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'type'
WHEN p_retailprice > 1500 AND NOT contains(p_name, 'ring') THEN 'price' ELSE 'keep' END AS verdict FROM part""",
)
def a05(spark, d):
    verdict = (
        F.when(F.col("p_size") > 45, "size")
        .when(F.contains("p_name", F.lit("gold")), "keep")  # an escape: later rules aren't asked
        .when(F.col("p_type").isin("PROMO", "ECONOMY"), "type")
        .when((F.col("p_retailprice") > 1500) & ~F.contains("p_name", F.lit("ring")), "price")
        .otherwise("keep")
    )
    return table(spark, d, "part").select("p_partkey", verdict.alias("verdict"))


@query(
    "a06_relevance_filter",
    """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE length(trim(text)) >= 10 AND coalesce(toxic, 0) = 0
AND (contains(lower(text), 'tion') OR (lang IN ('en', 'de') AND contains(lower(text), 'sch')))""",
)
def a06(spark, d):
    docs, labels = _t(spark, d, "documents", "labels")
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    kept = docs.where(~X.is_garbage_title("text") & (has("tion") | (F.col("lang").isin("en", "de") & has("sch"))))
    return kept.join(labels, "doc_id", "left").where("coalesce(toxic, 0) = 0").select("doc_id")


@query(
    "a07_include_exclude_hits",
    """SELECT doc_id, n_include, n_exclude FROM (SELECT doc_id,
 (contains(lower(text), 'tion')::BIGINT + contains(lower(text), 'ment')::BIGINT + contains(lower(text), 'ung')::BIGINT) AS n_include,
 (contains(lower(text), 'password')::BIGINT + contains(lower(text), 'license')::BIGINT) AS n_exclude FROM documents) WHERE n_include >= 1 AND n_exclude < 2""",
)
def a07(spark, d):
    n = lambda words: F.size(X.hits("text", words)).cast("long")
    docs = table(spark, d, "documents").select("doc_id", n(["tion", "ment", "ung"]).alias("n_include"), n(["password", "license"]).alias("n_exclude"))
    return docs.where("n_include >= 1 and n_exclude < 2")


@query("a08_like_distinct", "SELECT DISTINCT p_name FROM part WHERE p_name LIKE '% %'")
def a08(spark, d):
    return table(spark, d, "part").where(F.col("p_name").like("% %")).select("p_name").distinct()


@query("a09_needs_refresh", "SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) < 500 OR ends_with(trim(coalesce(text, '')), '...') OR NOT regexp_matches(trim(coalesce(text, '')), '[.!?]')")
def a09(spark, d):
    return table(spark, d, "documents").where(X.needs_refresh("text")).select("doc_id")


@query("a10_ttl_valid", "SELECT user_id, event_type, max(ts) > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS valid FROM events GROUP BY 1, 2")
def a10(spark, d):
    fresh = F.max("ts") > F.expr("timestamp '2024-01-31' - interval 7 days")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(fresh.alias("valid"))


@query("a11_company_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (VALUES ('gold'), ('bolt')) r(p) WHERE contains(p_name, p))")
def a11(spark, d):
    rules = lookup.rules_table(spark, [("gold", "c"), ("bolt", "c")])
    part = table(spark, d, "part")
    return part.join(F.broadcast(rules), F.contains("p_name", "pattern"), "left_semi").select("p_partkey")


@query(
    "b01_report_projection",
    """SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS language, substr(text, 1, 60) AS headline,
 CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS size_label, upper(source) AS source_label FROM documents""",
)
def b01(spark, d):
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return table(spark, d, "documents").select("doc_id", F.coalesce(store.filled(F.col("lang")), F.lit("unknown")).alias("language"), F.substring("text", 1, 60).alias("headline"), size.alias("size_label"), F.upper("source").alias("source_label"))


@query("b02_array_pivot3", "SELECT page_id, coalesce(p[2], '') AS part1, coalesce(p[3], '') AS part2, coalesce(p[4], '') AS part3 FROM (SELECT page_id, string_split(split_part(url, '://', 2), '/') AS p FROM pages)")
def b02(spark, d):
    parts = F.split(F.split_part("url", F.lit("://"), F.lit(2)), "/")
    return table(spark, d, "pages").select("page_id", *(F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(f"part{k}") for k in (1, 2, 3)))


@query("b03_fill_if_empty", "SELECT doc_id, coalesce(quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def b03(spark, d):
    docs, labels = _t(spark, d, "documents", "labels")
    guess = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", guess).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query(
    "c01_upsert_merge",
    """WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
 new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE lower(o_orderstatus) END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0)
SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey, coalesce(nullif(new.o_orderstatus, ''), old.o_orderstatus) AS o_orderstatus,
 coalesce(old.o_totalprice, new.o_totalprice) AS o_totalprice FROM old FULL JOIN new USING (o_orderkey)""",
)
def c01(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.lower("o_orderstatus"))).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return store.upsert(o.where("o_orderkey % 3 <> 0"), new, "o_orderkey", keep=("o_totalprice",), tombstones=o.where("o_orderkey % 10 = 0"))


@query("c02_tombstone_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def c02(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("c03_snapshot_deletions", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01')")
def c03(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    return store.deleted(o.where("o_orderdate < '1997-01-01'"), o.where("o_orderdate >= '2000-06-01'"), c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query("c04_first_match_tier", "SELECT p_partkey, (SELECT arg_min(t, ord) FROM (VALUES (0, 'gold', '1'), (1, 'small', '2'), (2, 'blue', '3'), (3, 'ring', '4')) r(ord, p, t) WHERE contains(p_name, p)) AS label FROM part")
def c04(spark, d):
    return lookup.first_match(table(spark, d, "part"), "p_name", lookup.rules_table(spark, TIERS)).select("p_partkey", "label")


@query("c05_country_rules", "SELECT page_id, (SELECT arg_min(t, ord) FROM (VALUES (0, '.com', 'US'), (1, 'blog.', 'XX'), (2, '.org', 'EU'), (3, '.net', 'KR')) r(ord, p, t) WHERE contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), p)) AS label FROM pages")
def c05(spark, d):
    pages = table(spark, d, "pages").select("page_id", X.url_host("url").alias("host"))
    rules = lookup.rules_table(spark, [(".com", "US"), ("blog.", "XX"), (".org", "EU"), (".net", "KR")])
    return lookup.first_match(pages, "host", rules).select("page_id", "label")


@query("c06_region_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def c06(spark, d):
    s, n, r = _t(spark, d, "supplier", "nation", "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query(
    "c07_exact_then_partial",
    """SELECT p_partkey, coalesce((SELECT t FROM (VALUES (0, 'ring', '9'), (1, 'small ring', '1'), (2, 'bolt', '5')) r(ord, p, t) WHERE contains(p_name, p) ORDER BY (p <> p_name)::INT, ord LIMIT 1), 'none') AS label FROM part""",
)
def c07(spark, d):
    rules = lookup.rules_table(spark, [("ring", "9"), ("small ring", "1"), ("bolt", "5")])
    return lookup.exact_then_partial(table(spark, d, "part"), "p_name", rules, "none").select("p_partkey", "label")


@query("c08_distinct_fanout", "SELECT o_orderkey, upper(c_mktsegment) || ':' || c_nationkey AS resolved FROM orders JOIN customer ON o_custkey = c_custkey")
def c08(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    keys = o.select("o_custkey").distinct()  # each key is looked up once, however many rows have it
    found = keys.join(c, keys.o_custkey == c.c_custkey).select("o_custkey", F.concat(F.upper("c_mktsegment"), F.lit(":"), "c_nationkey").alias("resolved"))
    return o.join(found, "o_custkey").select("o_orderkey", "resolved")


@query("c09_overlay_coalesce", "SELECT o.o_orderkey, coalesce(n.o_orderpriority, o.o_orderpriority) AS o_orderpriority, o.o_totalprice FROM orders o LEFT JOIN (SELECT o_orderkey, 'X' || o_orderpriority AS o_orderpriority FROM orders WHERE o_orderkey % 5 = 0) n USING (o_orderkey)")
def c09(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    more = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.concat(F.lit("X"), "o_orderpriority").alias("o_orderpriority"))
    return store.overlay(o, more, "o_orderkey")


@query("c10_anti_union", "SELECT o_orderkey, 'new' AS origin FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'store' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def c10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return store.append_missing(o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("new")), o.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("store")), "o_orderkey")


@query(
    "c11_max_cosine_seed",
    """WITH s AS (SELECT embedding AS sv FROM embeddings WHERE label = 0)
SELECT vec_id, round(max(list_cosine_similarity(embedding::DOUBLE[], sv::DOUBLE[])), 6) AS best FROM embeddings, s GROUP BY vec_id""",
)
def c11(spark, d):
    e = table(spark, d, "embeddings")
    found = recommend.nearest_seed(e, e.where("label = 0"), "vec_id", "embedding")
    return found.select("vec_id", F.round("best", 6).alias("best"))


@query("c12_symmetric_edges", "SELECT least(l_partkey, l_suppkey) AS l_partkey, greatest(l_partkey, l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, count(*) AS times FROM lineitem GROUP BY 1, 2")
def c12(spark, d):
    return store.merge_edges(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), "l_partkey", "l_suppkey", "l_quantity")


_SUPPLY = "(SELECT DISTINCT o_custkey, l_suppkey + 10000000 AS supp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    "c13_bfs_two_hop",
    f"""WITH RECURSIVE one AS {_SUPPLY}, e(src, dst) AS (SELECT o_custkey, supp FROM one UNION SELECT supp, o_custkey FROM one),
 walk(node, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT DISTINCT dst, hop + 1 FROM walk JOIN e ON src = node WHERE hop < 2)
SELECT node, min(hop) AS hop FROM walk GROUP BY node""",
)
def c13(spark, d):
    edges = graph.symmetric(_supply(spark, d), "o_custkey", "supp", _dealt(spark, d)[2])
    return graph.within_hops(edges, spark.range(1, 2).toDF("node"), 2)


def _dealt(spark, d):
    """Lines and orders, dealt by order to a number of tasks that grows with the lines; and that number."""
    li, o = _t(spark, d, "lineitem", "orders")
    n = parts_for(spark, li.count())  # from the files' footers
    return li.select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey"), o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), n


def _supply(spark, d):
    li, o, n = _dealt(spark, d)
    one = li.join(o, li.l_orderkey == o.o_orderkey)
    return one.select("o_custkey", (F.col("l_suppkey") + 10_000_000).alias("supp")).repartition(n, "o_custkey", "supp").distinct()


@query("c14_directed_edge_count", "SELECT o_custkey AS src, l_suppkey AS dst, count(*) AS citations FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def c14(spark, d):
    li, o, n = _dealt(spark, d)
    one = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return one.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("citations"))


@query("c15_cache_last_wins", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def c15(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return store.last_wins(e, ["user_id", "event_type"], ["event_id"])


@query("d01_counts_grouping_sets", "SELECT o_orderstatus, o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (c_mktsegment), ())")
def d01(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    sets = [F.col("o_orderstatus")], [F.col("o_orderpriority")], [F.col("c_mktsegment")], []
    return o.join(c, o.o_custkey == c.c_custkey).groupingSets([list(s) for s in sets], "o_orderstatus", "o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("d02_topk_ties", "SELECT user_id, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def d02(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(10)


@query(
    "d03_urgency_buckets",
    """SELECT count(*) FILTER (WHERE x BETWEEN 0 AND 7) AS week, count(*) FILTER (WHERE x BETWEEN 8 AND 30) AS month, count(*) FILTER (WHERE x > 30) AS later,
 count(*) FILTER (WHERE x < 0) AS past FROM (SELECT date_diff('day', DATE '1999-01-01', o_orderdate::DATE) AS x FROM orders)""",
)
def d03(spark, d):
    x = table(spark, d, "orders").select(F.datediff("o_orderdate", F.lit(AS_OF).cast("date")).alias("x"))
    return x.agg(F.count_if(F.col("x").between(0, 7)).alias("week"), F.count_if(F.col("x").between(8, 30)).alias("month"), F.count_if(F.col("x") > 30).alias("later"), F.count_if(F.col("x") < 0).alias("past"))


@query("d04_distinct_count", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def d04(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"))


@query(
    "d05_weekly_trend",
    """SELECT event_type, this_week, last_week, CASE WHEN last_week = 0 THEN NULL ELSE round_even(100.0 * (this_week - last_week) / last_week, 1) END AS change FROM (
 SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS this_week, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS last_week FROM events GROUP BY 1)""",
)
def d05(spark, d):
    now, before = F.col("ts") >= "2024-01-24", (F.col("ts") >= "2024-01-17") & (F.col("ts") < "2024-01-24")
    found = table(spark, d, "events").groupBy("event_type").agg(F.count_if(now).alias("this_week"), F.count_if(before).alias("last_week"))
    change = F.when(F.col("last_week") != 0, F.bround(F.lit(100.0) * (F.col("this_week") - F.col("last_week")) / F.col("last_week"), 1))
    return found.withColumn("change", change)


@query(
    "d06_connection_strength",
    f"""WITH e AS (SELECT o_custkey AS src, l_suppkey + 10000000 AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 b AS (SELECT src AS node, dst AS other, w FROM e UNION ALL SELECT dst, src, w FROM e)
SELECT node, count(DISTINCT other) AS neighbours, sum(w)::BIGINT AS total, round(1 - 1 / (1 + count(DISTINCT other) * 0.5::DOUBLE + sum(w) * 0.1::DOUBLE), 9) AS strength FROM b GROUP BY node""",
)
def d06(spark, d):
    edges = c14(spark, d).select("src", (F.col("dst") + 10_000_000).alias("dst"), "citations")
    return graph.connection_strength(edges, "citations", _dealt(spark, d)[2]).withColumn("strength", F.round("strength", 9))


@query(
    "d07_cross_connections",
    f"""WITH one AS {_SUPPLY}, e AS (SELECT o_custkey AS src, supp AS dst FROM one UNION SELECT supp, o_custkey FROM one), r AS (SELECT DISTINCT dst AS node, src FROM e WHERE src < 20 AND dst >= 20)
SELECT node, count(DISTINCT src) AS n_seeds, string_agg(src::VARCHAR, ',' ORDER BY src) AS seeds FROM r GROUP BY node HAVING count(DISTINCT src) > 1""",
)
def d07(spark, d):
    return graph.cross_connections(graph.symmetric(_supply(spark, d), "o_custkey", "supp", _dealt(spark, d)[2]), spark.range(20).toDF("node"))


@query("d08_group_collect", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def d08(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda r: r.l_partkey.cast("string")), ",").alias("parts"))


@query("d09_case_sum_pct", "SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS bad, round_even(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 1) AS pct_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def d09(spark, d):
    docs, labels = _t(spark, d, "documents", "labels")
    n = F.count(F.lit(1))
    return docs.select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source").agg(n.alias("n"), F.count_if(F.col("toxic") == 1).alias("bad"), F.bround(F.lit(100.0) * F.count_if(F.col("quality") == 1) / n, 1).alias("pct_good"))


@query("d10_argmax_tuple", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def d10(spark, d):
    rank = F.struct(F.col("o_orderstatus") == "F", F.col("o_totalprice"), F.col("o_orderkey"))
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), rank).alias("r"))
    return best.select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("d11_argmin_tolerance", "SELECT c_nationkey, coalesce(arg_min(c_custkey, (abs(c_acctbal - 5000), c_custkey)) FILTER (WHERE abs(c_acctbal - 5000) <= 500), arg_min(c_custkey, (abs(c_acctbal - 5000), c_custkey))) AS c_custkey FROM customer GROUP BY 1")
def d11(spark, d):
    away = F.abs(F.col("c_acctbal") - 5000)
    near = F.min_by("c_custkey", F.when(away <= 500, F.struct(away, "c_custkey")))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.coalesce(near, F.min_by("c_custkey", F.struct(away, "c_custkey"))).alias("c_custkey"))


@query("d12_topn_listagg", "SELECT user_id, string_agg(event_type, ', ' ORDER BY n DESC, event_type) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1")
def d12(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = ranking.top_n(counts, ["user_id"], [F.desc("n"), "event_type"], 3)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_type"))), lambda r: r.event_type)
    return top.groupBy("user_id").agg(F.array_join(listed, ", ").alias("top"))


@query("d13_recency_decay", "SELECT o_custkey, round(sum(exp(-(2002 - year(o_orderdate)) / 2.0::DOUBLE)), 6) AS activity FROM orders GROUP BY 1")
def d13(spark, d):
    age = F.lit(2002) - F.year("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum(recommend.recency(age)), 6).alias("activity"))


@query("d15_append_distinct", "SELECT user_id, string_agg(event_type, ', ' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def d15(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda r: r.event_type)
    return first.groupBy("user_id").agg(F.array_join(listed, ", ").alias("kinds"))


@query(
    "e01_priority_sort_rank",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END, o_totalprice DESC, o_orderkey) AS rank FROM orders""",
)
def e01(spark, d):
    prio = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(9)
    slim = table(spark, d, "orders").select("o_orderstatus", prio.alias("prio"), "o_totalprice", "o_orderkey")
    return ranking.ranked(slim, ["o_orderstatus"], ["prio", F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "rank")


@query("e02_partition_topn", "SELECT r_name, o_orderkey, rank FROM (SELECT r_name, o_orderkey, row_number() OVER (PARTITION BY r_name ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE rank <= 10")
def e02(spark, d):
    o, c, n, r = _t(spark, d, "orders", "customer", "nation", "region")
    placed = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return ranking.top_n(placed.select("r_name", "o_orderkey", "o_totalprice"), ["r_name"], [F.desc("o_totalprice"), "o_orderkey"], 10).select("r_name", "o_orderkey", "rank")


@query(
    "e03_top5_two_orders",
    """SELECT l_partkey, l_orderkey, l_linenumber, recent, dear FROM (SELECT l_partkey, l_orderkey, l_linenumber,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey) AS recent,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS dear FROM lineitem) WHERE recent <= 5 OR dear <= 5""",
)
def e03(spark, d):
    by = lambda c: F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc(c), "l_orderkey", "l_linenumber", "l_suppkey")).cast("long")
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", by("l_shipdate").alias("recent"), by("l_extendedprice").alias("dear"))
    return li.where("recent <= 5 or dear <= 5")


@query("e04_bounded_flag", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY (text IS NOT NULL AND text <> ''), length(text), doc_id) <= 5 AS enrich FROM documents")
def e04(spark, d):
    size = F.length("text")
    docs = table(spark, d, "documents").select("doc_id", "source", (F.coalesce(size, F.lit(0)) > 0).alias("has"), size.alias("size"))
    first = ranking.top_n(docs, ["source"], ["has", "size", "doc_id"], 5).select("doc_id", F.lit(True).alias("enrich"))
    return docs.join(first, "doc_id", "left").select("doc_id", F.coalesce("enrich", F.lit(False)).alias("enrich"))


@query(
    "e05_failure_streaks",
    """SELECT user_id, min(event_id) AS start, count(*) AS length FROM (SELECT user_id, event_id, event_type, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 2""",
)
def e05(spark, d):
    return ranking.streaks(table(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error").where("length >= 2").select("user_id", "start", "length")


@query("e06_change_detect_lag", "SELECT event_id, user_id, previous FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous <> event_type")
def e06(spark, d):
    return ranking.changes(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type").select("event_id", "user_id", "previous")


@query("e07_keep_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS fingerprint FROM documents GROUP BY text")
def e07(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint")).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))


@query("f01_union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def f01(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    return o.select(F.col("o_custkey").alias("k")).unionAll(c.select("c_custkey"))


@query("f02_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def f02(spark, d):
    return f01(spark, d).distinct()


@query("f03_set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def f03(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    return c.select(F.col("c_custkey").alias("k")).subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("f04_intersect", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem")
def f04(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("k")).intersect(li.select("l_suppkey"))


@query("f05_ordered_distinct_terms", "SELECT lower(event_type) AS term, min(event_id) AS first_seen FROM events GROUP BY 1")
def f05(spark, d):
    return table(spark, d, "events").groupBy(F.lower("event_type").alias("term")).agg(F.min("event_id").alias("first_seen"))


@query("f06_insert_or_ignore", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def f06(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return store.insert_or_ignore(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), "c_custkey")
