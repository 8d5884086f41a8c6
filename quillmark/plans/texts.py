"""Text, dates, JSON, duplicates, recommendation, streams and extractors, with oracles where SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import extract
from quillmark.functions import text as X
from quillmark.operators import dedup, recommend, vectors
from quillmark.plans.catalog import query
from quillmark.plans.relational import c14
from quillmark.session import table
from quillmark.shared import apart
from quillmark.sources import html as html_source
from quillmark.streaming import jobs

VOCABULARY = ["the", "and", "tion", "der", "que", "ment", "ung", "license", "password"]
FIELDS = [("german", r"(^|[^a-z])(der|und)([^a-z]|$)"), ("french", r"(^|[^a-z])(le|les|que)([^a-z]|$)"), ("spanish", r"ción"), ("english", r"(^|[^a-z])the([^a-z]|$)")]


@query("g01_norm_title", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'postdoc: ' || p_name WHEN 3 THEN 'senior postdoc ' || p_name WHEN 4 THEN p_name WHEN 5 THEN 'lead ' || p_name END AS title FROM part")
def g01(spark, d):
    k = F.col("p_partkey") % 6
    lead = F.when(k == 0, "").when(k == 1, "  Post-Doctoral   Fellow in ").when(k == 2, "POSTDOC: ").when(k == 3, "Senior\tpost doctorate ").when(k == 4, "Research Associate for ").otherwise("Lead  ")
    return table(spark, d, "part").select("p_partkey", X.norm_title(F.concat(lead, F.initcap("p_name"))).alias("title"))


@query("g02_norm_inst", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'universite de geneve ' || lower(s_name) WHEN 1 THEN 'acme ' || lower(s_name) WHEN 2 THEN lower(s_name) || ' zurich' WHEN 3 THEN lower(s_name) ELSE lower(s_name) || ' theory' END AS name FROM supplier")
def g02(spark, d):
    k, n = F.col("s_suppkey") % 5, F.col("s_name")
    name = F.when(k == 0, F.concat(F.lit("The Université  de Genève, "), n)).when(k == 1, F.concat(F.lit("ACME "), n, F.lit(", Inc."))).when(k == 2, F.concat(n, F.lit(" Zürich GmbH"))).when(k == 3, F.concat(F.lit("the "), n)).otherwise(F.concat(n, F.lit(" Theory")))
    return table(spark, d, "supplier").select("s_suppkey", X.norm_institute(name).alias("name"))


@query(
    "g03_clean_text",
    """SELECT doc_id, sha256(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '(?m)^[ \\t\\n\\f\\r]*[-*_]{3,}[ \\t\\n\\f\\r]*$', ' | ', 'g'), '[*_#`]+', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g'), 1, 32000)) AS clean_sha FROM documents""",
)
def g03(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.clean_text("text"), 256).alias("clean_sha"))


@query("g04_clean_list", "SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(trim(text), '\\n[ \\t\\n\\x0B\\f\\r]*([-*•]|[0-9]+[.)])?[ \\t\\n\\x0B\\f\\r]*', '; ', 'g'), '^([-*•]|[0-9]+[.)])[ \\t\\n\\x0B\\f\\r]*', '')) AS list_sha FROM conversations")
def g04(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.clean_list("text"), 256).alias("list_sha"))


@query("g05_content_hash", "SELECT p_partkey, sha256(trim(regexp_replace(lower(p_name || ' ' || p_type), '\\s+', ' ', 'g'))) AS hash FROM part")
def g05(spark, d):
    return table(spark, d, "part").select("p_partkey", X.content_hash(F.concat_ws(" ", "p_name", "p_type")).alias("hash"))


@query(
    "g06_snippets",
    """SELECT doc_id, len(s)::INT AS n, sha256(array_to_string(list_transform(s, lambda x: substr(trim(x), 1, 500)), '|')) AS shown
 FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?][ \\t\\n\\x0B\\f\\r]+|\\n'), lambda s: length(trim(s)) > 20 AND (contains(lower(s), 'password') OR contains(lower(s), 'license'))) AS s FROM documents)""",
)
def g06(spark, d):
    found = X.snippets("text", ["password", "license"])
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.sha2(F.array_join(found, "|"), 256).alias("shown"))


@query("g07_strip_html")
def g07(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html("html").alias("text"))


@query("g08_url_parse_unwrap", "SELECT page_id, url AS target, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm FROM pages")
def g08(spark, d):
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://search.example/l/?kh=1&uddg="), F.url_encode("url"), F.lit("&rut=1"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", X.unwrapped(wrapped).alias("target"), X.url_host("url").alias("host"), X.url_query("url", "page").alias("page"), X.url_query("url", "utm_source").alias("utm"))


@query("g09_keywords_list", "SELECT doc_id, array_to_string(list_filter(['the', 'and', 'tion', 'der', 'que', 'ment', 'ung', 'license', 'password'], lambda w: contains(lower(text), w)), ', ') AS keywords FROM documents")
def g09(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.hits("text", VOCABULARY), ", ").alias("keywords"))


@query("g10_infer_field", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(der|und)([^a-z]|$)') THEN 'german' WHEN regexp_matches(lower(text), '(^|[^a-z])(le|les|que)([^a-z]|$)') THEN 'french' WHEN contains(lower(text), 'ción') THEN 'spanish' WHEN regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)') THEN 'english' ELSE 'other' END AS field FROM documents")
def g10(spark, d):
    return table(spark, d, "documents").select("doc_id", X.first_label("text", FIELDS, "other").alias("field"))


@query("g11_multi_label", "SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_name, 'gold') THEN 'metal' END, CASE WHEN contains(p_name, 'bolt') OR contains(p_name, 'ring') THEN 'hardware' END, CASE WHEN contains(p_name, 'small') THEN 'small' END) AS kinds FROM part")
def g11(spark, d):
    rules = [("metal", "gold"), ("hardware", "bolt|ring"), ("small", "small")]
    return table(spark, d, "part").select("p_partkey", F.array_join(X.labels("p_name", rules), ",").alias("kinds"))


@query("g12_emails_urls", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::INT AS n_emails, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS first_email FROM documents")
def g12(spark, d):
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({email})"))).alias("n_emails"), F.regexp_extract("text", email, 0).alias("first_email"))


@query("g13_dates_min", "SELECT o_custkey, min(o_orderdate)::DATE::VARCHAR AS earliest FROM orders GROUP BY 1")
def g13(spark, d):
    lines = table(spark, d, "orders").groupBy("o_custkey").agg(F.concat_ws(" due ", F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("t"))
    return lines.select("o_custkey", X.first_date("t").cast("string").alias("earliest"))


@query("g14_relative_dates", "SELECT event_id, (ts::DATE - (k * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'error' THEN 30 ELSE 365 END)::INT)::VARCHAR AS day FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)")
def g14(spark, d):
    unit = F.when(F.col("event_type") == "view", "day").when(F.col("event_type") == "click", "week").when(F.col("event_type") == "error", "month").otherwise("year")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", X.relative_date(F.col("ts"), k, unit).cast("string").alias("day"))


@query("g15_json_props", "SELECT event_id, (props->>'$.k')::INT AS k, '{\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}' AS packed FROM events")
def g15(spark, d):
    parsed = F.from_json("props", "k int")
    return table(spark, d, "events").select("event_id", parsed.k.alias("k"), F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("packed"))


@query("g16_levenshtein", "SELECT DISTINCT a.p_name AS x, b.p_name AS y, levenshtein(a.p_name, b.p_name)::INT AS distance FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_name < b.p_name")
def g16(spark, d):
    p = table(spark, d, "part").select("p_size", "p_brand", "p_name").distinct()
    q = p.withColumnRenamed("p_name", "y")
    return p.join(q, ["p_size", "p_brand"]).where("p_name < y").select(F.col("p_name").alias("x"), "y").distinct().withColumn("distance", F.levenshtein("x", "y"))


@query("g16_sequence_ratio")
def g16_ratio(spark, d):
    return g16(spark, d).select("x", "y", F.round(X.sequence_ratio("x", "y"), 6).alias("ratio"))


@query(
    "g17_keyword_score",
    """SELECT doc_id, round_even((contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'que')::INT + contains(lower(text), 'ment')::INT
 + contains(lower(text), 'ung')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'password')::INT) / 9.0::DOUBLE, 3) AS score FROM documents""",
)
def g17(spark, d):
    return table(spark, d, "documents").select("doc_id", X.keyword_score("text", VOCABULARY).alias("score"))


@query("g18_accent_fold", "SELECT doc_id, sha256(translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')) AS folded FROM documents")
def g18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.fold_latin("text"), 256).alias("folded"))


_SIGNATURE = """
WITH t AS (SELECT p_name || ' ' || p_brand || ' ' || p_type AS t, min(p_partkey) AS k FROM part GROUP BY 1),
s AS (SELECT DISTINCT k, ('0x' || substr(md5(substr(t, i::INT, 3)), 1, 8))::BIGINT % 2147483647 AS x FROM (SELECT k, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM t)),
m AS (SELECT k, p, min(((p * 1103515245 % 2147483647 + 1) * x + (p * 12345677 % 2147483647)) % 2147483647) AS v FROM s, (SELECT unnest(range(1, 129))::BIGINT AS p) GROUP BY 1, 2),
b AS (SELECT k, ((p - 1) // 8)::INT AS band, md5(string_agg(v::VARCHAR, ',' ORDER BY p)) AS digest FROM m GROUP BY 1, 2)
"""


def _titles(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t"))


@query("h01_shingle_minhash", _SIGNATURE + "SELECT k, md5(string_agg(v::VARCHAR, ',' ORDER BY p)) AS signature FROM m GROUP BY k")
def h01(spark, d):
    reps = dedup.representatives(_titles(spark, d), "k", "t")
    return dedup.signatures(reps, "k", "t").select("k", F.md5(F.array_join("signature", ",")).alias("signature"))


@query("h02_lsh_bands", _SIGNATURE + "SELECT k, band, digest FROM b")
def h02(spark, d):
    return dedup.banded(dedup.representatives(_titles(spark, d), "k", "t"), "k", "t")


@query("h03_lsh_pairs", _SIGNATURE + "SELECT DISTINCT x.k AS a, y.k AS b FROM b x JOIN b y ON x.band = y.band AND x.digest = y.digest AND x.k < y.k")
def h03(spark, d):
    return dedup.candidate_pairs(_titles(spark, d), "k", "t")


@query(
    "h04_verified_pairs",
    _SIGNATURE
    + """, c AS (SELECT DISTINCT x.k AS a, y.k AS b FROM b x JOIN b y ON x.band = y.band AND x.digest = y.digest AND x.k < y.k),
h AS (SELECT DISTINCT k, substr(md5(substr(t, i::INT, 3)), 1, 8) AS x FROM (SELECT k, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM t)),
z AS (SELECT k, count(*) AS n FROM h GROUP BY 1), o AS (SELECT a, b, count(*) AS i FROM c JOIN h p ON p.k = a JOIN h q ON q.k = b AND p.x = q.x GROUP BY 1, 2)
SELECT a, b, likeness FROM (SELECT a, b, round(i::DOUBLE / (u.n + v.n - i), 6) AS likeness FROM o JOIN z u ON u.k = a JOIN z v ON v.k = b) WHERE likeness >= 0.5""",
)
def h04(spark, d):
    texts = dedup.representatives(_titles(spark, d), "k", "t")
    a, b = (texts.select(F.col("k").alias(c), F.col("t").alias(f"t_{c}")) for c in "ab")
    pairs = dedup.candidate_pairs(_titles(spark, d), "k", "t").join(a, "a").join(b, "b")
    same = dedup.jaccard(dedup.shingle_hashes(F.col("t_a")), dedup.shingle_hashes(F.col("t_b")))
    return pairs.select("a", "b", F.round(same, 6).alias("likeness")).where("likeness >= 0.5")


#: Postings made of parts: each four have one origin, whose title, place and leader they give in several spellings.
_POSTINGS = """
WITH RECURSIVE p AS (SELECT a.p_partkey AS k, a.p_partkey % 4 AS v, md5('l' || b.p_partkey) AS m, b.p_name || ' ' || lower(b.p_type) || ' ' || substr(md5(b.p_partkey::VARCHAR), 1, 8) AS x, b.p_brand
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 4),
jobs AS (SELECT k, 'http://jobs/' || CASE WHEN k % 40 = 7 THEN 'shared' || k // 400 ELSE k::VARCHAR END AS url, CASE v WHEN 1 THEN 'Post-Doc position: ' ELSE 'Postdoctoral  fellow ' END || x AS title,
  CASE v WHEN 2 THEN '' ELSE 'Institute ' || substr(md5(p_brand), 1, 12) END AS institute, CASE v WHEN 0 THEN 'Ada ' || substr(m, 1, 6) WHEN 2 THEN 'ADA ' || upper(substr(m, 1, 6)) WHEN 3 THEN 'Bob ' || substr(m, 1, 6) END AS pi_name,
  repeat('d', (k * 7 % 13)::INT) AS description, CASE WHEN k % 3 = 0 THEN 'f' || k END AS field, CASE WHEN k % 5 = 0 THEN '' ELSE 'c' || k END AS country, 's' || k % 2 AS source FROM p),
n AS (SELECT k, url, title, institute, person, title || ' ' || institute || ' ' || person AS t FROM (SELECT k, url, regexp_replace(regexp_replace(regexp_replace(lower(title), '\\s+', ' ', 'g'), '\\bpost[\\s-]?doc(toral)?\\b', 'postdoc', 'g'), '^(?:postdoc|research)\\s+(?:position|fellow|researcher|associate)\\s*[-:–]?\\s*', '') AS title,
  lower(institute) AS institute, lower(coalesce(pi_name, '')) AS person FROM jobs)),
s AS (SELECT DISTINCT k, ('0x' || substr(md5(substr(t, i::INT, 3)), 1, 8))::BIGINT % 2147483647 AS x FROM (SELECT k, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM n)),
mh AS (SELECT k, q, min(((q * 1103515245 % 2147483647 + 1) * x + (q * 12345677 % 2147483647)) % 2147483647) AS v FROM s, (SELECT unnest(range(1, 129))::BIGINT AS q) GROUP BY 1, 2),
b AS (SELECT k, ((q - 1) // 8)::INT AS band, md5(string_agg(v::VARCHAR, ',' ORDER BY q)) AS digest FROM mh GROUP BY 1, 2),
c AS (SELECT x.k AS a, y.k AS b FROM b x JOIN b y ON x.band = y.band AND x.digest = y.digest AND x.k < y.k UNION SELECT x.k, y.k FROM n x JOIN n y ON x.person = y.person AND x.person <> '' AND x.k < y.k UNION SELECT x.k, y.k FROM n x JOIN n y ON x.url = y.url AND x.k < y.k),
lk AS (SELECT a, b, x.url = y.url AS same_url, x.person AS px, y.person AS py, x.institute AS ix, y.institute AS iy, 1 - levenshtein(x.title, y.title) / greatest(length(x.title), length(y.title))::DOUBLE AS t,
  CASE WHEN x.institute = '' OR y.institute = '' THEN 0.0::DOUBLE ELSE 1 - levenshtein(x.institute, y.institute) / greatest(length(x.institute), length(y.institute))::DOUBLE END AS p FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b),
e AS (SELECT a, b FROM lk WHERE same_url OR (NOT (px <> '' AND py <> '' AND px <> py) AND ((px = py AND px <> '' AND (t > 0.3 OR p > 0.3 OR ix = '' OR iy = '')) OR (ix = iy AND ix <> '' AND t >= CASE WHEN px <> '' AND py <> '' THEN 0.6 ELSE 0.85 END) OR 0.6 * t + 0.4 * p >= 0.85))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(k, r) AS (SELECT k, k FROM n UNION SELECT b, r FROM walk JOIN u ON a = k), g AS (SELECT k, min(r) AS grp FROM walk GROUP BY k)
"""


def _postings(spark, d):
    part = table(spark, d, "part")
    one = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
    k, v = F.col("k"), F.col("k") % 4
    p = part.select(F.col("p_partkey").alias("k")).join(apart(one), F.col("p_partkey") == F.col("k") - F.col("k") % 4)
    hashed = lambda c, n: F.substring(F.md5(c.cast("string")), 1, n)
    m = hashed(F.concat(F.lit("l"), F.col("p_partkey")), 6)
    x = F.concat_ws(" ", "name", F.lower("type"), hashed(F.col("p_partkey"), 8))
    return p.select(
        "k",
        F.concat(F.lit("http://jobs/"), F.when(k % 40 == 7, F.concat(F.lit("shared"), F.floor(k / 400))).otherwise(k.cast("string"))).alias("url"),
        F.concat(F.when(v == 1, "Post-Doc position: ").otherwise("Postdoctoral  fellow "), x).alias("title"),
        F.when(v == 2, "").otherwise(F.concat(F.lit("Institute "), hashed(F.col("brand"), 12))).alias("institute"),
        F.when(v == 0, F.concat(F.lit("Ada "), m)).when(v == 2, F.concat(F.lit("ADA "), F.upper(m))).when(v == 3, F.concat(F.lit("Bob "), m)).alias("pi_name"),
        F.repeat(F.lit("d"), (k * 7 % 13).cast("int")).alias("description"),
        F.when(k % 3 == 0, F.concat(F.lit("f"), k)).alias("field"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("c"), k)).alias("country"),
        F.concat(F.lit("s"), k % 2).alias("source"),
    )


@query("h04_dedup_components", _POSTINGS + "SELECT k, grp FROM g")
def h04_components(spark, d):
    return dedup.grouped(_postings(spark, d), "k", dedup.edit_likeness).select("k", "grp")


_FUSED = """, r AS (SELECT *, length(description) > coalesce(max(length(description)) OVER (PARTITION BY grp ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS won FROM jobs JOIN g USING (k)),
 o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY NOT won, CASE WHEN won THEN -k ELSE k END) AS place FROM r)
SELECT grp, max(k) FILTER (WHERE place = 1) AS k, max(title) FILTER (WHERE place = 1) AS title, coalesce(arg_min(pi_name, place) FILTER (WHERE pi_name <> ''), '-') AS pi_name,
 coalesce(arg_min(field, place) FILTER (WHERE field <> ''), '-') AS field, coalesce(arg_min(country, place) FILTER (WHERE country <> ''), '-') AS country, count(*) AS merged FROM o GROUP BY grp"""


@query("h05_dedup_fused", _POSTINGS + _FUSED)
def h05(spark, d):
    best = dedup.deduplicated(_postings(spark, d), "k", dedup.edit_likeness)
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return best.select("grp", "k", "title", dash("pi_name"), dash("field"), dash("country"), "merged")


@query("h06_dedup_sequence_ratio")
def h06(spark, d):
    return dedup.deduplicated(_postings(spark, d), "k").withColumn("alt_urls", F.to_json("alt_urls"))


@query("h07_dedup_in_order")
def h07(spark, d):
    return dedup.deduplicated(_postings(spark, d), "k", order="greedy").withColumn("alt_urls", F.to_json("alt_urls"))


@query(
    "d14_fuse_longest",
    """SELECT c_mktsegment || c_nationkey AS grp, arg_max(c_custkey, (length(c_name), -c_custkey)) AS c_custkey, arg_max(c_name, (length(c_name), -c_custkey)) AS c_name, count(*) AS merged FROM customer GROUP BY 1""",
)
def d14(spark, d):
    c = table(spark, d, "customer").withColumn("grp", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    return dedup.fuse(c, "grp", "c_custkey", "c_name", []).select("grp", "c_custkey", "c_name", "merged")


@query(
    "i01_tfidf",
    """WITH w AS (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM conversations), c AS (SELECT conv_id, term, count(*) AS tf FROM w WHERE length(term) >= 3 GROUP BY 1, 2),
n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1), x AS (SELECT conv_id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS v FROM c JOIN df USING (term), n)
SELECT conv_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY conv_id)), 6) AS weight FROM x""",
)
def i01(spark, d):
    return vectors.tfidf(table(spark, d, "conversations"), "conv_id", "text").withColumn("weight", F.round("weight", 6))


@query(
    "i03_feature_vectors",
    """WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM conversations), c AS (SELECT conv_id, term, count(*) AS tf FROM w WHERE term NOT IN ('the', 'and', 'of', 'to', 'in') GROUP BY 1, 2),
n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1), f AS (SELECT term, df FROM df, n WHERE df <= 0.95::DOUBLE * n ORDER BY total DESC, term LIMIT 500),
x AS (SELECT conv_id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS v FROM c JOIN f USING (term), n)
SELECT conv_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY conv_id)), 6) AS weight FROM x""",
)
def i03(spark, d):
    return vectors.feature_vectors(table(spark, d, "conversations"), "conv_id", "text", ["the", "and", "of", "to", "in"]).withColumn("weight", F.round("weight", 6))


@query(
    "i02_recommend",
    """WITH e AS (SELECT l_suppkey AS node, count(DISTINCT o_custkey) AS nbr, count(*) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), m AS (SELECT max(nbr) AS top FROM e),
 s AS (SELECT embedding AS sv FROM embeddings WHERE label = 0), v AS (SELECT vec_id, max(list_cosine_similarity(embedding::DOUBLE[], sv::DOUBLE[])) AS best FROM embeddings, s GROUP BY vec_id)
SELECT node, round_even(0.30 * coalesce(best, 0) + 0.25 * (1 - 1 / (1 + nbr * 0.5::DOUBLE + total * 0.1::DOUBLE)) + 0.15 * (1 - 1 / (1 + total * 0.3::DOUBLE)) + 0.10 * (CASE s_nationkey % 5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 WHEN 4 THEN 0.3 ELSE 0.15 END)
 + 0.20 * least(nbr / top::DOUBLE, 1.0), 4) AS score FROM e JOIN supplier ON node = s_suppkey LEFT JOIN v ON vec_id = node, m ORDER BY score DESC, node LIMIT 20""",
)
def i02(spark, d):
    e = c14(spark, d).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("nbr"), F.sum("citations").alias("total"))
    top = F.broadcast(e.agg(F.max("nbr").alias("top")))  # one row
    s = table(spark, d, "supplier")
    vectors = table(spark, d, "embeddings")
    best = recommend.nearest_seed(vectors, vectors.where("label = 0"), "vec_id", "embedding")
    placed = e.join(s, e.node == s.s_suppkey).join(best, F.col("vec_id") == F.col("node"), "left").join(top, F.lit(True))
    parts = {
        "similarity": F.col("best"),
        "connection": 1 - 1 / (1 + F.col("nbr") * 0.5 + F.col("total") * 0.1),
        "citation": recommend.saturating(F.col("total"), 0.3),
        "tier": recommend.tier_score(F.col("s_nationkey") % 5),
        "h_index": F.least(F.col("nbr") / F.col("top"), F.lit(1.0)),
    }
    return placed.select("node", recommend.composite(parts).alias("score")).orderBy(F.desc("score"), "node").limit(20)


@query("j01_tumbling", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def j01(spark, d):
    return jobs.tumbling(spark, d, "7 days")


@query(
    "j02_sliding",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR * o AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 3)) AS o) GROUP BY 1, 2",
)
def j02(spark, d):
    return jobs.sliding(spark, d, "3 hours", "1 hour")


@query(
    "j03_session",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 4 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS g FROM events)) GROUP BY user_id, s""",
)
def j03(spark, d):
    return jobs.sessions(spark, d, "4 hours")


@query("j04_dedup_watermark", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def j04(spark, d):
    return jobs.first_seen(spark, d)


@query("j05_change_state", "SELECT user_id, count(*) AS n_changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p <> event_type GROUP BY 1")
def j05(spark, d):
    return jobs.changes(spark, d)


@query("k01_posting_fields")
def k01(spark, d):
    return extract.posting(table(spark, d, "documents"), "doc_id", "text")


@query("k02_page_records")
def k02(spark, d):
    return html_source.records(table(spark, d, "pages"))


@query("k03_page_links")
def k03(spark, d):
    return html_source.links(table(spark, d, "pages"))
