"""Duplicate postings: blocks and MinHash bands for candidates, a decision for each, components, and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators.graph import components
from quillmark.shared import apart, counted, cut

# The modulus of the permutations, their number and the number of bands.
PRIME = (1 << 31) - 1
PERMUTATIONS, BANDS = 128, 16
#: Permutations whose minima one aggregate takes.
CHUNK = 32


def shingle_hashes(c: Column, width: int = 3) -> Column:
    """Portable 32-bit hashes of the distinct character shingles of a text (of all of it, if short)."""
    n = F.greatest(F.length(c) - (width - 1), F.lit(1))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(width))))
    return F.transform(parts, lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long"))


def signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, signature): the least value of every permutation (a * x + b) mod p, a and b from a rule.

    Shingles are exploded and the minima taken by aggregates of ``CHUNK`` permutations each, few enough columns for
    generated code; a chunk's minima are partially taken before its shuffle."""
    x = df.select(key, F.explode(shingle_hashes(F.col(text))).alias("x")).select(key, (F.col("x") % PRIME).alias("x"))
    chunks = PERMUTATIONS // CHUNK
    # the permutations of a chunk: k = chunk * CHUNK + 1 ... (chunk + 1) * CHUNK
    each = x.withColumn("chunk", F.explode(F.array(*map(F.lit, range(chunks)))))
    number = lambda i: (F.col("chunk") * CHUNK + (i + 1)).cast("long")
    value = lambda i: ((number(i) * 1_103_515_245 % PRIME + 1) * F.col("x") + number(i) * 12_345_677 % PRIME) % PRIME
    least = each.groupBy(key, "chunk").agg(*(F.min(value(i)).alias(f"m{i}") for i in range(CHUNK)))
    parts = least.select(key, F.struct("chunk", F.array(*(f"m{i}" for i in range(CHUNK))).alias("m")).alias("part"))
    return parts.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p.m)).alias("signature"))


def bands(sig: Column) -> Column:
    rows = PERMUTATIONS // BANDS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.md5(F.array_join(F.slice(sig, b * rows + 1, F.lit(rows)), ",")))


def banded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, band, digest) of every row."""
    return signatures(df, key, text).select(key, F.posexplode(bands(F.col("signature"))).alias("band", "digest"))


def representatives(df: DataFrame, key: str, text: str) -> DataFrame:
    """(text, key): the least key of each distinct text; equal texts need no comparison."""
    return df.groupBy(text).agg(F.min(key).alias(key))


def candidate_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): representatives of distinct texts that share a band, a before b. All pairs of a band are made: this is
    the report of candidates; ``deduplicated`` doesn't expand a group it has already joined."""
    found = banded(representatives(df, key, text), key, text)
    left, right = found.select("band", "digest", F.col(key).alias("a")), found.select("band", "digest", F.col(key).alias("b"))
    return left.join(right, ["band", "digest"]).where("a < b").select("a", "b").distinct()


def jaccard(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def fuse(df: DataFrame, group: str, key: str, longest: str, fill: list[str], also: list[str] | None = None) -> DataFrame:
    """One row a group, as if its rows were merged one by one in the order of ``key``: the row with the longest
    ``longest`` (the earliest of equals) wins, and its empty ``fill`` columns come from those merged before it, the
    last winner first, and then from those after it. ``merged`` is the number of rows it stands for.

    A row that was the longest so far when it came has won once; later winners go before earlier ones, and rows that
    never won follow in their order. Only lengths pass through the window that finds the winners.
    """
    also = also or []
    size = F.length(F.coalesce(F.col(longest), F.lit("")))
    so_far = Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    won = df.select(group, key, size.alias("size")).withColumn("top", F.max("size").over(so_far))
    ranked = won.select(key, (F.col("top").isNull() | (F.col("size") > F.col("top"))).alias("__won"))
    rows = df.join(apart(ranked), key)
    place = F.struct((~F.col("__won")).alias("lost"), F.when(F.col("__won"), -F.col(key)).otherwise(F.col(key)).alias("at"))
    firsts = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", place)).alias(f"__{c}") for c in fill]
    found = rows.groupBy(group).agg(F.min_by(F.struct(key, longest, *also), place).alias("r"), *firsts, F.count(F.lit(1)).alias("merged"))
    return found.select(group, f"r.{key}", f"r.{longest}", *(f"r.{c}" for c in also), *(F.col(f"__{c}").alias(c) for c in fill), "merged")


# The likenesses that decide whether two postings are one.
FULL_NAME = 0.3  # of title or place, for the same leader by full name
ONE_NAME = ((0.7, 0.0), (0.35, 0.3), (0.25, 0.5))  # (title, place), all of a pair exceeded, for a single shared name
SAME_PLACE = {True: 0.6, False: 0.85}  # of the title at one place, by whether both leaders are known
TITLE, PLACE, THRESHOLD = 0.6, 0.4, 0.85
SAME_LEADER_THERE = 0.4  # of the title, for one leader at one place
#: Titles of a block and place that one task meets with as many others.
SLICE = 512
# What a fused posting takes over from its duplicates where it has nothing itself.
FILL = ["pi_name", "deadline", "department", "field", "keywords", "requirements", "conditions", "country", "region", "scholar_url", "lab_url", "dept_url", "h_index", "citations"]


def same_posting(title: Column, place: Column, a: dict[str, Column], b: dict[str, Column], threshold: float = THRESHOLD) -> Column:
    """Whether two postings are one, from the likenesses of their titles and places and from who leads. ``a`` and ``b``
    have url, institute and person, normalised; an empty string is unknown.

    Two known leaders that differ settle it; the same leader lowers what title and place have to show.
    """
    known = (a["person"] != "") & (b["person"] != "")
    leader = known & (a["person"] == b["person"])
    placed = (a["institute"] != "") & (b["institute"] != "")
    place = F.when(placed, place).otherwise(0.0)
    words = F.filter(F.split(a["person"], r"\s+"), lambda w: w != "")
    full = (F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) > 1)
    by_full = leader & full & ((title > FULL_NAME) | (place > FULL_NAME) | ~placed)
    one = F.lit(False)
    for t, p in ONE_NAME:
        one = one | ((title > t) & (place > p if p else F.lit(True)))
    there = placed & (a["institute"] == b["institute"]) & (title >= F.when(known, SAME_PLACE[True]).otherwise(SAME_PLACE[False]))
    close = TITLE * title + PLACE * place >= threshold
    same_url = (a["url"] != "") & (a["url"] == b["url"])
    return same_url | (~(known & ~leader) & (by_full | (leader & ~full & one) | there | close))


def ratio(a: Column, b: Column) -> Column:
    """Likeness of two texts by their common blocks; of an empty one 0."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(X.sequence_ratio(a, b))


def edit_likeness(a: Column, b: Column) -> Column:
    """Likeness by edit distance, all in the JVM; of an empty text 0."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)).cast("double"))


def prepared(jobs: DataFrame, key: str) -> DataFrame:
    """(key, url, title, institute, person, text) of postings with url, title, institute and pi_name, normalised."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    title, place, person = X.dedup_title(clean("title")), X.dedup_institute(clean("institute")), F.lower(F.trim(clean("pi_name")))
    return jobs.select(F.col(key).cast("long").alias("k"), clean("url").alias("url"), title.alias("title"), place.alias("institute"), person.alias("person")).withColumn(
        "text", F.concat_ws(" ", "title", "institute", "person")
    )


def links(rows: DataFrame, likeness=ratio, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): links that join the duplicates among prepared ``rows``. Candidates share a url, a leader, or a band of
    the texts' signatures.

    Postings of one leader meet by the leader. In a band only those are left that can be one without: one of the two has
    no known leader, and, as a title alone doesn't reach the threshold, both have places, the same or alike enough. So
    they meet by band and place, and by those pairs of places. Members of a block first meet one of it only; then
    those pairs are made that are still in different groups: in a band, pairs of their titles, as nothing else decides there.
    Pairs are decided as they are made; only links are kept."""
    # postings alike in all that is compared are decided upon once; each but the least is tied to it
    what = ["title", "institute", "person"]
    kinds, _ = cut(rows.groupBy(*what, "text").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n")), "kinds")
    side = lambda df, s, *more: df.select(*more, *(F.col(c).alias(f"{c}_{s}") for c in ("k", *what)))
    title_alone = threshold <= TITLE  # then postings without a place may be one

    def decided(met: DataFrame, place: Column | None = None) -> DataFrame:
        """Those of the pairs that are one; ``place`` where the likeness of their places is known."""
        part = lambda s: {"url": F.lit(""), "institute": F.col(f"institute_{s}"), "person": F.col(f"person_{s}")}
        early = F.col("k_a") < F.col("k_b")  # likenesses depend on which text comes first: the earlier posting's
        met = met.select(*(F.when(early, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{o}")).alias(f"{c}_{s}") for s, o in ("ab", "ba") for c in ("k", *what)), *([place.alias("pl")] if place is not None else []))
        a, b = part("a"), part("b")
        x, y = F.col("title_a"), F.col("title_b")
        if place is not None and likeness in (ratio, edit_likeness):  # both are at most 1 less the edits' share of all characters
            bound = 1 - F.levenshtein(x, y) / F.greatest(F.length(x) + F.length(y), F.lit(1))
            met = met.where(TITLE * bound + PLACE * F.col("pl") >= threshold - 1e-9)
        told = met.withColumns({"tl": likeness(x, y), "pl": likeness(a["institute"], b["institute"]) if place is None else F.col("pl")})
        # one leader at one place needs less of the title
        there = (a["person"] != "") & (a["person"] == b["person"]) & (a["institute"] != "") & (a["institute"] == b["institute"]) & (F.col("tl") > SAME_LEADER_THERE)
        return told.where(there | same_posting(F.col("tl"), F.col("pl"), a, b, threshold)).select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()

    alone = decided(side(kinds.where("n > 1"), "a").join(apart(side(kinds.where("n > 1"), "b")), F.col("k_a") == F.col("k_b"))).select(F.col("a").alias("least"))
    copies = rows.join(apart(kinds.where("n > 1").select(*what, F.col("k").alias("least"))), what).join(apart(alone), "least").where("k <> least").select(F.col("k").alias("a"), F.col("least").alias("b"))
    urls = rows.where("url <> ''").groupBy("url").agg(F.min("k").alias("first"))
    linked, _ = cut(copies.unionByName(rows.join(apart(urls), "url").where("k <> first").select(F.col("k").alias("a"), F.col("first").alias("b"))), "links")

    placed = kinds if title_alone else kinds.where("institute <> ''")
    bands = banded(placed.select("k", "text"), "k", "text").select(F.concat_ws("-", "band", "digest").alias("block"), "k").join(apart(placed), "k")
    useful = bands.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.min("person").alias("least")).where("m > 1 and least = ''").select("block")
    bands, _ = cut(bands.join(apart(useful), "block").select("block", "k", *what), "bands")
    led = kinds.where("person <> ''").select(F.col("person").alias("block"), "k", *what)

    def first(df: DataFrame, key: list[str]) -> DataFrame:
        """Every member of a block with one member of it, of no known leader if there is such."""
        one = df.groupBy(*key).agg(F.min(F.struct((F.col("person") != "").alias("known"), "k", *what)).alias("o"), F.count(F.lit(1)).alias("m")).where("m > 1")
        centre = one.select(*(F.col(c).alias(f"__{c}") for c in key), *(F.col(f"o.{c}").alias(f"{c}_a") for c in ("k", *what)))
        on = [F.col(f"__{c}") == F.col(c) for c in key]
        keep = [F.col(f"{c}_{s}") for s in "ab" for c in ("k", *what)]
        return df.join(apart(centre), on).select(*(F.col(f"{c}_a") for c in ("k", *what)), *(F.col(c).alias(f"{c}_b") for c in ("k", *what))).select(*keep).where("k_a <> k_b")

    unled = (F.col("person_a") == "") | (F.col("person_b") == "")
    by_place = decided(first(bands, ["block", "institute"]).where(unled & (F.lit(True) if title_alone else F.col("institute_a") != "")), F.when(F.col("institute_a") != "", 1.0).otherwise(0.0))
    met, _ = cut(decided(first(led, ["block"])).unionByName(by_place), "met")
    roots, _ = cut(components(linked.unionByName(met)), "roots")

    def open_(df: DataFrame, key: list[str]) -> DataFrame:
        """The members of blocks with more than one group, with their groups."""
        held = df.join(apart(roots.withColumnRenamed("node", "k")), "k", "left").withColumn("root", F.coalesce("root", "k"))
        return held.join(apart(held.groupBy(*key).agg((F.min("root") < F.max("root")).alias("open")).where("open").select(*key)), key)

    def both(df: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
        return tuple(side(df, s, *key, F.col("root").alias(f"root_{s}")) for s in "ab")

    x, y = both(open_(led, ["block"]), "block")
    led_rest = decided(x.join(apart(y), "block").where("k_a < k_b and root_a <> root_b"))
    held, _ = cut(open_(bands, ["block"]), "open")
    there = held.select("block", "institute").distinct()
    two = there.withColumnRenamed("institute", "i").join(apart(there.withColumnRenamed("institute", "j")), "block").where("i <> j").select("i", "j").distinct()
    alike = lambda i, j: F.when((F.col(i) == "") | (F.col(j) == ""), 0.0).otherwise(likeness(F.col(i), F.col(j)))
    near = two.withColumns({"p": alike("i", "j"), "q": alike("j", "i")}).where(TITLE + PLACE * F.greatest("p", "q") >= threshold - 1e-9)
    own = held.select(F.col("institute").alias("i")).distinct().select("i", F.col("i").alias("j"), *(F.when(F.col("i") != "", 1.0).otherwise(0.0).alias(c) for c in "pq"))
    places, _ = cut(near.unionByName(own), "places")
    titles, _ = cut(titled(held), "titles")
    banded_rest = decided_titles(title_pairs(titles, places), likeness, threshold)
    return linked.unionByName(met).unionByName(led_rest).unionByName(banded_rest)


def titled(held: DataFrame) -> DataFrame:
    """The titles of ``held`` (block, k, title, institute, person, root) by block, place and group, with the least and the
    greatest key of all their postings and of those without a known leader."""
    led = F.when(F.col("person") == "", F.col("k"))
    return held.groupBy("block", "institute", "title", "root").agg(F.min("k").alias("kmin"), F.max("k").alias("kmax"), F.min(led).alias("umin"), F.max(led).alias("umax"))


def title_pairs(titles: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of ``titled`` rows (columns _a and _b) of one block and different groups, of which the first has a posting without a
    known leader, for each pair (i, j, p, q) of ``places``. Both sides of a block and place are dealt in slices, so that no task has a
    whole one: of two slices the rows meet in one place."""
    spark = titles.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    size, _ = cut(titles.groupBy("block", F.col("institute").alias("j")).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("s")), "slices")
    columns = ["institute", "title", "root", "kmin", "kmax", "umin", "umax"]
    side = lambda df, c, *more: df.select("block", "j", *more, *(F.col(x).alias(f"{x}_{c}") for x in columns))
    number, every = F.pmod(F.xxhash64("kmin"), "s").cast("int"), F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    x = titles.where("umin is not null").join(apart(places.withColumnRenamed("i", "institute"), counted(places)), "institute").join(apart(size), ["block", "j"])
    x = side(x.withColumns({"v": number, "w": every}), "a", "p", "q", "v", "w")
    y = side(titles.withColumn("j", F.col("institute")).join(apart(size), ["block", "j"]).withColumns({"w": number, "v": every}), "b", "v", "w")
    key = ["block", "j", "v", "w"]
    return x.repartition(n, *key).join(apart(y.repartition(n, *key)), key).where("root_a <> root_b and (umin_b is null or kmin_a < kmin_b)")


def decided_titles(pairs: DataFrame, likeness, threshold: float) -> DataFrame:
    """(a, b): links for those of ``title_pairs`` with postings, one of them without a known leader, that are one."""
    x, y = F.col("title_a"), F.col("title_b")
    if likeness in (ratio, edit_likeness):  # one is at most 1 less the edits' share of all characters, the other is that of the longer text
        least = F.least((threshold - PLACE * F.greatest("p", "q")) / TITLE, F.when(F.col("institute_a") == F.col("institute_b"), SAME_PLACE[False]))
        size = F.greatest(F.length(x), F.length(y)) if likeness is edit_likeness else F.length(x) + F.length(y)
        most = F.greatest(F.floor((1 - least) * size + 1e-6), F.lit(0)).cast("int")
        pairs = pairs.where(F.call_function("levenshtein", x, y, most) >= 0)  # -1 beyond so many edits
    # likenesses depend on which text comes first: the earlier posting's, and either title may have that
    a_first = (F.col("umin_a") < F.col("kmax_b")) | F.coalesce(F.col("kmin_a") < F.col("umax_b"), F.lit(False))
    b_first = (F.col("kmin_b") < F.col("umax_a")) | F.coalesce(F.col("umin_b") < F.col("kmax_a"), F.lit(False))
    order = lambda s, o, p: F.struct(F.col(f"title_{s}").alias("x"), F.col(f"title_{o}").alias("y"), F.col(f"institute_{s}").alias("i"), F.col(f"institute_{o}").alias("j"), F.col(p).alias("pl"))
    ways = F.array_compact(F.array(F.when(a_first, order("a", "b", "p")), F.when(b_first, order("b", "a", "q"))))
    told = pairs.select("kmin_a", "kmin_b", F.explode(ways).alias("o")).select("kmin_a", "kmin_b", "o.*").withColumn("tl", likeness(F.col("x"), F.col("y")))
    part = lambda c: {"url": F.lit(""), "institute": F.col(c), "person": F.lit("")}
    return told.where(same_posting(F.col("tl"), F.col("pl"), part("i"), part("j"), threshold)).select(F.col("kmin_a").alias("a"), F.col("kmin_b").alias("b")).distinct()


def grouped(jobs: DataFrame, key: str, likeness=ratio, threshold: float = THRESHOLD) -> DataFrame:
    """``jobs`` with ``grp``, the least key of each posting's duplicates."""
    rows, _ = cut(prepared(jobs, key), "prepared")
    roots = components(links(rows, likeness, threshold))
    return jobs.join(apart(roots.select(F.col("node").alias("__k"), "root")), F.col(key).cast("long") == F.col("__k"), "left").withColumn("grp", F.coalesce("root", F.col(key).cast("long"))).drop("__k", "root")


def deduplicated(jobs: DataFrame, key: str, likeness=ratio, threshold: float = THRESHOLD, fill: list[str] | None = None, order: str = "components") -> DataFrame:
    """One posting for each group of duplicates, fused in the order of ``key``, with ``merged`` and ``alt_urls``: the
    (url, source) of the others that came from other sources, where a leader is known.

    By default groups are connected components: postings that only a third one ties together are one, in whatever order
    they came. With ``order="greedy"`` postings come one by one in the order of ``key``, and each joins the first group it
    is found to belong to, as that group stands by then (``greedy.ordered_groups``; likenesses are those of ``ratio``).
    """
    if order == "greedy":
        from quillmark.operators.greedy import ordered_groups

        placed_ = ordered_groups(jobs, key, threshold).withColumnRenamed("k", "__k")
        held, _ = cut(jobs.join(apart(placed_), F.col(key).cast("long") == F.col("__k")).drop("__k"), "grouped")
    else:
        held, _ = cut(grouped(jobs, key, likeness, threshold), "grouped")
    fill = [c for c in (FILL if fill is None else fill) if c in jobs.columns]
    also = [c for c in jobs.columns if c not in (key, "description", *fill)]
    best = fuse(held, "grp", key, "description", fill, also)
    size = F.length(F.coalesce("description", F.lit("")))
    slim = held.select("grp", F.col(key).alias("at"), "url", "source", (F.coalesce("pi_name", F.lit("")) != "").alias("led"), size.alias("size"))
    so_far = Window.partitionBy("grp").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    marked = slim.withColumn("top", F.max("size").over(so_far)).withColumn("won", F.col("top").isNull() | (F.col("size") > F.col("top")))
    last = marked.where("won").groupBy("grp").agg(F.max("at").alias("best_at"), F.max_by("source", "at").alias("best_source"))
    told = marked.join(apart(last), "grp")
    before = told.where("at < best_at").groupBy("grp", "best_source").agg(F.max_by(F.struct("url", "source"), F.when(F.col("won"), F.col("at"))).alias("x"), F.max(F.col("at")).alias("at"), F.max("led").alias("led"))
    prior = before.select("grp", F.struct(F.lit(-1).cast("long").alias("at"), "x.url", "x.source").alias("alt"), (F.col("led") & ~F.col("x.source").eqNullSafe(F.col("best_source"))).alias("ok"))
    after = told.where("at > best_at").select("grp", F.struct(F.col("at").cast("long").alias("at"), "url", "source").alias("alt"), (F.col("led") & ~F.col("source").eqNullSafe(F.col("best_source"))).alias("ok"))
    alts = prior.unionByName(after).where(F.col("ok") & (F.coalesce("alt.url", F.lit("")) != "")).groupBy("grp").agg(F.sort_array(F.collect_list("alt")).alias("alts"))
    listed = F.coalesce(F.transform("alts", lambda a: F.struct(a.url.alias("url"), a.source.alias("source"))), F.array().cast("array<struct<url:string,source:string>>"))
    return best.join(apart(alts), "grp", "left").withColumn("alt_urls", listed).drop("alts").select(*jobs.columns, "grp", "merged", "alt_urls")
