"""Line dedup over a suffix array of line ids, in DataFrame functions only.

Lines become ids, and the suffixes of every document's id sequence are sorted by prefix doubling: the rank
of a suffix by its first 2p lines is that by its first p, refined by the rank of the suffix p lines on, until no two
are alike. A document's end, and every line that occurs once, equals nothing. Ranks are places in ranges of the
order, by which rows are dealt, so that a line that begins most suffixes is spread over tasks.

Neighbours in the array tell how many lines they share; the suffixes between two places where that is less than l are
an interval of common prefixes at least l long. All its members but the earliest are later copies.

A repeated run counts if it has ``LINES`` lines, or ``WORDS`` words. Lines under any counting run with an earlier
occurrence (by doc_id, then line) are deleted; runs that overlap or meet make up the longest ones.

Defined results: a null text has no lines and stays null; an empty one has a single, empty line; null
ids come first; of rows of one id the order is that of their texts' hashes; repeated rows are copies of
each other; a text that is repeated as a whole becomes empty; a very long text is as many rows as it has
lines, dealt like those of others, and a very long line a hash; an empty table gives an empty table; extra columns are kept by ``without_repeats``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import cut, placed, plain, ranges, renamed

LINES = 4
WORDS = 50
_FIRST = -(1 << 63)
_DOC = ["a", "w"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with __a and __w, which name a row and order rows. A window over whole rows is only
    needed, and only then made, if some row occurs more than once."""
    text = F.col(f"`{text_col}`").cast("string")
    out = docs.withColumns({"__a": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_FIRST)), "__w": F.xxhash64(text)})
    if out.groupBy("__a", "__w").count().where("count > 1").isEmpty():
        return out
    again = Window.partitionBy("__a", "__w").orderBy(F.lit(0))
    n = F.row_number().over(again)
    return out.withColumn("__n", n).withColumn("__w", F.when(F.col("__n") > 1, F.xxhash64("__w", "__n")).otherwise(F.col("__w"))).drop("__n")


def line_table(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, w, i, h, g, n): the lines of each row, with two hashes and the number of words."""
    line = F.col("line")
    words = F.when(F.btrim(line) == "", 0).otherwise(F.size(F.split(F.btrim(line), "[ \\t\\r\\f\\x0b]+")))
    return rows.select(F.col("__a").alias("a"), F.col("__w").alias("w"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("i", "line")).select(
        "a", "w", "i", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"), words.cast("long").alias("n")
    )


def in_order(rows: DataFrame, by: list, name: str, n: int) -> DataFrame:
    """``rows`` dealt to ``n`` ranges of ``by`` and written, with ``part`` and ``at``, their places in that order from 0.
    Equal rows are told apart by ``by``, so a common value is spread over ranges."""
    spark = rows.sparkSession
    dealt, _ = cut(rows.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()).coalesce(n), name)
    sizes = sorted(map(tuple, dealt.groupBy("part").agg(F.count(F.lit(1))).collect()))  # a row for each range
    bases, before = [], 0
    for part, size in sizes:
        bases.append((part, before))
        before += size
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    return placed(dealt, n=n).withColumn("k", at).join(base, "part").withColumn("at", F.col("base") + F.col("k")).drop("base", "k")


def _told(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a row for each range


def first_ranks(lines: DataFrame, least_lines: int = LINES) -> DataFrame:
    """(a, w, i, r, b, w1, w2, ...) of the lines that occur more than once: r ranks the line among them, b the line
    before it, if that one does as well, and w1 to w``least_lines`` count the words of so many such lines from here on."""
    counts, _ = cut(lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    ordered = in_order(counts, ["h", "g"], "sorted", ranges(lines.sparkSession, counts.count()))
    sums = ordered.groupBy("part").agg(F.sum("c"))
    bases, before = [], 0
    for part, c in sorted(map(tuple, sums.collect())):
        bases.append((part, before))
        before += c
    so_far = Window.partitionBy("part").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, -1)
    ranks, _ = cut(
        ordered.withColumn("s", F.coalesce(F.sum("c").over(so_far), F.lit(0))).join(_told(lines.sparkSession, bases, "part int, base long"), "part").select("h", "g", (F.col("s") + F.col("base")).alias("r")), "ranks"
    )
    doc = Window.partitionBy(*_DOC).orderBy("i")
    before = F.when(F.lag("i").over(doc) == F.col("i") - 1, F.lag("r").over(doc))
    upto = lambda l: doc.rowsBetween(0, l - 1)  # noqa: E731, E741
    words = [F.when(F.max("i").over(upto(l)) == F.col("i") + (l - 1), F.sum("n").over(upto(l))).alias(f"w{l}") for l in range(1, least_lines + 1)]  # noqa: E741
    return lines.join(ranks, ["h", "g"]).select(*_DOC, "i", "r", before.alias("b"), *words)


def doubled(ranked: DataFrame, tied: DataFrame, p: int, n: int) -> DataFrame:
    """From the ranks of all suffixes by their first p lines to those by 2p of the ``tied`` ones (a, w, i, r), in ``n``
    ranges: with whether they still are. A suffix is ranked by its own rank, then by that of the suffix p lines
    on; where there is none, the suffix ends there, which equals nothing and goes first."""
    spark = ranked.sparkSession
    ahead = ranked.select(*_DOC, (F.col("i") - p).cast("int").alias("i"), F.col("r").alias("y"))
    pairs = tied.select(*_DOC, "i", F.col("r").alias("x")).join(ahead, [*_DOC, "i"], "left")
    order = ["x", F.col("y").asc_nulls_first(), *_DOC, "i"]
    ordered = in_order(pairs, order, "pairs", n)
    w = Window.partitionBy("part").orderBy("at")
    x, y = F.lag("x").over(w), F.lag("y").over(w)
    marked, _ = cut(
        ordered.withColumns({"head": F.lag("at").over(w).isNull(), "nx": ~F.col("x").eqNullSafe(x), "ny": ~(F.col("x").eqNullSafe(x) & F.coalesce(F.col("y") == y, F.lit(False)))}), "marked"
    )
    # what a range goes on with from the one before: the group and subgroup of its first row, and whether they go on
    ends = marked.groupBy("part").agg(
        F.min_by(F.struct("x", "y"), "at").alias("first"), F.max_by(F.struct("x", "y"), "at").alias("last"), F.max(F.when(F.col("nx"), F.col("at"))).alias("x0"), F.max(F.when(F.col("ny"), F.col("at"))).alias("y0")
    )
    rows, carried, x0, y0, last = sorted(ends.collect(), key=lambda r: r.part), [], None, None, None
    for k, r in enumerate(rows):
        same_x = last is not None and r.first.x == last.x
        same_y = same_x and r.first.y is not None and r.first.y == last.y
        following = rows[k + 1].first if k + 1 < len(rows) else None
        goes_on = following is not None and following.x == r.last.x and r.last.y is not None and following.y == r.last.y
        carried.append((r.part, same_x, same_y, x0, y0, goes_on))
        # the range's first row is marked as new, which it is only if nothing is carried into it
        only_x, only_y = r.x0, r.y0
        x0 = x0 if same_x and r.first.x == r.last.x else only_x
        y0 = y0 if same_y and (r.first.x, r.first.y) == (r.last.x, r.last.y) else only_y
        last = r.last
    told = placed(marked, n=n).join(_told(spark, carried, "part int, same_x boolean, same_y boolean, x0 long, y0 long, goes_on boolean"), "part")
    told = told.withColumns({"nx": F.col("nx") & ~(F.col("head") & F.col("same_x")), "ny": F.col("ny") & ~(F.col("head") & F.col("same_y"))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gx = F.coalesce(F.max(F.when(F.col("nx"), F.col("at"))).over(upto), F.col("x0"))
    gy = F.coalesce(F.max(F.when(F.col("ny"), F.col("at"))).over(upto), F.col("y0"))
    after = F.coalesce(~F.lead("ny").over(w), F.col("goes_on"))
    return cut(told.select(*_DOC, "i", (F.col("x") + gy - gx).alias("r"), (~F.col("ny") | after).alias("more")), "ranked")[0]


def suffix_array(first: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((a, w, i, r) of every suffix that begins with a repeated line, in the order of r and, for what ends alike, of
    place; the levels: k-th (a, w, i, r), ranks by the first 2^k lines of those that share them with another).

    Prefixes double until no two suffixes are alike, however long a run occurs again."""
    spark, ranked = first.sparkSession, first.select(*_DOC, "i", "r")
    left = among = first.count()
    levels, settled, seen, p = [ranked], [], [], 1
    every = lambda frames: reduce(DataFrame.unionByName, frames)
    while True:
        new = doubled(ranked, levels[-1], p, ranges(spark, left))
        now, done, tied = (new.where(x).select(*_DOC, "i", "r") for x in ("true", "not more", "more"))
        left = new.where("more").count()
        if not left:
            return every([now, *settled]), levels
        settled.append(done)
        seen.append(done)
        if 4 * left < among:  # from here on only documents that have tied suffixes are looked up
            open_ = tied.select(*_DOC).distinct()
            seen, among = [cut(every(seen).join(open_, _DOC, "left_semi").coalesce(ranges(spark, among)), "seen")[0]], left
        ranked = every([tied, *seen])
        levels.append(tied)
        p *= 2


def common_prefixes(first: DataFrame, ranked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(a, w, i, part, at, lcp, and the words of ``first``): the suffix array with the number of lines that each suffix
    shares with the one before it in the array.

    Where the lines before the two are the same, the number is one less than that of the suffix one line earlier;
    only the others, at which a repeated run begins, are worked out, through the levels from the longest down."""
    spark = first.sparkSession
    words = [c for c in first.columns if c[0] == "w" and c != "w"]
    rows = ranked.join(first.select(*_DOC, "i", F.col("r").alias("r1"), "b", *words), [*_DOC, "i"])
    ordered = in_order(rows, ["r", *_DOC, "i"], "array", ranges(spark, first.count()))
    w = Window.partitionBy("part").orderBy("at")
    own = F.struct(*_DOC, "i", "r1", "b")
    array, _ = cut(ordered.withColumn("prev", F.lag(own).over(w)), "array")
    lasts = sorted(array.groupBy("part").agg(F.max_by(own, "at").alias("x")).collect(), key=lambda r: r.part)
    told = [(r.part, tuple(p.x) if p is not None else None) for r, p in zip(lasts, [None, *lasts])]
    carry = _told(spark, told, "part int, carried struct<a:long,w:long,i:int,r1:long,b:long>")
    pairs = array.join(carry, "part").withColumn("prev", F.coalesce("prev", "carried")).drop("carried")
    meets = F.coalesce(F.col("prev.r1") == F.col("r1"), F.lit(False))
    follows = F.coalesce(F.col("prev.b") == F.col("b"), F.lit(False))
    pairs, _ = cut(pairs.coalesce(ranges(spark, first.count())).select(*_DOC, "i", "part", "at", "prev", *words, meets.alias("meets"), (meets & follows).alias("follows")), "neighbours")
    open_ = pairs.where("meets and not follows").select(*_DOC, "i", F.col("prev.a").alias("a2"), F.col("prev.w").alias("w2"), F.col("prev.i").alias("i2"), F.lit(0).alias("lcp"))
    few = ranges(spark, open_.count())  # files; where runs begin there are few rows
    for k in reversed(range(len(levels))):
        mine = levels[k].select(F.col("a"), F.col("w"), F.col("i").alias("j"), F.col("r").alias("r_1"))
        theirs = levels[k].select(F.col("a").alias("a2"), F.col("w").alias("w2"), F.col("i").alias("j2"), F.col("r").alias("r_2"))
        met = open_.withColumns({"j": F.col("i") + F.col("lcp"), "j2": F.col("i2") + F.col("lcp")}).join(mine, [*_DOC, "j"], "left").join(theirs, ["a2", "w2", "j2"], "left")
        open_, _ = cut(met.select(*_DOC, "i", "a2", "w2", "i2", (F.col("lcp") + F.when(F.col("r_1") == F.col("r_2"), 1 << k).otherwise(0)).alias("lcp")).coalesce(few), "lcp")
    known = pairs.join(open_.select(*_DOC, "i", F.col("lcp").alias("known")), [*_DOC, "i"], "left")
    # in the order of the text: what follows a run's begin is one less at each line
    begin = F.when(~F.col("meets"), F.col("i")).when(~F.col("follows"), F.col("known") + F.col("i"))
    so_far = Window.partitionBy(*_DOC).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return cut(known.select(*_DOC, "i", "part", "at", *words, F.when(~F.col("meets"), 0).otherwise(F.last(begin, True).over(so_far) - F.col("i")).alias("lcp")), "prefixes")[0]


def later_copies(lines: DataFrame, least_lines: int = LINES, least_words: int = WORDS) -> DataFrame:
    """(a, w, i, l): runs of l lines from line i that count and have an earlier occurrence.

    The suffixes between two places where fewer than l lines are shared are an interval of common prefixes; all
    its members but the earliest are later copies. An interval counts if l is ``least_lines``, or its lines have
    ``least_words`` words. Longer runs are made up by those that begin at each of their lines."""
    spark = lines.sparkSession
    first, _ = cut(first_ranks(lines, least_lines), "repeated")
    ranked, levels = suffix_array(first)
    rows = common_prefixes(first, ranked, levels)
    depths = range(1, least_lines + 1)
    breaks = [F.max(F.when(F.col("lcp") < l, F.col("at"))).alias(f"b{l}") for l in depths]  # noqa: E741
    carried, last = [], [None] * len(depths)
    for r in sorted(rows.groupBy("part").agg(*breaks).collect(), key=lambda r: r.part):  # a row for each range
        carried.append((r.part, *last))
        last = [r[f"b{l}"] if r[f"b{l}"] is not None else old for l, old in zip(depths, last)]  # noqa: E741
    told = placed(rows, n=ranges(spark, rows.count())).join(_told(spark, carried, "part int, " + ", ".join(f"c{l} long" for l in depths)), "part")  # noqa: E741
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = told.select(*_DOC, "i", *(f"w{l}" for l in depths), *(F.coalesce(F.max(F.when(F.col("lcp") < l, F.col("at"))).over(upto), F.col(f"c{l}")).alias(f"v{l}") for l in depths))  # noqa: E741
    each = F.array(*(F.struct(F.lit(l).alias("l"), F.col(f"v{l}").alias("v"), F.col(f"w{l}").alias("words")) for l in depths))  # noqa: E741
    counting = named.select(*_DOC, "i", F.explode(each).alias("x")).select(*_DOC, "i", "x.*").where((F.col("l") == least_lines) | (F.col("words") >= least_words)).where("words is not null")
    counting, _ = cut(counting.drop("words"), "intervals")
    earliest = counting.groupBy("l", "v").agg(F.min(F.struct(*_DOC, "i")).alias("f")).select("l", "f.*")
    return counting.select(*_DOC, "i", "l").join(earliest, [*_DOC, "i", "l"], "left_anti")


def deletions(lines: DataFrame, least_lines: int = LINES, least_words: int = WORDS) -> DataFrame:
    """(a, w, gone): for each row that loses lines, its stretches [start, end), in order."""
    copies = later_copies(lines, least_lines, least_words).groupBy(*_DOC, "i").agg(F.max(F.col("i") + F.col("l")).alias("end"))
    before = Window.partitionBy(*_DOC).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*_DOC).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.coalesce(F.max("end").over(before), F.lit(-1)) < F.col("i")).cast("int")
    return (
        copies.withColumn("new", starts)
        .withColumn("k", F.sum("new").over(upto))
        .groupBy(*_DOC, "k")
        .agg(F.min("i").alias("start"), F.max("end").alias("end"))
        .groupBy(*_DOC)
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    )


def kept_text(text: Column, gone: Column) -> Column:
    """The lines outside of ``gone``, joined again: one slice for each gap between stretches."""
    lines = F.split(text, "\n")
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g.end))
    starts = F.concat(F.transform(gone, lambda g: g.start), F.array(F.size(lines)))
    gaps = F.arrays_zip(ends.alias("a"), starts.alias("b"))
    return F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g.a + 1, g.b - g.a))), "\n")


def marked(docs: DataFrame, least_lines: int = LINES, least_words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with __gone: the stretches of lines that each row loses, or null."""
    rows = keyed(docs, id_col, text_col)
    lines, _ = cut(line_table(rows, text_col), "lines")
    gone, _ = cut(deletions(lines, least_lines, least_words), "gone")
    named = gone.select(F.col("a").alias("__a"), F.col("w").alias("__w"), F.col("gone").alias("__gone"))
    return rows.join(named.hint("merge"), ["__a", "__w"], "left").drop("__a", "__w")  # by one plan at every size


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the lines of later copies."""
    rows, short = plain(docs)
    text = F.col(short[text_col])
    found = marked(rows, id_col=short[id_col], text_col=short[text_col], **more)
    return renamed(found.withColumn(short[text_col], F.when(F.col("__gone").isNull(), text).otherwise(kept_text(text, F.col("__gone")))), docs)


def query(docs: DataFrame) -> DataFrame:
    """For every document its lines, how many are deleted, where, and the digest of what stays."""
    found = marked(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    gone = F.coalesce("__gone", F.array().cast("array<struct<start:int,end:int>>"))
    total = F.aggregate(gone, F.lit(0).cast("long"), lambda n, g: n + (g.end - g.start))
    ranges = F.array_join(F.transform(gone, lambda g: F.concat_ws("-", g.start.cast("string"), g.end.cast("string"))), ",")
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("__gone")))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return found.select("doc_id", n.alias("n_lines"), total.alias("n_deleted"), ranges.alias("deleted"), F.sha2(kept, 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, i, line,
         CASE WHEN trim(line, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(line, ' '), '[ \\t\\r\\f\\x0b]+')) END AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
), ahead AS (
  SELECT *, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2, lead(line, 3) OVER d AS l3,
         lead(n, 1) OVER d AS n1, lead(n, 2) OVER d AS n2 FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), wins AS (
  SELECT doc_id, i, 1 AS l, [line] AS k FROM ahead WHERE n >= 50
  UNION ALL SELECT doc_id, i, 2, [line, l1] FROM ahead WHERE l1 IS NOT NULL AND n + n1 >= 50
  UNION ALL SELECT doc_id, i, 3, [line, l1, l2] FROM ahead WHERE l2 IS NOT NULL AND n + n1 + n2 >= 50
  UNION ALL SELECT doc_id, i, 4, [line, l1, l2, l3] FROM ahead WHERE l3 IS NOT NULL
), later AS (
  SELECT doc_id, i, l FROM (SELECT *, row_number() OVER (PARTITION BY l, k ORDER BY doc_id, i) AS occ FROM wins) WHERE occ > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest([0, 1, 2, 3]) AS o) WHERE o < l
), marks AS (
  SELECT doc_id, lines.i, line, gone.i IS NOT NULL AS g FROM lines LEFT JOIN gone USING (doc_id, i)
), islands AS (
  SELECT doc_id, min(i) AS s, max(i) + 1 AS e FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM gone) GROUP BY doc_id, grp
), ranges AS (
  SELECT doc_id, string_agg(s || '-' || e, ',' ORDER BY s) AS deleted FROM islands GROUP BY doc_id
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE g)::BIGINT AS n_deleted, coalesce(any_value(deleted), '') AS deleted,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT g), '')) AS kept_sha256
FROM marks LEFT JOIN ranges USING (doc_id) GROUP BY doc_id
"""
