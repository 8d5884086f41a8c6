"""Temperature mixing of sources, in DataFrame functions only.

A source's weight is its share of all tokens (words), raised to an exponent and normalised. The exponent is
bisected between 0 (all sources alike) and 1 (as they are): to the largest whose weights have a wanted entropy,
or the smallest at which no source is repeated more often than a limit.

A source's weight and the budget say how often it is gone through. Whole passes take every document. The
last, broken one takes documents in a permutation of blocks: documents are dealt to blocks by hash, blocks
are permuted by another, and documents are taken in that order while they fit. Token sums go from documents
to blocks, to groups of blocks, to sources, so that a source with most of the rows burdens no task.

Defined results: a null source is a source of its own; null or blank texts have no tokens, and a source
without any has weight 0 and its documents are taken once; rows of one id and text and source are alike and
told apart only by number; a very long text counts by its tokens like any other and is never cut; an empty table gives an empty table; extra columns are kept by ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import cut, plain, renamed

#: No source is repeated more often than this, where the budget covers every source once.
MAX_REPETITION = 1.5
BLOCK_ROWS = 1024
GROUP_BLOCKS = 1024
SEED = 20
_STEPS = 32
_KEY = ["i", "th", "s"]
_SPACE = "[ \\t\\n\\r\\f\\x0b]+"


@dataclass(frozen=True)
class Shares:
    """What the bisection sees of the sources for one exponent: z = sum of share ** a, and the entropy."""

    a: float
    z: float
    entropy: float


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(i, th, s, n) for each row: id, hash of its text, source (null: '', others behind '=') and tokens."""
    text = F.btrim(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(" \t\n\r\f\x0b"))
    n = F.when(text == "", 0).otherwise(F.size(F.split(text, _SPACE))).cast("long")
    return docs.select(*keys(id_col, text_col, source_col), n.alias("n"))


def keys(id_col: str, text_col: str, source_col: str) -> list:
    s = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    return [F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("th"), s.alias("s")]


def _evaluate(sources: DataFrame, exponents: list[float], total: int) -> list[Shares]:
    share = F.col("tokens") / F.lit(float(total))
    columns = []
    for k, a in enumerate(exponents):
        x = F.pow(share, F.lit(a))
        columns += [F.sum(x).alias(f"z{k}"), F.sum(x * F.log(share)).alias(f"e{k}")]
    row = sources.where("tokens > 0").agg(*columns).first()
    return [Shares(a, row[f"z{k}"], float(log(row[f"z{k}"]) - a * row[f"e{k}"] / row[f"z{k}"])) for k, a in enumerate(exponents)]


def exponent(sources: DataFrame, total: int, least: int, most: int, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None) -> Shares:
    """The exponent by bisection, five halvings to a pass over ``sources`` (source, tokens).

    Entropy falls and the greatest repetition falls as the exponent grows, so the wanted exponent is the last
    (entropy) or the first (repetition) of the unit interval that qualifies; its nearer end if none does.
    """
    def repetition(x: Shares) -> float:
        if budget is None:
            return (most / least) ** (1 - x.a)
        return budget * total * (least / total) ** (x.a - 1) / x.z / total

    low, high = 0.0, 1.0
    grid: list[Shares] = []
    for _ in range(6):
        grid = _evaluate(sources, [low + (high - low) * k / _STEPS for k in range(_STEPS + 1)], total)
        if target_entropy is not None:
            good = [k for k, x in enumerate(grid) if x.entropy >= target_entropy]
            if not good or good[-1] == _STEPS:
                return grid[0] if not good else grid[-1]
            low, high = grid[good[-1]].a, grid[good[-1] + 1].a
        else:
            good = [k for k, x in enumerate(grid) if repetition(x) <= max_repetition]
            if not good or good[0] == 0:
                return grid[-1] if not good else grid[0]
            low, high = grid[good[0] - 1].a, grid[good[0]].a
    return _evaluate(sources, [low if target_entropy is not None else high], total)[0]


def plan(rows: DataFrame, **targets) -> DataFrame:
    """``rows`` (as ``sized`` gives them) with block, weight, repetition, passes and extra. A row is taken ``passes``
    times, and once more if ``extra`` is 1."""
    planned = by_key(rows, **targets).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    return planned.withColumn("extra", (F.col("j") <= F.col("extra")).cast("long")).drop("c", "j")


def by_key(rows: DataFrame, target_entropy: float | None = None, max_repetition: float | None = MAX_REPETITION, budget: float | None = None) -> DataFrame:
    """The distinct ``rows`` with their count c, block, weight, repetition, passes and extra: how many of the c are taken
    once more than ``passes`` times.

    ``budget`` is the mixture's tokens as a multiple of all tokens; None is the least that takes every
    document once.
    """
    if target_entropy is not None:
        max_repetition = None
    distinct, _ = cut(rows.groupBy(*_KEY, "n").agg(F.count(F.lit(1)).alias("c")), "distinct")
    n_rows = distinct.agg(F.sum("c")).first()[0] or 0
    n_blocks = max(1, n_rows // BLOCK_ROWS)
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "i", "th"), F.lit(n_blocks)))
    blocks, _ = cut(dealt.groupBy("s", "block").agg(F.sum(F.col("n") * F.col("c")).alias("t")), "blocks")
    sources, _ = cut(blocks.groupBy("s").agg(F.sum("t").alias("tokens")), "sources")
    seen = sources.where("tokens > 0").agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    total, least, most = (x or 0 for x in seen)
    if total:
        x = exponent(sources, total, least, most, target_entropy, max_repetition, budget)
        share = F.col("tokens") / F.lit(float(total))
        weight = F.pow(share, F.lit(x.a)) / F.lit(x.z)
        often = F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - x.a)) if budget is None else weight * F.lit(float(budget) * total) / F.col("tokens")
    else:
        weight = often = F.lit(1.0)
    none = F.col("tokens") == 0
    wanted, _ = cut(
        sources.select("s", "tokens", F.when(none, 0.0).otherwise(weight).alias("weight"), F.when(none, 1.0).otherwise(often).alias("repetition")).withColumn(
            "passes", F.floor("repetition").cast("long")
        ).withColumn("rest", F.floor((F.col("repetition") - F.col("passes")) * F.col("tokens")).cast("long")),
        "wanted",
    )
    # the broken pass: where each block begins in its source's permutation
    n_groups = max(1, n_blocks // GROUP_BLOCKS)
    turn = F.xxhash64(F.lit(SEED + 1), "s", "block")
    permuted = blocks.withColumn("turn", turn).withColumn("grp", F.pmod("turn", F.lit(n_groups)))
    sums, _ = cut(permuted.groupBy("s", "grp").agg(F.sum("t").alias("gt")), "groups")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s", "grp", F.coalesce(F.sum("gt").over(before("s").orderBy("grp")), F.lit(0)).alias("g0"))
    placed = (
        permuted.withColumn("b0", F.coalesce(F.sum("t").over(before("s", "grp").orderBy("turn", "block")), F.lit(0)))
        .join(starts, ["s", "grp"])
        .select("s", "block", "t", (F.col("g0") + F.col("b0")).alias("at"))
        .join(wanted, "s")
        .withColumn("state", F.when(F.col("rest") == 0, 0).when(F.col("at") + F.col("t") <= F.col("rest"), 2).when(F.col("at") <= F.col("rest"), 1).otherwise(0))
        .select("s", "block", "weight", "repetition", "passes", (F.col("rest") - F.col("at")).alias("room"), "state")
    )
    placed, _ = cut(placed, "placed")
    told = dealt.join(placed, ["s", "block"])
    upto = Window.partitionBy("s", "block").orderBy(F.xxhash64(F.lit(SEED + 2), "i", "th"), "i", "th").rowsBetween(Window.unboundedPreceding, -1)
    out = [*_KEY, "n", "c", "block", "weight", "repetition", "passes"]
    left = F.col("room") - F.coalesce(F.sum(F.col("n") * F.col("c")).over(upto), F.lit(0))
    fits = F.when(F.col("left") < 0, 0).when(F.col("n") == 0, F.col("c")).otherwise(F.least("c", F.floor(F.col("left") / F.greatest("n", F.lit(1)))))
    broken = told.where("state = 1").withColumn("left", left).withColumn("extra", fits.cast("long"))
    return told.where("state <> 1").select(*out, F.when(F.col("state") == 2, F.col("c")).otherwise(0).cast("long").alias("extra")).unionByName(broken.select(*out, "extra"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """``docs`` as the mixture has them: each row as often as it is taken."""
    held, short = plain(docs)
    columns = (short[id_col], short[text_col], short[source_col])
    rows, _ = cut(sized(held, *columns), "sized")
    taken, _ = cut(
        by_key(rows, **targets).select(F.coalesce("i", F.lit(0)).alias("i"), F.col("i").isNull().alias("null"), "th", "s", "c", "passes", "extra"), "taken"
    )
    i, th, s = keys(*columns)
    by = ["i", "null", "th", "s"]
    told = held.withColumns({"i": F.coalesce(i, F.lit(0)), "null": i.isNull(), "th": th, "s": s})
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("c"))
    out = told.join(taken.where(~some).hint("merge"), by).withColumn("times", F.col("passes") + (F.col("extra") > 0).cast("long"))  # by one plan at every size
    ends = taken.where(some)  # one key a source at most: repeated rows at which its broken pass ends
    if not ends.isEmpty():
        again = Window.partitionBy(*by).orderBy(F.lit(0))
        out = out.unionByName(told.join(ends, by).withColumn("times", F.col("passes") + (F.row_number().over(again) <= F.col("extra")).cast("long")))
    return renamed(out.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))), docs)


def query(docs: DataFrame) -> DataFrame:
    """Every document with its source's weight and repetition, its block, and how often it is taken."""
    rows, _ = cut(sized(docs), "sized")
    return plan(rows).select(
        F.col("i").alias("doc_id"),
        F.when(F.col("s") == "", F.lit(None).cast("string")).otherwise(F.expr("substring(s, 2)")).alias("source"),
        F.col("n").alias("n_tokens"),
        "weight",
        "repetition",
        "block",
        (F.col("passes") + F.col("extra")).alias("copies"),
    )
