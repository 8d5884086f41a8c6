"""First-match lookups against ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the pieces by which longer rule lists are joined.
PIECE = 4
#: Rules that every key is compared with; a longer list is joined by pieces.
FEW_RULES = 2_000


def rules_table(spark, rules: list[tuple]) -> DataFrame:
    """(ord, pattern, label) in the order of the list."""
    return spark.createDataFrame([(k, p, x) for k, (p, x) in enumerate(rules)], "ord int, pattern string, label string")


def containing(keys: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """The rows of ``keys`` with each rule whose pattern their key contains.

    A few rules are compared with every key. Of more, a pattern is joined by its first ``PIECE`` characters to the
    pieces of as many that a key has, so that a key meets only patterns that begin within it; shorter patterns
    are joined by all their characters. An empty pattern is contained in every key."""
    if rules.limit(FEW_RULES + 1).count() <= FEW_RULES:
        return keys.join(F.broadcast(rules), F.contains(F.col(key), F.col("pattern")))
    n = F.length("pattern")
    begins = rules.withColumn("piece", F.substring("pattern", 1, PIECE))
    starts = F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1)))
    cuts = F.flatten(F.transform(starts, lambda i: F.array(*(F.substring(F.col(key), i, F.lit(w)) for w in range(1, PIECE + 1)))))
    pieces = keys.select(*keys.columns, F.explode(F.array_append(F.array_distinct(cuts), F.lit(""))).alias("piece")).dropDuplicates([key, "piece"])
    return pieces.join(begins, "piece").where((n <= PIECE) | F.contains(F.col(key), F.col("pattern"))).drop("piece")


def first_match(df: DataFrame, key: str, rules: DataFrame, both_ways: bool = False, least: int = 0) -> DataFrame:
    """``df`` with the label of the first rule whose pattern its key contains (or, both ways, that contains
    it). Only distinct keys meet the rules."""
    keys = df.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    found = containing(keys, "__k", rules).select("__k", "ord", "label")
    if both_ways:
        turned = rules.withColumnRenamed("pattern", "__p")
        inner = containing(turned, "__p", keys.where(F.length("__k") >= least).select(F.col("__k").alias("pattern")))
        found = found.unionByName(inner.select(F.col("pattern").alias("__k"), "ord", "label"))
    found = found.groupBy("__k").agg(F.min_by("label", "ord").alias("label"))
    return df.join(found, df[key] == found["__k"], "left").drop("__k")


def exact_then_partial(df: DataFrame, key: str, rules: DataFrame, default) -> DataFrame:
    """As ``first_match``, but an equal pattern goes before any contained one."""
    keys = df.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    rank = F.struct((F.col("__k") != F.col("pattern")).alias("partial"), F.col("ord"))
    found = containing(keys, "__k", rules).groupBy("__k").agg(F.min_by("label", rank).alias("label"))
    return df.join(found, df[key] == found["__k"], "left").drop("__k").withColumn("label", F.coalesce("label", F.lit(default)))
