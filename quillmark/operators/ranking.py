"""Ranking, streaks and bounded selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.shared import cut, partitions, placed


def top_n(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def ranked(df: DataFrame, by: list[str], order: list, rank: str = "rank") -> DataFrame:
    """``df`` with every row's place in its group, from 1. Rows are dealt to ranges of group and order, so a group of
    any size is spread over tasks; a range's first group goes on counting where the ranges before left it, which
    takes one row for each range on the driver."""
    spark = df.sparkSession
    dealt, _ = cut(df.repartitionByRange(partitions(spark), *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = dealt.groupBy("__part", group.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    ends, _ = cut(counts.groupBy("__part").agg(F.min("g").alias("first"), F.max_by("n", "g").alias("n_last"), (F.min("g") == F.max("g")).alias("one")), "ends")
    told = ends.withColumn("last", F.col("first")) if not by else ends.join(counts.groupBy("__part").agg(F.max("g").alias("last")), "__part")
    carried, before, last = [], 0, None
    for r in sorted(told.collect(), key=lambda r: r["__part"]):
        goes_on = last is not None and r.first == last
        carried.append((r["__part"], before if goes_on else 0))
        before, last = r.n_last + (before if goes_on and r.one else 0), r.last
    carry = F.broadcast(spark.createDataFrame(carried, "__part int, __carry long"))
    local = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)).cast("long")
    told = placed(dealt, "__part").withColumn("__local", local).join(carry, "__part").join(F.broadcast(ends.select("__part", F.col("first").alias("__first"))), "__part")
    return told.withColumn(rank, F.col("__local") + F.when(group.eqNullSafe(F.col("__first")), F.col("__carry")).otherwise(0)).drop("__part", "__local", "__carry", "__first")


def global_rank(df: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    return ranked(df, [], order, rank)


def best(df: DataFrame, by: list[str], score: list, keep: list[str]) -> DataFrame:
    """(by, keep) of each group's row of greatest score; aggregated before the shuffle."""
    found = df.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*score)).alias("r"))
    return found.select(*by, *(F.col(f"r.{c}").alias(c) for c in keep))


def streaks(df: DataFrame, by: list[str], order: list[str], bad) -> DataFrame:
    """(by, run, start, length) of consecutive rows for which ``bad`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__bad", bad.cast("int")).withColumn("__run", F.sum(1 - F.col("__bad")).over(w))
    found = marked.where("__bad = 1").groupBy(*by, F.col("__run").alias("run"))
    return found.agg(F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("length"))


def changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the one before in their key's order; first rows don't."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))
