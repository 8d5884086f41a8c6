"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.shared import apart, cut, remove


def symmetric(edges: DataFrame, a: str, b: str, parts: int | None = None) -> DataFrame:
    """Both orientations of every edge as (src, dst), once each; dealt to ``parts`` tasks, if given."""
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = one.union(one.select("dst", "src")).where("src <> dst")
    return (both.repartition(parts, "src", "dst") if parts else both).distinct()


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): the least number of steps, up to ``hops``, from any of ``seeds`` (node). Edges and every frontier
    are written once, so that a further hop reads tables and repeats nothing."""
    edges, _ = cut(edges.select("src", "dst"), "edges")
    seen, _ = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "frontier")
    frontier = seen
    for hop in range(1, hops + 1):
        ahead = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier, _ = cut(ahead.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.union(frontier)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is its component's least node.

    A node points at the least it has seen, in two steps that repeat until nothing changes: greater neighbours are
    given the least of a node and its neighbours, then smaller ones are tied to their own least. The minima are
    aggregated before the shuffle; every round's edges are a table in the shared folder.
    """
    spark = edges.sparkSession
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
    now, path = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    while (known := mark(now)) != seen and known[0]:
        near = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = near.groupBy("hi").agg(F.min("lo").alias("low")).select("hi", F.least("hi", "low").alias("low"))
        up = near.join(apart(low, known[0]), "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).distinct()
        own = up.groupBy("hi").agg(F.min("lo").alias("low"))
        down = up.join(apart(own, known[0]), "hi").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        after, new = cut(down.unionByName(own.withColumnRenamed("low", "lo")).distinct(), "links")
        remove(spark, path)
        now, path, seen = after, new, known
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def cross_connections(edges: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """(node, n_seeds, seeds): nodes beside the seeds that at least ``least`` of them reach directly."""
    reached = edges.join(seeds.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), "src").distinct()
    found = reached.join(seeds.select("node"), "node", "left_anti").groupBy("node")
    return found.agg(F.countDistinct("src").alias("n_seeds"), F.array_join(F.sort_array(F.collect_set("src")), ",").alias("seeds")).where(F.col("n_seeds") >= least)


def connection_strength(edges: DataFrame, weight: str, parts: int | None = None) -> DataFrame:
    """(node, neighbours, total, strength) over edges (src, dst, weight) in both orientations; strength
    saturates at 1. Edges are dealt to ``parts`` tasks, if given; a node's may go to several."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), weight).union(edges.select("dst", "src", weight))
    both = both.repartition(parts, "node", "other") if parts else both
    found = both.groupBy("node").agg(F.countDistinct("other").alias("neighbours"), F.coalesce(F.sum(weight), F.lit(0)).alias("total"))
    return found.withColumn("strength", 1 - 1 / (1 + F.col("neighbours") * 0.5 + F.col("total") * 0.1))
