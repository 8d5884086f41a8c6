"""Institutes resolved against a ranking: aliases, tiers, companies, countries and regions.

A ranking is given by lists in their order; where several entries fit, the first wins. Names are compared without case,
accents, commas, points and a leading article. Only distinct names meet the lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import lookup

# The tier of what isn't listed; the least length at which a part of a name counts as the name.
UNRANKED = 5
LEAST_PART = 5


def plain_name(c) -> Column:
    """A name as it is compared; unlike ``norm_institute`` only "inc" is dropped at the end."""
    t = X.norm(F.regexp_replace(X.fold_latin(F.lower(F.trim(X.col(c)))), r"[,.]", " "))
    return F.regexp_replace(F.regexp_replace(t, r"^the ", ""), r"\s+inc$", "")


@dataclass(frozen=True)
class Ranking:
    """aliases: (other name, name); tiers: (name, tier) in the order in which they are tried, companies last;
    companies: names."""

    aliases: list[tuple[str, str]] = field(default_factory=list)
    tiers: list[tuple[str, int]] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> Ranking:
        """Of the sections ``tiers`` (by number), ``companies`` (groups with ``tier_equivalent``) and
        ``tier_lookup_aliases``; a group may be a bare list. Without a tier of their own the first group counts 2, others 3."""
        import json

        found = json.loads(text or "{}")
        names = lambda x: list(x.get("institutions", [])) if isinstance(x, dict) else list(x or [])
        tiers = [(n, int(k)) for k, group in found.get("tiers", {}).items() if str(k).lstrip("-").isdigit() for n in names(group)]
        companies = []
        for name, default in (("top_companies", 2), ("companies", 3)):
            group = found.get("companies", {}).get(name, {})
            tier = group.get("tier_equivalent", default) if isinstance(group, dict) else default
            tiers += [(n, int(tier)) for n in names(group)]
        for group in found.get("companies", {}).values():
            companies += names(group)
        return cls(list(found.get("tier_lookup_aliases", {}).items()), tiers, companies)


def _rules(spark, rules: list[tuple[str, object]], label: str = "string") -> DataFrame:
    table = spark.createDataFrame([(k, p, str(x)) for k, (p, x) in enumerate(rules)], "ord int, pattern string, label string")
    return table.select("ord", plain_name("pattern").alias("pattern"), F.col("label").cast(label).alias("label"))


def canonical(names: DataFrame, name: str, ranking: Ranking) -> DataFrame:
    """``names`` (distinct) with ``plain``: the normalised name, or that of the first alias that is it or, from
    ``LEAST_PART`` characters on, is part of it."""
    spark = names.sparkSession
    rows = names.withColumn("plain", plain_name(name))
    aliases = _rules(spark, ranking.aliases).withColumn("label", plain_name("label"))
    keys = rows.select("plain").distinct()
    exact = keys.join(aliases, F.col("plain") == F.col("pattern")).select("plain", "ord", "label")
    part = lookup.containing(keys, "plain", aliases.where(F.length("pattern") >= LEAST_PART)).select("plain", "ord", "label")
    found = exact.unionByName(part).groupBy("plain").agg(F.min_by("label", "ord").alias("as"))
    return rows.join(found, "plain", "left").withColumn("plain", F.coalesce("as", "plain")).drop("as")


def with_tier(df: DataFrame, name: str, ranking: Ranking, tier: str = "tier") -> DataFrame:
    """``df`` with the tier of its institute: of the first entry that contains the name, or is contained in it.
    Nothing known is ``UNRANKED``."""
    spark = df.sparkSession
    names = df.select(F.col(name).alias("__n")).where("coalesce(__n, '') <> ''").distinct()
    told = lookup.first_match(canonical(names, "__n", ranking), "plain", _rules(spark, ranking.tiers, "int"), both_ways=True)
    found = told.select("__n", F.col("label").alias("__tier"))
    return df.join(found, df[name] == found["__n"], "left").withColumn(tier, F.coalesce("__tier", F.lit(UNRANKED))).drop("__n", "__tier")


def with_company(df: DataFrame, name: str, ranking: Ranking, flag: str = "is_company") -> DataFrame:
    """``df`` with whether its institute is a company: the same name, or one part of the other if the shorter has
    ``LEAST_PART`` characters."""
    spark = df.sparkSession
    names = df.select(F.col(name).alias("__n"), plain_name(name).alias("plain")).where("coalesce(__n, '') <> ''").distinct()
    rules = _rules(spark, [(n, n) for n in dict.fromkeys(ranking.companies)])
    keys, long = names.select("plain").distinct(), lambda c: F.length(c) >= LEAST_PART
    exact = keys.join(rules, F.col("plain") == F.col("pattern")).select("plain")
    within = lookup.containing(keys, "plain", rules.where(long("pattern"))).select("plain")
    around = lookup.containing(rules.withColumnRenamed("pattern", "company"), "company", keys.where(long("plain")).withColumnRenamed("plain", "pattern")).select(F.col("pattern").alias("plain"))
    found = names.join(exact.unionByName(within).unionByName(around).distinct(), "plain").select("__n", F.lit(True).alias("__yes"))
    return df.join(found, df[name] == found["__n"], "left").withColumn(flag, F.coalesce("__yes", F.lit(False))).drop("__n", "__yes")


def best_tier(df: DataFrame, key: str, affiliations: str, ranking: Ranking) -> DataFrame:
    """(key, tier): the least tier of any of a row's affiliations; without any ``UNRANKED``."""
    each = df.select(key, F.explode_outer(affiliations).alias("affiliation"))
    return with_tier(each, "affiliation", ranking).groupBy(key).agg(F.min("tier").alias("tier"))


def with_region(df: DataFrame, country: str, regions: list[tuple[str, str]], region: str = "region", other: str = "Other") -> DataFrame:
    """``df`` with the region of its country: of the equal entry, else of the first that contains the country or
    is contained in it, whatever the case; else ``other``."""
    spark = df.sparkSession
    table = spark.createDataFrame([(k, c, r) for k, (c, r) in enumerate(regions)], "ord int, pattern string, label string")
    names = df.select(F.col(country).alias("__c")).where("coalesce(__c, '') <> ''").distinct()
    exact = names.join(table, F.col("__c") == F.col("pattern")).groupBy("__c").agg(F.min_by("label", "ord").alias("same"))
    lowered = table.withColumn("pattern", F.lower("pattern"))
    part = lookup.first_match(names.withColumn("low", F.lower("__c")), "low", lowered, both_ways=True).select("__c", "label")
    found = part.join(exact, "__c", "left").select("__c", F.coalesce("same", "label").alias("__region"))
    return df.join(found, df[country] == found["__c"], "left").withColumn(region, F.coalesce("__region", F.lit(other))).drop("__c", "__region")
