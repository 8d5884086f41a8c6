"""Which profile belongs to a person: candidates by name, the best by evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.screening import match_score
from quillmark.functions.text import fold_latin, norm


def name_key(name: Column | str) -> Column:
    """Surname and first initial, in plain letters: what profiles are looked up by."""
    words = F.split(norm(fold_latin(name)), " ")
    return F.concat_ws(" ", F.element_at(words, -1), F.substring(F.get(words, F.lit(0)), 1, 1))


def disambiguated(people: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """(key, profile, score, there): the profile of each of ``people`` (key, name, institute) among ``profiles`` (profile,
    name, affiliations, h_index, papers, citations).

    Candidates have the same surname and first initial. Those whose names are unlike (a score below 0.5) are left out; of
    the rest one at the person's institute goes before others, then the higher h-index, more papers, the better score and
    the lesser identifier. People without a candidate are left out, and so are nulls; a name is compared with distinct spellings
    once for all people who have it."""
    p = people.select(F.col(key), F.col("name").alias("__n"), F.coalesce("institute", F.lit("")).alias("__i")).where("__n is not null")
    q = profiles.where("name is not null").withColumn("__key", name_key("name"))
    asked = p.select("__n", "__i").distinct().withColumn("__key", name_key("__n"))
    met = asked.join(q, "__key").withColumn("score", match_score("__n", "name", "__i", F.coalesce("affiliations", F.lit("")), F.coalesce("citations", F.lit(0)))).where("score is not null")
    there = (F.col("__i") != "") & F.contains(F.lower(F.coalesce("affiliations", F.lit(""))), F.lower("__i"))
    ranked = met.groupBy("__n", "__i").agg(F.min_by(F.struct("profile", "score", there.alias("there")), F.struct((~there).alias("a"), (-F.coalesce("h_index", F.lit(0))).alias("b"), (-F.coalesce("papers", F.lit(0))).alias("c"), (-F.col("score")).alias("d"), "profile")).alias("x"))
    return p.join(ranked, ["__n", "__i"]).select(key, "x.profile", "x.score", "x.there")
