"""Term vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The share of texts beyond which a term says nothing, and how many terms a vector has.
MAX_DF, FEATURES = 0.95, 500
#: Words of two or more letters, digits or underscores of any script.
WORDS = r"([\p{L}\p{N}_]{2,})"


def _weighted(tf: DataFrame, n: DataFrame, df_: DataFrame, key: str) -> DataFrame:
    raw = tf.join(df_, "term").join(n, F.lit(True)).withColumn("v", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df")).cast("double")) + 1))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("v") / norm).alias("weight"))


def tfidf(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each key's vector of length 1."""
    words = df.select(key, F.explode(F.split(F.lower(text), "[^a-z]+")).alias("term")).where(F.length("term") >= least)
    tf = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = F.broadcast(df.agg(F.countDistinct(key).alias("n")))  # one row
    return _weighted(tf, n, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), key)


def feature_vectors(df: DataFrame, key: str, text: str, stop: list[str] = (), max_df: float = MAX_DF, features: int = FEATURES) -> DataFrame:
    """As ``tfidf``, over ``features`` terms: without stop words and terms in more than ``max_df`` of all texts, the
    most frequent ones in all (equally frequent ones in alphabetical order)."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORDS))).alias("term"))
    if stop:
        words = words.where(~F.col("term").isin(*stop))
    tf = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = F.broadcast(df.agg(F.countDistinct(key).alias("n")))  # one row
    known = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).join(n, F.lit(True)).where(F.col("df") <= F.lit(max_df) * F.col("n"))
    return _weighted(tf, n, F.broadcast(known.orderBy(F.desc("total"), "term").limit(features).select("term", "df")), key)  # so many terms at most
