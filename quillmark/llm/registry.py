"""The queries of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import (
    op1_fixity,
    op10_fingerprints,
    op11_substring_dedup,
    op12_divergence,
    op13_whitening,
    op2_url_filter,
    op3_simhash_dedup,
    op4_mixing,
    op5_decontamination,
    op6_line_dedup,
    op7_secrets,
    op8_toxicity,
    op9_sstable,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _on(table: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES["op3_simhash_near_dedup"] = _on("documents", op3_simhash_dedup.query)
QUERIES["op5_benchmark_decontamination"] = lambda spark, d: op5_decontamination.query(
    spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
)
ORACLES["op5_benchmark_decontamination"] = op5_decontamination.SQL
QUERIES["op8_toxicity_cnn"] = lambda spark, d: op8_toxicity.query(
    spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
)
QUERIES["op9_sstable_shards"] = _on("documents", op9_sstable.query)
QUERIES["op2_url_digest_filter"] = _on("pages", op2_url_filter.query)
ORACLES["op2_url_digest_filter"] = op2_url_filter.SQL
QUERIES["op7_secret_markov"] = _on("documents", op7_secrets.query)
QUERIES["op10_simhash_fingerprints"] = _on("documents", op10_fingerprints.query)
QUERIES["op1_warc_merkle_fixity"] = _on("pages", op1_fixity.query)
ORACLES["op1_warc_merkle_fixity"] = op1_fixity.SQL
QUERIES["op4_temperature_mixing"] = _on("documents", op4_mixing.query)
QUERIES["op6_line_suffix_dedup"] = _on("documents", op6_line_dedup.query)
ORACLES["op6_line_suffix_dedup"] = op6_line_dedup.SQL
QUERIES["op11_relative_lz_dedup"] = _on("documents", op11_substring_dedup.query)
ORACLES["op11_relative_lz_dedup"] = op11_substring_dedup.SQL
QUERIES["op12_source_divergence"] = _on("documents", op12_divergence.query)
ORACLES["op12_source_divergence"] = op12_divergence.SQL
QUERIES["op13_lobpcg_whitening"] = _on("embeddings", op13_whitening.query)
