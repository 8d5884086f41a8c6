"""A corpus pipeline of five stages. Each is written as Parquet and read again as the next one's documents.

Every stage sees all that its predecessor kept; all but the last return the columns of ``documents``.

Defined results: a null or empty text is scored, is a copy of other blank texts, holds no passage and becomes the end
id alone; a null id takes part, is kept by near_dedup only where all of a group have none, and comes first in the
token shards; a null source is a source of its own; rows alike in id and text are one document for near_dedup, which
keeps one of them; extra columns go through, whatever their names, up to the last stage; empty documents stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import op3_simhash_dedup, op4_mixing, op5_decontamination, op8_toxicity, op9_sstable
from quillmark.llm.common import scratch

#: Share of five-word shingles from which two documents are near copies.
LIKENESS = (4, 5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, trained on the labels of ``docs``, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op8_toxicity.reject(docs, op8_toxicity.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of every group of near copies: five-word shingles, Jaccard of 0.8 or more."""
    return op3_simhash_dedup.one_of_each(docs, likeness=LIKENESS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the benchmark's windows contaminate."""
    return op5_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, to the mixture's weights; drops none."""
    return op4_mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards and returns what they hold."""
    return op9_sstable.query(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: A trained classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
