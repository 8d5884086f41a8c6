"""Which of several input files to read: one by its name, else the newest, by what the scan itself knows of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified, size) of the files of ``folder`` that fit ``pattern``; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))


def latest(spark: SparkSession, folder: str, name: str | None = None, pattern: str = "*") -> str | None:
    """The path of the file called ``name`` if there is one, else of the one that was changed last, of several the last by
    name; None where no file fits."""
    known = files(spark, folder, pattern)
    fixed = (F.col("name") == name) if name else F.lit(False)
    best = known.select("path", F.struct(fixed.alias("fixed"), "modified", "name").alias("by"))
    return best.agg(F.max_by("path", "by").alias("path")).first().path


def of_latest(rows: DataFrame, name: str | None = None) -> DataFrame:
    """Those ``rows`` of a scan of several files that come from the file called ``name``, or else from the newest one, with
    ``latest_file``, its name. The choice is an aggregate over one row for each file, joined to the scan."""
    told = rows.select("*", F.col("_metadata.file_path").alias("__path"))
    by = rows.select(F.col("_metadata.file_path").alias("__path"), F.struct((F.col("_metadata.file_name") == (name or "")).alias("fixed"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("latest_file")).alias("by")).distinct()
    best = by.agg(F.max_by(F.struct("__path", "by.latest_file"), "by").alias("b")).select("b.*")
    return told.join(best, "__path").drop("__path")
