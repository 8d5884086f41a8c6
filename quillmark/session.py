"""One place for the session settings that the library expects."""

from __future__ import annotations

import os
import shlex
from pathlib import Path

import pyspark
from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

#: What is set where nobody else has set it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def submitted() -> set[str]:
    """The names of the settings that come with the submission: from the JVM that ``spark-submit`` started, or from
    the arguments and the file of defaults that a JVM yet to be started will read."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        SparkContext._ensure_initialized()
        return {k for k, _ in SparkConf().getAll()}
    found: set[str] = set()
    words = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for k, word in enumerate(words):
        flag, _, value = word.partition("=")
        following = value or (words[k + 1] if k + 1 < len(words) else "")
        if flag in ("--conf", "-c"):
            found.add(following.split("=")[0])
        elif flag == "--master":
            found.add("spark.master")
        elif flag == "--driver-memory":
            found.add("spark.driver.memory")
    home = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "conf")
    defaults = Path(home, "spark-defaults.conf")
    if defaults.exists():
        found |= {line.split("=")[0].split()[0] for line in defaults.read_text().splitlines() if line.strip() and not line.lstrip().startswith("#")}
    return found


def session(master: str = "local[8]", app: str = "quillmark", **conf: str) -> SparkSession:
    """Start (or join) a session. What the submitter has set stays; ``conf`` and ``SETTINGS`` fill in the rest. A
    session that is running already gets ``conf`` alone."""
    running = SparkSession.getActiveSession() is not None
    held = set() if running else submitted()
    builder = SparkSession.builder.appName(app) if "spark.app.name" not in held else SparkSession.builder
    if master and not running and "spark.master" not in held:
        builder = builder.master(master)
    for key, value in ((({} if running else SETTINGS) | conf)).items():
        if key not in held:
            builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
