"""The folder that driver and executors share, and lineage cuts by tables in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder serves a single-JVM session (tests), and on a
    cluster a folder in the warehouse does, if that is in a store that all machines see; if it isn't, this raises, as every
    cut would go to each machine's own disk."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "local")
    if master == "local" or master.startswith("local["):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            path = tempfile.mkdtemp(prefix="quillmark-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _LOCAL[app] = "file://" + path
        return _LOCAL[app]
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillmark")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if found.startswith("file:"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share; {found} is on each machine's own disk")
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, so that nothing upstream runs again
    and a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows that a table may have to be broadcast.
FEW = 50_000


def apart(df: DataFrame, rows: int | None = None) -> DataFrame:
    """One side of a join whose rows grow with the input: dealt by the key, never broadcast, unless it is known to be of few ``rows``.
    Spark's own check goes by the size of compressed files, and keys that repeat or rise take many times that in the driver."""
    return df if rows is not None and rows <= FEW else df.hint("merge")


def counted(df: DataFrame) -> int:
    """How many rows there are; counted up to one more than ``FEW``."""
    return df.limit(FEW + 1).count()


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all tasks by a hash of all their columns, for work that takes long for each row: a compressed file is
    read by as few tasks as it has splits, however many rows that is."""
    spark = df.sparkSession
    n = max(partitions(spark), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))


def placed(df: DataFrame, part: str = "part", n: int | None = None) -> DataFrame:
    """Rows dealt by the number of their range: one range a task, for windows over ``n`` ranges."""
    return df.repartitionById(n or partitions(df.sparkSession), F.col(part))


def ranges(spark: SparkSession, rows: int, each: int = 50_000) -> int:
    """Into how many ranges so many slim rows are dealt: ``each`` or more to a range, up to the number of partitions."""
    return max(1, min(partitions(spark), rows // each))


def parts_for(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Into how many partitions so many rows are dealt, so that a task's share doesn't grow with the table: at most about
    ``each`` to one, and no fewer than the session's number."""
    return max(partitions(spark), -(-rows // each))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
