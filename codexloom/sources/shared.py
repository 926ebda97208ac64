"""The folder that all executors share: cut lineage, written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that may be broadcast, and Spark's switch for shuffle files to go with their query.
FEW, CLEANUP = 250_000, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode alone, where none is set, a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codexloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, deleted when the session ends."""
    made = f"{root(spark)}/codexloom-{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return made


def cut(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared folder: later plans begin here, and a lost executor costs no earlier work."""
    root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows written as a table of compressed columns and read back; the write's own shuffle files go when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As `cut`, for many rows: they are `written` to a new folder."""
    return written(df, folder(df.sparkSession, name))


def among(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is among some: broadcast only if a count shows that these are few."""
    few = keys.limit(FEW + 1).count() <= FEW
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), on, "left_semi")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys into four times the usual number of parts: a task sorts little, and Spark doesn't merge such parts into large ones."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
