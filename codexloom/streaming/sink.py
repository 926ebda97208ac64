"""A sink that holds each row once, and streams of bounded batches.

A batch is written to a folder of its own number, after folders of that and later numbers are gone: a batch that is replayed, because the
stream stopped between the write and its commit, takes the place of what it wrote before; a stream that begins anew, without its
checkpoint, does so with all. Beside each batch the highest place of each of its keys is written; rows of a later batch at or below
their key's mark were delivered before and are left out, so a source may deliver again in another batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _later(spark: SparkSession, folder: str, number: int) -> None:
    """Delete the folders of batches from a number on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        for entry in fs.listStatus(path):
            name = entry.getPath().getName()
            if name.startswith("batch=") and int(name.removeprefix("batch=")) >= number:
                fs.delete(entry.getPath(), True)


def once(folder: str, key: str | None = None, place: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each row once in folder/rows. With key and place, a key's rows count in rising order of place."""

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for part in ("marks", "rows"):
            _later(spark, f"{folder}/{part}", number)
        if key is not None:
            batch = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key, place).orderBy(place))).where("_n = 1").drop("_n")
            if number and (marks := _read(spark, f"{folder}/marks")) is not None:
                marks = marks.groupBy(F.col(key).alias("_k")).agg(F.max("mark").alias("_m"))
                batch = batch.join(marks, batch[key].eqNullSafe(F.col("_k")), "left").where(F.col("_m").isNull() | (F.col(place) > F.col("_m"))).drop("_k", "_m")
            # rows first: marks alone would keep a replay from writing them
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            written = spark.read.parquet(f"{folder}/rows/batch={number}")
            written.groupBy(key).agg(F.max(place).alias("mark")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")
        else:
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    return keep


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(folder).drop("batch") if fs.exists(path) and fs.listStatus(path) else None


def rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What the sink holds."""
    found = _read(spark, f"{folder}/rows")
    return found.select(*schema.names) if found is not None else spark.createDataFrame([], schema)


def bounded(spark: SparkSession, path: str, columns: list[str], files: int = 1) -> DataFrame:
    """A stream over parquet files that takes so many files a batch and reads the named columns alone."""
    path = path.rstrip("/")
    schema = spark.read.parquet(path).select(*columns).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, folder: str, keep: Callable[[DataFrame, int], None] | None = None) -> list[int]:
    """Run a stream over what is there now into `once(folder)`; returns the rows that each of its batches read."""
    query = stream.writeStream.foreachBatch(keep or once(folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]
