"""Structured Streaming twins of the batch counters; each takes a stream and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.sources import shared


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a parquet table, one file or a folder of them; the schema is that of a batch read."""
    path = path.rstrip("/")
    # as a pattern, the path of a single file is taken too
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def hourly_usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by user, event type and hour, with a watermark for late events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "60 minutes", late: str = "1 hour") -> DataFrame:
    """Events in each user's sessions."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def conversation_counts(messages: DataFrame) -> DataFrame:
    """Messages and last turn of each conversation."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its rows, written to the shared folder.

    Mode complete returns every group, those still open at the end too; append only what its watermark closed.
    """
    if mode not in ("complete", "append"):
        raise ValueError("a drained stream is in complete or append mode")
    spark = stream.sparkSession
    folder = shared.folder(spark, "stream")
    rows = f"{folder}/rows"
    spark.createDataFrame([], stream.schema).write.parquet(rows)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(rows)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)
