"""Usage counters, rate limits, sessions, conversation summaries, progress, batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexloom.operators.carried import carried

#: Limits of the free plan. Fixed values.
FREE = {"contracts_per_month": 5, "qa_per_day": 10, "api_calls_per_hour": 100}


def usage(events: DataFrame, period: str, limit: int) -> DataFrame:
    """(user_id, event_type, period, n, over) by calendar day, month or hour."""
    start = F.date_trunc(period, "ts")
    return events.groupBy("user_id", "event_type", start.alias("period")).agg(F.count("*").alias("n")).withColumn("over", F.col("n") > limit)


def sessions(events: DataFrame, minutes: int) -> DataFrame:
    """(user_id, session, start, end, n): runs of a user's events with gaps of at most so many minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {minutes} MINUTES")
    out = events.withColumn("session", F.sum(F.when(gap, 1).otherwise(0)).over(w))
    return out.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def conversation_summary(messages: DataFrame) -> DataFrame:
    """(conv_id, message_count, last_turn, next_seq, last_role): what triggers would maintain."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"), (F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_seq"), F.max_by("role", "turn").alias("last_role"))


def history(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def monotone(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A progress value that never falls, held between 0 and 100; rows of a key of any share are spread."""
    held = df.withColumn("_held", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(value))))
    return carried(held, [key], [order], {}, {"progress": "_held"}).drop("_held")


def greedy_batches(df: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Number items of a key in order into batches: a batch closes before the item that would exceed `most`.

    A stream over sorted rows that holds three values: a key of any size needs no memory of its own.
    """

    def run(batches):
        known, number, held = None, 0, 0
        for batch in batches:
            numbers = []
            for k, s in zip(batch.column(key).to_pylist(), batch.column("_size").to_pylist(), strict=True):
                if known is None or k != known[0]:
                    known, number, held = (k,), 0, 0
                if held > 0 and held + s > most:
                    number, held = number + 1, 0
                held += s
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), pa.array(numbers, pa.int64())], [key, order, "batch"])

    rows = df.select(key, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    schema = T.StructType([rows.schema[key], rows.schema[order], T.StructField("batch", T.LongType())])
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def chunks(text: Column, n: int) -> Column:
    """The text in pieces of n characters."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.char_length(text), F.lit(n)), lambda i: F.substring(text, i + 1, F.lit(n))), lambda x: x != "")
