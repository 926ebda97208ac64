"""Segmented scans: values carried forward by level and running maxima, without a key's rows in one task.

State is associative: of each level the last value and where it stood, of each maximum the largest so far. Rows are dealt into
ranges of key and order and written, so that a key of any share lies in as many ranges as its rows need. A first pass scans each range's rows of a key
by themselves; what a range leaves at its end is one row for each of its keys. Of keys in several ranges (two a range at most) these are scanned in turn,
and a second pass adds what came before to each range.

Levels are ordered from the highest: a value of a level ends those of all lower levels before it. The order must be total in a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.sources import shared


def carried(df: DataFrame, keys: list[str], order: list[str], levels: dict[str, str], maxima: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """df with new columns: for each level (new name: column, highest first) the value in force, for each maximum the largest value up to the row.

    Nulls set nothing; without a value yet the new column is null. Rows with null keys are one key.
    """
    spark, maxima = df.sparkSession, maxima or {}
    path = f"{shared.folder(spark, 'carried')}/rows"
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    place = F.struct(*order)
    names = [*(f"_l{i}" for i in range(len(levels))), *(f"_m{i}" for i in range(len(maxima)))]
    state: list[Column] = [F.when(F.col(c).isNotNull(), F.struct(place.alias("at"), F.col(c).alias("value"))) for c in levels.values()]
    state += [F.col(c) for c in maxima.values()]
    set_ = rows.select("*", *(s.alias(n) for s, n in zip(state, names, strict=True)))
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    largest = lambda n, w: F.max(n).over(w)  # noqa: E731  of (place, value) the last place is the largest
    scanned = set_.select(*rows.columns, *(largest(n, here).alias(n) for n in names))
    ends = set_.groupBy("_part", *keys).agg(*(F.max(n).alias(n) for n in names))
    ends = ends.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = shared.cut(ends.select("_part", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(largest(n, before).alias(f"{n}b") for n in names)))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = scanned.join(F.broadcast(carry.withColumnRenamed("_part", "_p")), same, "left")  # two rows a range at most
    total = both.select(*df.columns, *(F.greatest(n, f"{n}b").alias(n) for n in names))
    out, above = [F.col(c) for c in df.columns], None
    for n, name in zip(names, levels, strict=False):
        at = F.col(f"{n}.at")
        out.append((F.col(f"{n}.value") if above is None else F.when(above.isNull() | (at >= above), F.col(f"{n}.value"))).alias(name))
        above = at if above is None else F.greatest(above, at)
    out += [F.col(n).alias(name) for n, name in zip(names[len(levels) :], maxima, strict=True)]
    return total.select(*out)
