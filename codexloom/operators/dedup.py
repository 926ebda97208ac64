"""Duplicate groups, merged records, merge logs, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexloom.operators.lookup import pick


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with two rows or more; null keys are never duplicates."""
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def ranked(df: DataFrame, keys: list[str], size: str, order: str) -> DataFrame:
    """Add keeper_rank: 1 for the largest row of a group (the first of equals)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(size), order)
    return df.withColumn("keeper_rank", F.row_number().over(w))


def merge_groups(df: DataFrame, keys: list[str], size: str, order: str, fields: list[str]) -> DataFrame:
    """One row a group: the keeper, its empty fields filled from the others in order."""
    w = Window.partitionBy(*keys).orderBy("keeper_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ranked(df, keys, size, order)
    for f in fields:
        value = F.nullif(F.col(f), F.lit("")) if dict(df.dtypes)[f] == "string" else F.col(f)
        out = out.withColumn(f"_{f}", F.first(value, ignorenulls=True).over(w))
    return out.where("keeper_rank = 1").drop(*fields, "keeper_rank").withColumnsRenamed({f"_{f}": f for f in fields})


def merge_log(df: DataFrame, keys: list[str], size: str, order: str, id_column: str) -> DataFrame:
    """(kept, merged): each row that gave way, with the row that stayed."""
    r = ranked(df.dropna(subset=keys), keys, size, order).select(*keys, id_column, "keeper_rank")
    kept = r.where("keeper_rank = 1").select(*keys, F.col(id_column).alias("kept"))
    return r.where("keeper_rank > 1").join(kept, keys).select("kept", F.col(id_column).alias("merged"))


def merge_append(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old and new rows by name; of each key the last in an order, new rows after old ones."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return pick(both, key, F.desc("_gen"), F.desc(order)).drop("_gen")
