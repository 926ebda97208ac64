"""Sources and sinks: parquet, JSON lines, JSON trees, text files with unknown encodings, merge-append."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings tried in turn. Fixed values.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1258", "latin-1")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet file, folder or glob; only the named columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores where a scan has fewer splits, for work that costs much more than a shuffle of its rows.

    Dealt by hash of the keys (without any, of all columns that have one): dealing in turn sorts a split's rows in the memory of one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    by = keys or ["`" + c.replace("`", "``") + "`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def pick_column(df: DataFrame, names: list[str], to: str) -> DataFrame:
    """Rename the first of several possible columns; a null column if none is there."""
    found = next((n for n in names if n in df.columns), None)
    return df.withColumnRenamed(found, to) if found else df.withColumn(to, F.lit(None).cast("string"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object file as rows of key and value."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias(key, value))


def harvest(json: Column, name: str) -> Column:
    """All scalar values of a key at any depth of a JSON text, in order."""
    return F.regexp_extract_all(json, F.lit(rf'"{name}"\s*:\s*"?([^",}}\]]+)'), F.lit(1))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files in any of ENCODINGS; the first that decodes counts."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str | None:
            for name in ENCODINGS:
                try:
                    return raw.decode(name)
                except UnicodeDecodeError:
                    continue
            return None

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("text"))


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
