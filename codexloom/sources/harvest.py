"""Values of a key at any depth of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.sources.shared import cut


def harvested(df: DataFrame, keep: list[str], json: Column, name: str) -> DataFrame:
    """(keep, value): every scalar that stands under the key `name`, as text, a row each, however deep.

    Each round opens one level of all objects and arrays that are left, as variants, and ends where none is; a JSON null counts as
    no value. Texts that are null or no JSON have no rows; what only looks like a key inside a string isn't one.
    """
    spark = df.sparkSession
    front = cut(df.select(*keep, F.try_parse_json(json).alias("_v")).where(F.col("_v").isNotNull()))
    named, found = ", ".join(f"f.`{k}`" for k in keep), None
    while True:
        opened = spark.sql(f"SELECT {named}, e.key AS _key, e.value AS _v FROM {{front}} AS f, LATERAL variant_explode_outer(f._v) AS e", front=front).where("_v is not null")
        opened = cut(opened.withColumn("_nested", F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)<")))
        if opened.isEmpty():
            break
        here = opened.where((F.col("_key") == name) & ~F.col("_nested") & ~F.is_variant_null("_v")).select(*keep, F.variant_get("_v", "$", "string").alias("value"))
        found = here if found is None else found.unionByName(here)
        front = opened.where("_nested").select(*keep, "_v")
    return found if found is not None else df.select(*keep, F.lit("").alias("value")).limit(0)
