"""Key lookup, exact and fuzzy resolution of document numbers, title matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.functions import identifiers as ids
from codexloom.functions.text import fuzzy_confidence


def pick(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """One row a key: the first in an order. An aggregate of a struct would do for few columns; this keeps all."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def lookup_table(docs: DataFrame, keep: str = "first") -> DataFrame:
    """(key, doc_id, ord) from docs(doc_id, so_ky_hieu, loai_van_ban, ord); of equal keys the first or the last."""
    keyed = docs.select(ids.normal_key(F.col("so_ky_hieu"), F.col("loai_van_ban")).alias("key"), "doc_id", "ord").where("key is not null")
    best = F.min_by if keep == "first" else F.max_by
    edge = F.min if keep == "first" else F.max
    return keyed.groupBy("key").agg(best("doc_id", "ord").alias("doc_id"), edge("ord").alias("ord"))


def _variants(part: Column) -> Column:
    """A part, and it without each of its characters: two parts one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(part), F.lit(1))), lambda i: F.concat(F.substring(part, F.lit(1), i - 1), F.substring(part, i + 1, F.lit(100))))
    return F.array_distinct(F.concat(F.array(part), cut))


def blocks(key: Column) -> Column:
    """Blocks of a key kind-number-year: keys within two edits, hyphens kept, share at least one.

    Two edits leave a part as it is. Either the others have one each, and share a variant; or a second part is as it is as well, and
    the third has up to two. Each block names two parts, so none grows with the keys of one kind or year alone.
    """
    p = F.split(key, "-")
    part = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    kind, number, year = part(0), part(1), part(2)
    named = lambda tag, fixed, some: F.transform(some, lambda v: F.concat_ws(":", F.lit(tag), fixed, v))
    twice = F.array_distinct(F.flatten(F.transform(_variants(number), _variants)))
    one = F.concat(named("a", kind, _variants(number)), named("b", number, _variants(year)), named("c", year, _variants(number)))
    two = F.concat(named("d", F.concat_ws(":", kind, year), twice), F.array(F.concat_ws(":", F.lit("e"), kind, number), F.concat_ws(":", F.lit("f"), number, year)))
    return F.array_distinct(F.concat(one, two))


def resolve(refs: DataFrame, lookup: DataFrame, max_distance: int = 2) -> DataFrame:
    """refs(ref_id, key) with doc_id, method, confidence: exact, else the nearest key within two edits, else one of the same kind and year.

    Keys have the form kind-number-year; candidates share a block, and each pair counts once.
    """
    if max_distance > 2:
        raise ValueError("blocks hold keys within two edits")
    parts = lambda c: F.split(c, "-")
    table = lookup.select(F.col("key").alias("known"), F.col("doc_id").alias("known_id"), "ord")
    exact = refs.join(lookup.select("key", "doc_id"), "key", "left")
    missing = exact.where("doc_id is null and key is not null").select("ref_id", "key")
    in_blocks = lambda df, c: df.withColumn("block", F.explode(blocks(F.col(c))))
    near = in_blocks(missing.select("key").distinct(), "key").join(in_blocks(table, "known"), "block").withColumn("distance", F.levenshtein("key", "known", max_distance)).where("distance >= 0")
    best = near.groupBy("key").agg(F.min(F.struct("distance", "ord", "known_id")).alias("b")).select("key", F.col("b.known_id").alias("fuzzy_id"), F.col("b.distance").alias("distance"))
    kind_year = lambda c: (parts(F.col(c))[0], F.get(parts(F.col(c)), F.lit(2)))
    by_year = table.withColumn("kind", kind_year("known")[0]).withColumn("year", kind_year("known")[1]).groupBy("kind", "year").agg(F.min_by("known_id", "ord").alias("year_id"))
    out = exact.join(best, "key", "left").withColumn("kind", kind_year("key")[0]).withColumn("year", kind_year("key")[1]).join(by_year, ["kind", "year"], "left")
    method = F.when(F.col("doc_id").isNotNull(), "exact").when(F.col("fuzzy_id").isNotNull(), "fuzzy").when(F.col("year_id").isNotNull(), "substring").otherwise("unresolved")
    confidence = F.when(F.col("doc_id").isNotNull(), 1.0).when(F.col("fuzzy_id").isNotNull(), fuzzy_confidence(F.col("distance"))).when(F.col("year_id").isNotNull(), 0.6).otherwise(0.0)
    return out.select("ref_id", "key", F.coalesce("doc_id", "fuzzy_id", "year_id").alias("doc_id"), method.alias("method"), F.round(confidence, 6).alias("confidence"))


def resolve_report(resolved: DataFrame) -> DataFrame:
    """Counts by method, and the share resolved; 1 without rows."""
    return resolved.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("method") == "exact").alias("exact"),
        F.count_if(F.col("method") == "fuzzy").alias("fuzzy"),
        F.count_if(F.col("method") == "substring").alias("substring"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("method") != "unresolved"), F.count("*")), F.lit(1.0)), 6).alias("resolution_rate"),
    )


def match_two_phase(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """targets(target_id, so_hieu, title, kind) with doc_id, match_method: by stripped number, else by a title alias."""
    by_number = docs.select(ids.strip_number(F.col("so_ky_hieu")).alias("number"), "doc_id", "ord").where("number <> ''").groupBy("number").agg(F.max_by("doc_id", "ord").alias("number_id"))
    aliases = docs.select(F.explode(ids.title_aliases(F.col("title"), F.col("loai_van_ban"))).alias("alias"), "doc_id", "ord").groupBy("alias").agg(F.max_by("doc_id", "ord").alias("title_id"))
    first = targets.withColumn("number", ids.strip_number(F.col("so_hieu"))).join(by_number, "number", "left")
    tried = targets.select("target_id", F.posexplode(ids.title_aliases(F.col("title"), F.col("kind"))).alias("at", "alias")).join(aliases, "alias")
    by_title = tried.groupBy("target_id").agg(F.min_by("title_id", "at").alias("title_id"))
    out = first.join(by_title, "target_id", "left")
    method = F.when(F.col("number_id").isNotNull(), "so_hieu").when(F.col("title_id").isNotNull(), "title").otherwise("none")
    return out.select("target_id", F.coalesce("number_id", "title_id").alias("doc_id"), method.alias("match_method"))
