"""Hybrid retrieval: candidates of several ways merged, expanded along edges, boosted and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.operators.search import authority, boost, combined, top_k
from codexloom.sources.shared import dealt, kept

#: Boosts of a keyword and of a title hint, factor of an expanded node, of one that a change touches. Fixed values.
EXACT, TITLE, GRAPH, MODIFIED = 0.08, 0.12, 1.25, 0.95


def merge(*ways: tuple[str, DataFrame]) -> DataFrame:
    """(query_id, uid, vector, lexical, sources): the best factor of each kind over ways ("vector" or "lexical", rows (query_id, uid, score))."""
    rows = None
    for name, found in ways:
        some = found.select("query_id", "uid", *(F.when(F.lit(name == c), F.col("score")).otherwise(0.0).alias(c) for c in ("vector", "lexical")), F.lit(name).alias("source"))
        rows = some if rows is None else rows.unionByName(some)
    return rows.groupBy("query_id", "uid").agg(F.max("vector").alias("vector"), F.max("lexical").alias("lexical"), F.array_sort(F.collect_set("source")).alias("sources"))


def averaged(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, uid, score): the mean of both scores where both ways found a row, else the one."""
    both = a.select("query_id", "uid", F.col("score").alias("x")).join(b.select("query_id", "uid", F.col("score").alias("y")), ["query_id", "uid"], "full")
    return both.select("query_id", "uid", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), (F.col("x") + F.col("y")) / 2).otherwise(F.coalesce("x", "y")).alias("score"))


def hits(haystack: Column, words: Column) -> Column:
    """How many of the words (lower case) a text holds."""
    low = F.lower(haystack)
    return F.size(F.filter(words, lambda w: (w != "") & F.contains(low, w)))


def boosted(candidates: DataFrame, texts: DataFrame, plans: DataFrame) -> DataFrame:
    """candidates(query_id, uid, ...) with exact, title and weight. A query's few words go to the text, not the text to the query.

    texts(uid, haystack, doc_type); plans(query_id, keywords, title_hints), arrays in lower case.
    """
    rows = dealt(candidates.join(plans, "query_id"), "uid").join(texts, "uid")
    exact, title = boost(hits(F.col("haystack"), F.col("keywords")), EXACT), boost(hits(F.col("haystack"), F.col("title_hints")), TITLE)
    return rows.select(*candidates.columns, exact.alias("exact"), title.alias("title"), authority(F.col("doc_type")).alias("weight"))


def scored(candidates: DataFrame, texts: DataFrame, plans: DataFrame) -> DataFrame:
    """candidates(query_id, uid, vector, lexical, graph, validity) with exact, title and score; texts and plans as for `boosted`."""
    score = combined(*map(F.col, ("vector", "lexical", "exact", "title", "graph", "weight", "validity")))
    return boosted(candidates, texts, plans).select("query_id", "uid", "vector", "lexical", "graph", "validity", "exact", "title", F.round(score, 9).alias("score"))  # rounded: equal scores tie whatever the order of their sums


def neighbours(seeds: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, uid, changed): the first neighbours by uid of each query's seeds(query_id, src), and whether a MODIFIES edge leads to them.

    edges(src, dst, rel_type) of either direction. What is among a query's first neighbours is so among those of each seed that has it, so no
    node gives away more than so many.
    """
    changed = F.coalesce(F.col("rel_type") == "MODIFIES", F.lit(False)).alias("changed")
    both = edges.select("src", "dst", changed).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), changed))
    first = F.dense_rank().over(Window.partitionBy("src").orderBy("dst"))  # sorted, and cut before anything is grouped: a task's memory stays small
    near = dealt(both, "src").withColumn("rank", first).where(F.col("rank") <= most).groupBy("src", "dst").agg(F.bool_or("changed").alias("changed"))
    near = near.groupBy("src").agg(F.collect_list(F.struct("dst", "changed")).alias("near"))  # at most so many
    found = dealt(dealt(seeds, "src").join(near, "src").select("query_id", "near"), "query_id").select("query_id", F.inline("near"))
    return top_k(found.groupBy("query_id", F.col("dst").alias("uid")).agg(F.bool_or("changed").alias("changed")), ["query_id"], most, "uid").drop("rank")


def ranked(rows: DataFrame, texts: DataFrame, plans: DataFrame, edges: DataFrame, top: int = 5, most: int = 10) -> DataFrame:
    """(query_id, uid, score, rank): rows(query_id, uid, vector, lexical) merged and scored, expanded from the first `top` of each query, and the first `top` then.

    A neighbour's graph factor rises, and a MODIFIES edge lowers its validity. At most `most` rows of a query are scored anew, so its other
    rows among the last are among its first `top` + `most` before.
    """
    one = F.lit(1.0)
    best = lambda c: F.coalesce(F.max(c), F.lit(0.0)).alias(c)
    candidates = dealt(rows.select("query_id", "uid", "vector", "lexical"), "query_id").groupBy("query_id", "uid").agg(best("vector"), best("lexical"))
    old = scored(candidates.withColumns({"graph": one, "validity": one}), texts, plans).select("query_id", "uid", "vector", "lexical", "score")
    old = kept(top_k(dealt(old, "query_id"), ["query_id"], 1 << 30, F.desc("score"), "uid"), "candidates")
    found = neighbours(old.where(F.col("rank") <= top).select("query_id", F.col("uid").alias("src")), edges, most)
    on = ["query_id", "uid"]
    found = dealt(found, *on).join(dealt(old.select(*on, "vector", "lexical"), *on), on, "left")
    known = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    new = scored(found.select(*on, known("vector"), known("lexical"), F.lit(GRAPH).alias("graph"), F.when(F.col("changed"), MODIFIED).otherwise(1.0).alias("validity")), texts, plans)
    both = old.where(F.col("rank") <= top + most).select(*on, "score", F.lit(False).alias("new")).unionByName(new.select(*on, "score", F.lit(True).alias("new")))
    both = dealt(both, "query_id").groupBy(*on).agg(F.max_by("score", "new").alias("score"))
    return top_k(both, ["query_id"], top, F.desc("score"), "uid").select("query_id", "uid", "score", "rank")


def retrieve(vector: DataFrame, lexical: DataFrame, texts: DataFrame, plans: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, uid, score, rank): both ways(query_id, uid, score) merged, scored, expanded from the best, scored again, the first `top` of each query."""
    zero, score = F.lit(0.0), F.col("score")
    rows = vector.select("query_id", "uid", score.alias("vector"), zero.alias("lexical")).unionByName(lexical.select("query_id", "uid", zero.alias("vector"), score.alias("lexical")))
    return ranked(rows, texts, plans, edges, top)
