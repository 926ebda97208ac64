"""Retrieval: BM25, cosine top-k, boosts, graph expansion, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.functions.identifiers import literal_map

#: Weights of document types in ranking; other types count 1. Fixed values.
AUTHORITY = {"Bộ luật": 3.0, "Luật": 3.0, "Nghị định": 2.0, "Thông tư": 1.5, "Thông tư liên tịch": 1.0}
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def ascii_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def top_k(df: DataFrame, per: list[str], k: int, *order: Column | str) -> DataFrame:
    """Rows of rank up to k in each group; the order must be total. Spark keeps k rows a group before the shuffle."""
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, tokenise=ascii_tokens) -> DataFrame:
    """(query_id, doc_id, score) for docs(doc_id, text) and queries(query_id, text) that share a term.

    Term rows are filtered by the queries' terms before they are counted, so only those are shuffled.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenise(F.col("text")))).alias("term"))
    words = docs.select("doc_id", tokenise(F.col("text")).alias("words")).withColumn("dl", F.size("words"))
    stats = words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = terms.select("term").distinct()
    tf = words.select("doc_id", "dl", F.explode("words").alias("term")).join(wanted, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    one = F.broadcast(stats)  # a single row
    idf = df.join(one).select("term", "avgdl", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, "term").join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): exact nearest rows of vectors(vec_id, embedding) to each query of queries(query_id, query).

    Rows are dealt into blocks and queries into groups, and a block meets a group in one task as matrices; only the best k of each block
    leave it. A stored index (`vector_index`) reads less of the table. Vectors that are null, zero, of an uncommon length or hold null or non-finite
    components are left out on both sides.
    """
    from codexloom.operators import vector_index

    return top_k(vector_index.against_all(vectors, queries, k), ["query_id"], k, F.desc("score"), "vec_id")


def authority(doc_type: Column) -> Column:
    return F.coalesce(literal_map({k: str(v) for k, v in AUTHORITY.items()})[doc_type].cast("double"), F.lit(1.0))


def boost(hits: Column, each: float, most: float = 0.24) -> Column:
    return F.least(hits * F.lit(each), F.lit(most))


def combined(vector: Column, lexical: Column, exact: Column, title: Column, graph: Column, weight: Column, validity: Column) -> Column:
    """The hybrid score: half the vector score, a quarter of the full-text score, boosts, times three factors."""
    return (0.50 * vector + 0.25 * lexical + exact + title) * graph * weight * validity
