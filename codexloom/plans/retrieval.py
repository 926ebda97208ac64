"""Vector and full-text search, boosts, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.functions.text import squash
from codexloom.operators import search
from codexloom.plans.registry import query, table

_BM25 = """(WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 50 = 0),
 tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
 SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2)"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


def _scores(spark, d):
    queries = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(table(spark, d, "documents"), queries)


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM {_BM25})) WHERE rank <= 5")
def bm25_topk(spark, d):
    return search.top_k(_scores(spark, d).withColumn("score", F.round("score", 6)), ["query_id"], 5, F.desc("score"), "doc_id")


@query(f"SELECT query_id, doc_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (1 / (1 + pow(2.71828::DOUBLE, -score / 5)) - 0.5::DOUBLE))), 6) AS lexical FROM {_BM25}")
def bm25_squashed(spark, d):
    return _scores(spark, d).select("query_id", "doc_id", F.round(squash(F.col("score")), 6).alias("lexical"))


_KNN = "(SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0)"


def _knn(spark, d, k):
    vectors = table(spark, d, "embeddings")
    return search.cosine_top_k(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k)


@query(f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {_KNN}) WHERE rank <= 10")
def knn_cosine_topk(spark, d):
    return _knn(spark, d, 10)


@query(f"SELECT vec_id, max(score) AS score, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {_KNN}) WHERE rank <= 10 GROUP BY 1")
def knn_multi_query_max(spark, d):
    return _knn(spark, d, 10).groupBy("vec_id").agg(F.max("score").alias("score"), F.count("*").alias("hits"))


@query(f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {_KNN}) WHERE rank <= 10 AND label = 3")
def knn_post_filter(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    return _knn(spark, d, 10).join(labels, "vec_id").where("label = 3").drop("label")


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS right_size, count(*) FILTER (list_contains(embedding, NULL)) AS with_null FROM embeddings GROUP BY 1")
def embedding_verify(spark, d):
    holes = F.exists("embedding", lambda x: x.isNull())
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("right_size"), F.count_if(holes).alias("with_null"))


_HYBRID = f"""(SELECT b.query_id, b.doc_id, round((0.25::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (1 / (1 + pow(2.71828::DOUBLE, -b.score / 5)) - 0.5::DOUBLE))) + least(0.08::DOUBLE * hits, 0.24::DOUBLE))
  * CASE d.lang WHEN 'en' THEN 3.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE WHEN 'fr' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN coalesce(l.quality, 1) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 6) AS score
 FROM {_BM25} b JOIN (SELECT doc_id, lang, (contains(lower(text), 'the '))::INT + (contains(lower(text), 'der '))::INT AS hits FROM documents) d USING (doc_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT *, {_TOP} AS rank FROM {_HYBRID}) WHERE rank <= 5")
def hybrid_rerank(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    t = F.lower("text")
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.contains(t, F.lit("the ")).cast("int") + F.contains(t, F.lit("der ")).cast("int")).alias("hits"))
    rows = _scores(spark, d).join(docs, "doc_id").join(labels, "doc_id", "left")
    kind = F.when(F.col("lang") == "en", "Luật").when(F.col("lang") == "de", "Nghị định").when(F.col("lang") == "fr", "Thông tư").otherwise("khác")
    validity = F.when(F.coalesce("quality", F.lit(1)) == 1, 1.0).otherwise(0.5)
    zero, one = F.lit(0.0), F.lit(1.0)
    score = search.combined(zero, squash(F.col("score")), search.boost(F.col("hits"), 0.08), zero, one, search.authority(kind), validity)
    return search.top_k(rows.select("query_id", "doc_id", F.round(score, 6).alias("score")), ["query_id"], 5, F.desc("score"), "doc_id")


@query("SELECT lang, round(sum(n_chars * CASE lang WHEN 'en' THEN 3.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 2) AS weighted FROM documents GROUP BY 1")
def authority_weighted(spark, d):
    kind = F.when(F.col("lang") == "en", "Bộ luật").when(F.col("lang") == "de", "Nghị định").otherwise("khác")
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(F.col("n_chars") * search.authority(kind)), 2).alias("weighted"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
