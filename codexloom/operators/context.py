"""Hierarchies of segments: leaf texts with their context, the ladder from a segment to its document, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.functions.identifiers import blank_to_null, citation, clause_uid, point_uid
from codexloom.operators.lookup import pick
from codexloom.sources.shared import dealt


def segment_type(labels: Column) -> Column:
    """The most specific label of a segment."""
    return F.coalesce(*(F.when(F.array_contains(labels, x), F.lit(x)) for x in ("Point", "Clause", "Article")), F.lit("LegalSegment"))


def leaf_contexts(articles: DataFrame, clauses: DataFrame, points: DataFrame) -> DataFrame:
    """(uid, doc_id, text): each point, clause without points and article without clauses, its text below those it stands in.

    articles(uid, doc_id, idx, text), clauses(uid, parent, idx, text), points(uid, parent, letter, text). A uid that comes
    twice counts once, the first in the order of the document.
    """
    a = articles.select(F.col("uid").alias("a_uid"), "doc_id", F.col("idx").try_cast("int").alias("a_idx"), F.trim("text").alias("a_text"))
    c = clauses.select(F.col("uid").alias("c_uid"), F.col("parent").alias("a_uid"), F.col("idx").try_cast("int").alias("c_idx"), F.trim("text").alias("c_text"))
    p = points.select(F.col("uid").alias("p_uid"), F.col("parent").alias("c_uid"), "letter", F.trim("text").alias("p_text"))
    rows = dealt(dealt(a, "a_uid").join(c, "a_uid", "left"), "c_uid").join(p, "c_uid", "left")
    text = F.concat_ws("\n", F.coalesce("a_text", F.lit("")), blank_to_null(F.col("c_text")), blank_to_null(F.col("p_text")))
    rows = rows.select(F.coalesce("p_uid", "c_uid", "a_uid").alias("uid"), "doc_id", text.alias("text"), "a_idx", "c_idx", "letter")
    return pick(dealt(rows, "uid"), "uid", "doc_id", F.asc_nulls_last("a_idx"), F.asc_nulls_last("c_idx"), F.asc_nulls_last("letter")).select("uid", "doc_id", "text")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows(doc_id, article, clause, point) numbered as they stand in their document; numbers that are no integers come last."""
    number = lambda c: F.asc_nulls_last(F.col(c).try_cast("int"))
    w = Window.partitionBy("doc_id").orderBy(number("article"), number("clause"), F.asc_nulls_last("point"), "article", "clause")
    return rows.withColumn("place", F.row_number().over(w))


def ladder(nodes: DataFrame, points: DataFrame, clauses: DataFrame, articles: DataFrame, chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes(uid) with what they stand in: segment_type, article_uid, clause_uid, chapter_uid, doc_id, title, text, display_citation.

    Levels are optional: points(uid, parent, letter, text), clauses(uid, parent, idx, text), articles(uid, parent, idx, text; the
    parent is a chapter or a document), chapters(uid, parent), docs(doc_id, title). An unknown uid gets nulls and itself as citation.
    """
    p = points.select("uid", F.col("parent").alias("p_clause"), "letter", F.col("text").alias("p_text"), F.lit("Point").alias("p"))
    rows = dealt(nodes.select("uid"), "uid").distinct().join(p, "uid", "left").withColumn("c_uid", F.coalesce("p_clause", "uid"))
    c = clauses.select(F.col("uid").alias("c_uid"), F.col("parent").alias("c_article"), F.col("idx").alias("clause"), F.col("text").alias("c_text"), F.lit("Clause").alias("c"))
    rows = dealt(rows, "c_uid").join(c, "c_uid", "left").withColumn("a_uid", F.coalesce("c_article", "uid"))
    a = articles.select(F.col("uid").alias("a_uid"), F.col("parent").alias("a_parent"), F.col("idx").alias("article"), F.col("text").alias("a_text"), F.lit("Article").alias("a"))
    a = _standing(a, chapters, docs)
    rows = dealt(rows, "a_uid").join(a, "a_uid", "left")
    kind = F.coalesce("p", "c", "a")
    text = F.concat_ws("\n", *(blank_to_null(F.col(x)) for x in ("a_text", "c_text", "p_text")))
    return rows.select(
        "uid",
        kind.alias("segment_type"),
        F.when(F.col("a").isNotNull(), F.col("a_uid")).alias("article_uid"),
        F.when(F.col("c").isNotNull(), F.col("c_uid")).alias("clause_uid"),
        F.when(F.col("ch_doc").isNotNull(), F.col("a_parent")).alias("chapter_uid"),
        F.when(F.col("title").isNotNull(), F.col("doc_id")).alias("doc_id"),
        "title",
        text.alias("text"),
        citation(F.col("article"), F.col("clause"), F.col("letter"), F.col("title"), F.col("uid")).alias("display_citation"),
    )


def _standing(articles: DataFrame, chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """articles(a_parent, ...) with ch_doc, doc_id, title: what an article stands in hangs on the article alone, so articles meet it once, not with all below them."""
    ch = chapters.select(F.col("uid").alias("a_parent"), F.col("parent").alias("ch_doc"))
    return articles.join(ch, "a_parent", "left").withColumn("doc_id", F.coalesce("ch_doc", "a_parent")).join(docs.select("doc_id", "title"), "doc_id", "left")


def ladders(articles: DataFrame, clauses: DataFrame, chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """Every article, clause and point with the columns of `ladder`, where clauses know the key of their article.

    articles(key, uid, parent, idx, text; the parent is a chapter or a document), clauses(key, idx, text, points: array of letter, text), chapters(uid,
    parent), docs(doc_id, title). The one join of all clauses is by that key, and uids are made behind it: neither uids nor points are shuffled.
    A clause without a number, or a point without a letter, has a null uid, and no points stand in the former. Clauses of no article, and
    articles without uid or key, are left out.
    """
    a = articles.select("key", F.col("uid").alias("a_uid"), F.col("parent").alias("a_parent"), F.col("idx").alias("article"), F.col("text").alias("a_text"))
    a = _standing(a.where("key is not null and a_uid is not null"), chapters, docs)
    text = lambda *cs: F.concat_ws("\n", *(blank_to_null(F.col(c)) for c in cs)).alias("text")
    level = lambda kind, letter, own: F.struct(F.lit(kind).alias("kind"), letter.cast("string").alias("letter"), own.cast("string").alias("p_text"))

    def shown(rows: DataFrame, uid: Column, kind: Column, c_uid: Column, clause: Column, letter: Column, *texts: str) -> DataFrame:
        columns = [uid.alias("uid"), kind.alias("segment_type"), F.col("a_uid").alias("article_uid"), c_uid.cast("string").alias("clause_uid"), F.when(F.col("ch_doc").isNotNull(), F.col("a_parent")).alias("chapter_uid")]
        columns += [F.when(F.col("title").isNotNull(), F.col("doc_id")).alias("doc_id"), "title", text(*texts), citation(F.col("article"), clause, letter, F.col("title"), uid).alias("display_citation")]
        return rows.select(*columns)

    null = F.lit(None)
    rows = dealt(a, "key").join(clauses.select("key", F.col("idx").alias("clause"), F.col("text").alias("c_text"), "points"), "key")
    points = F.transform(F.filter("points", lambda p: F.col("clause").isNotNull()), lambda p: level("Point", p["letter"], p["text"]))
    rows = rows.withColumn("x", F.explode(F.concat(F.array(level("Clause", null, null)), F.coalesce(points, F.array())))).select("*", "x.*")
    c_uid = clause_uid(F.col("a_uid"), F.col("clause"))
    uid = F.when(F.col("kind") == "Point", point_uid(c_uid, F.col("letter"))).otherwise(c_uid)
    return shown(a, F.col("a_uid"), F.lit("Article"), null, null, null, "a_text").unionByName(shown(rows, uid, F.col("kind"), c_uid, F.col("clause"), F.col("letter"), "a_text", "c_text", "p_text"))


def hydrate(ranked: DataFrame, ladders: DataFrame) -> DataFrame:
    """ranked(uid, ...) with their ladder's columns, in any order; rows whose uid no ladder has keep nulls."""
    return ranked.join(ladders, "uid", "left")


def legal_segments(nodes: DataFrame) -> DataFrame:
    """nodes(uid, labels, embedding, ...) that are embedded segments, with segment_type."""
    kept = nodes.where(F.col("uid").isNotNull() & F.col("embedding").isNotNull() & F.arrays_overlap("labels", F.array(*map(F.lit, ("Article", "Clause", "Point")))))
    return kept.withColumn("segment_type", segment_type(F.col("labels")))


def label_counts(nodes: DataFrame) -> DataFrame:
    """(labels, n, dimensions): embedded nodes by their set of labels, most first, with the lengths that their vectors have."""
    own = nodes.where("embedding is not null").select(F.array_join(F.array_sort("labels"), "|").alias("labels"), F.size("embedding").alias("d"))
    return own.groupBy("labels").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("d")).alias("dimensions")).orderBy(F.desc("n"), "labels")


def write_back(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """nodes(uid, ...) with the vectors(uid, embedding) of their keys; those without one keep what they had."""
    new = vectors.select("uid", F.col("embedding").alias("_new"))
    old = F.col("embedding") if "embedding" in nodes.columns else F.lit(None).cast(vectors.schema["embedding"].dataType)
    return nodes.join(new, "uid", "left").withColumn("embedding", F.coalesce("_new", old)).drop("_new")


def unprocessed(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """nodes(uid, ...) whose uid isn't among done(uid): what a stopped run has left."""
    return nodes.join(done.select("uid").distinct(), "uid", "left_anti")
