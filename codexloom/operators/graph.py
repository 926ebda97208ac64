"""Vertices and edges as DataFrames: key checks, stubs, neighbours, bounded traversal, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.functions.identifiers import literal_map
from codexloom.sources.shared import cut

#: Raw relation labels to edge types. Fixed values.
RELATION_TYPES = {
    "Văn bản căn cứ": "CITES",
    "Văn bản dẫn chiếu": "REFERRED_BY",
    "Văn bản HD, QĐ chi tiết": "DETAILS",
    "Văn bản được HD, QĐ chi tiết": "DETAILED_BY",
    "Văn bản hết hiệu lực": "SUPERSEDED_BY",
    "Văn bản quy định hết hiệu lực": "SUPERSEDES",
    "Văn bản bị hết hiệu lực 1 phần": "PARTIALLY_SUPERSEDED_BY",
    "Văn bản quy định hết hiệu lực 1 phần": "PARTIALLY_SUPERSEDES",
    "Văn bản sửa đổi": "AMENDS",
    "Văn bản được sửa đổi": "AMENDED_BY",
    "Văn bản bổ sung": "SUPPLEMENTS",
    "Văn bản được bổ sung": "SUPPLEMENTED_BY",
    "Văn bản liên quan khác": "RELATED",
    "Văn bản đình chỉ": "SUSPENDS",
    "Văn bản bị đình chỉ": "SUSPENDED_BY",
    "Văn bản đình chỉ 1 phần": "PARTIALLY_SUSPENDS",
    "Văn bản bị đình chỉ 1 phần": "PARTIALLY_SUSPENDED_BY",
    "CAN_CU": "CITES",
    "SUA_DOI": "AMENDS",
    "HUONG_DAN": "DETAILS",
    "THAY_THE": "SUPERSEDES",
    "LIEN_QUAN": "RELATED",
}


def edge_type(label: Column) -> Column:
    return literal_map(RELATION_TYPES)[label]


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(src, dst, ...) whose ends are both in nodes(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def orphan_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_edges): ends that no node has, with the edges that name them."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    return ends.join(nodes.select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n_edges"))


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and a stub row (is_stub) for each end that is missing."""
    stubs = orphan_ends(edges, nodes).select("id", F.lit(True).alias("is_stub"))
    return nodes.withColumn("is_stub", F.lit(False)).unionByName(stubs, allowMissingColumns=True)


def upsert_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each (src, dst, rel_type), the last in an order; no self loops."""
    return edges.where("src <> dst").groupBy("src", "dst", "rel_type").agg(F.max(order).alias(order))


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, id, rel_type) over edges in either direction, distinct, without the seed itself."""
    both = edges.select("src", "dst", "rel_type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type"))
    found = seeds.select(F.col("id").alias("src")).distinct().join(both, "src").where("src <> dst")
    return found.select(F.col("src").alias("seed"), F.col("dst").alias("id"), "rel_type").distinct()


def adjacent_as_of(nodes: DataFrame, edges: DataFrame, at: str = "at") -> DataFrame:
    """(id, at, direction, other, rel_type, valid_from, rank): neighbours of nodes(id, at) over edges in force at that moment, by date.

    edges(src, dst, rel_type, valid_from, valid_to) hold from valid_from until before valid_to, an open one for good; direction is out or
    in. Sides are optional: a node without neighbours stays, with nulls. Edges and moments meet by node and year, so a node with edges of
    many years spreads over them.
    """
    last = nodes.agg(F.max(at).alias("_last"))
    held = edges.join(F.broadcast(last))  # a single row
    years = F.sequence(F.year("valid_from"), F.year(F.least(F.greatest(F.coalesce("valid_to", "_last"), "valid_from"), F.greatest("_last", "valid_from"))))
    each = held.select("src", "dst", "rel_type", "valid_from", "valid_to", F.explode(years).alias("_year"))
    side = lambda own, other, name: each.select(F.col(own).alias("id"), F.col(other).alias("other"), "rel_type", "valid_from", "valid_to", F.lit(name).alias("direction"), "_year")
    both = side("src", "dst", "out").unionByName(side("dst", "src", "in"))
    asked = nodes.select("id", F.col(at).alias("at"), F.year(at).alias("_year")).distinct()
    found = asked.join(both, ["id", "_year"]).where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    order = Window.partitionBy("id", "at", "direction").orderBy("valid_from", "other", "rel_type")
    ranked = found.select("id", "at", "direction", "other", "rel_type", "valid_from", F.row_number().over(order).alias("rank"))
    return asked.drop("_year").join(ranked, ["id", "at"], "left")


def reach(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth): the fewest steps from each seed along edges, up to a depth; each round is one equi join.

    Each round's new rows are a checkpoint, so the plan has one join and one anti join whatever the depth; it ends where nothing is new.
    """
    found = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct()
    found, steps = cut(found), cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("_to")).distinct())
    front = found
    for k in range(1, depth + 1):
        front = front.join(steps, "id").select("seed", F.col("_to").alias("id"), F.lit(k).alias("depth")).distinct()
        front = cut(front.join(found.select("seed", "id"), ["seed", "id"], "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def recursive_reach(spark, seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """As `reach`, by one recursive query; for shallow depths, as a row comes once for each length of path that leads to it."""
    return spark.sql(
        f"""
        WITH RECURSIVE r(seed, id, depth) AS (
            SELECT id, id, 0 FROM {{seeds}}
            UNION ALL
            SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN {{edges}} e ON r.id = e.src WHERE r.depth < {int(depth)}
        ) SELECT seed, id, min(depth) AS depth FROM r GROUP BY seed, id""",
        seeds=seeds.select("id").distinct(),
        edges=edges.select("src", "dst").distinct(),
    )


def write_references(refs: DataFrame, segments: DataFrame, docs: DataFrame) -> DataFrame:
    """(source_uid, target, target_kind, rel_type, action, raw) of refs(source_uid, target_uid, target_doc_id, raw, rel_type, action).

    A known source is needed. The target is the segment where it is known, else the document, else a stub named by the raw
    number where there is one; rows without any are left out, and equal edges are one, the last by action.
    """
    own = segments.select("uid").distinct()
    seg, doc = own.select(F.col("uid").alias("target_uid"), F.lit(True).alias("_seg")), docs.select(F.col("doc_id").alias("target_doc_id"), F.lit(True).alias("_doc")).distinct()
    rows = refs.join(own.withColumnRenamed("uid", "source_uid"), "source_uid", "left_semi").join(seg, "target_uid", "left").join(doc, "target_doc_id", "left")
    raw = F.nullif(F.trim(F.coalesce("raw", F.lit(""))), F.lit(""))
    kind = F.when(F.col("_seg"), "segment").when(F.col("_doc"), "document").when(raw.isNotNull(), "stub")
    target = F.when(F.col("_seg"), F.col("target_uid")).when(F.col("_doc"), F.col("target_doc_id").cast("string")).otherwise(raw)
    out = rows.select("source_uid", target.alias("target"), kind.alias("target_kind"), "rel_type", "action", raw.alias("raw")).where("target_kind is not null")
    return out.groupBy("source_uid", "target", "target_kind", "rel_type").agg(F.max("action").alias("action"), F.max("raw").alias("raw"))


def write_counts(edges: DataFrame) -> DataFrame:
    """(rel_type, n, stubs): edges written, and the stubs that they name."""
    return edges.groupBy("rel_type").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("target_kind") == "stub", F.col("target"))).alias("stubs"))


def upsert_segments(old: DataFrame, new: DataFrame, parents: DataFrame) -> DataFrame:
    """Segments(uid, parent_uid, ...) after new ones replaced those of their uid; new rows whose parent nobody has are left out."""
    last = new.dropDuplicates(["uid"])
    known = parents.select(F.col("uid").alias("parent_uid")).unionByName(last.select(F.col("uid").alias("parent_uid"))).distinct()
    ready = last.where("parent_uid is null").unionByName(last.where("parent_uid is not null").join(known, "parent_uid", "left_semi").select(last.columns))
    return old.join(ready.select("uid"), "uid", "left_anti").select(last.columns).unionByName(ready)


def resolution_report(edges: DataFrame) -> DataFrame:
    """(kind, total, exact, fuzzy, rate, buckets) of edges(kind, method, confidence); the rate is 1 without rows."""
    exact = F.count_if(F.col("method").isin("exact", "short_title_map"))
    c = F.col("confidence")
    bucket = [F.count_if(c >= 0.8), F.count_if((c >= 0.6) & (c < 0.8)), F.count_if((c >= 0.4) & (c < 0.6)), F.count_if(c < 0.4)]
    fuzzy = F.count_if(~F.col("method").isin("exact", "short_title_map", "unresolved"))
    out = edges.groupBy("kind").agg(F.count("*").alias("total"), exact.alias("exact"), fuzzy.alias("fuzzy"), F.array(*bucket).alias("buckets"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("exact") + F.col("fuzzy"), F.col("total")), F.lit(1.0)))


def samples(edges: DataFrame, n: int = 50) -> DataFrame:
    """(kind, total, sample): the first n sources of each kind, for a report."""
    first = F.row_number().over(Window.partitionBy("kind").orderBy("source_uid"))
    few = edges.withColumn("_n", first).where(F.col("_n") <= n).groupBy("kind").agg(F.array_sort(F.collect_list("source_uid")).alias("sample"))
    return edges.groupBy("kind").agg(F.count("*").alias("total")).join(few, "kind")
