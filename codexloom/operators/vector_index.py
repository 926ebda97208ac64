"""A stored vector index: inverted lists around centroids, probes, exact scores.

Centroids are fitted by k-means on a bounded sample (`sample` rows chosen by hash; the bound is a parameter). Every vector is put
into the list of its nearest centroid and written, by list, with the widest angle of each list beside it. Lists of any share
are cut into blocks of BLOCK rows by hash, so no task reads one list whole. A search reads the lists nearest to a query and scores their vectors exactly. The exact
search goes on: with the k-th best score known, it reads those lists too which the angle between query, centroid and list's rim leaves a
chance; what it skips can't be among the best.

Scores are cosines in double precision, rounded to six places, ties by vec_id. Vectors that are null, zero, of another length than the
centroids or hold null or non-finite components are in no list; such queries find nothing. Memory: a block and ASKED queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators.search import top_k
from codexloom.sources import shared

#: Rows of the sample that centroids are fitted on, rounds of k-means, rows in a block, queries that meet a block in one group, and at a time.
SAMPLE, ROUNDS, BLOCK, ASKED, QUERIES = 8192, 12, 4096, 8192, 512
#: What rounding of scores and angles may hide.
SLACK = 2e-6


@dataclass
class Index:
    """centroids: unit rows, one a list; table: list, block, vec_id, unit; lists: list, n, blocks, rim (widest angle)."""

    centroids: np.ndarray
    table: DataFrame
    lists: DataFrame


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit vectors, which rows they are); unusable rows are left out. Without dim the commonest length counts."""
    values = column.to_pylist()
    if dim is None:
        sizes = [len(v) for v in values if v]
        dim = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    at = [i for i, v in enumerate(values) if v is not None and len(v) == dim and None not in v]
    m = np.array([values[i] for i in at], np.float64).reshape(len(at), dim)
    with np.errstate(all="ignore"):
        norms = np.sqrt((m * m).sum(1))
        good = np.isfinite(m).all(1) & np.isfinite(norms) & (norms > 0)
        return m[good] / norms[good, None], np.array(at, np.int64)[good]


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by spherical k-means on at most `sample` rows; as many as the root of the rows, a quarter of the sample at most."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    m, _ = matrix(rows.column("embedding"))
    if not len(m):
        return m
    lists = lists or min(math.isqrt(max(vectors.count() - 1, 0)) + 1, sample // 4)
    centroids = m[:: max(1, len(m) // lists)][:lists].copy()
    for _ in range(ROUNDS):
        near = (m @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, m)
        norms = np.sqrt((sums * sums).sum(1))
        moved = norms > 0
        centroids[moved] = sums[moved] / norms[moved, None]
    return centroids


def build(spark: SparkSession, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, path: str | None = None) -> Index:
    """Fit, assign every row of vectors(vec_id, embedding) and write the index to a folder (by default a new one under the shared folder)."""
    centroids = fit(vectors, lists, sample)
    dim = centroids.shape[1]

    def assign(batches):
        for batch in batches:
            unit, at = matrix(batch.column("embedding"), dim)
            if len(unit):
                scores = unit @ centroids.T
                near = scores.argmax(1)
                angle = np.arccos(np.clip(scores[np.arange(len(near)), near], -1, 1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("vec_id").take(pa.array(at)).cast(pa.int64()), flat, pa.array(angle)], ["list", "vec_id", "unit", "angle"])

    path = path or shared.folder(spark, "vectors")
    rows = vectors.select("vec_id", "embedding").mapInArrow(assign, "list int, vec_id long, unit array<double>, angle double") if dim else spark.createDataFrame([], "list int, vec_id long, unit array<double>, angle double")
    rows.write.mode("overwrite").parquet(f"{path}/assigned")
    rows = spark.read.parquet(f"{path}/assigned")
    own = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("rim")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own.write.mode("overwrite").parquet(f"{path}/lists")
    own = spark.read.parquet(f"{path}/lists")
    placed = rows.join(F.broadcast(own.select("list", "blocks")), "list")  # at most a quarter of the sample
    placed = placed.select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "unit")
    placed.repartitionByRange("list", "block").sortWithinPartitions("list", "block").write.mode("overwrite").parquet(f"{path}/rows")
    return Index(centroids, spark.read.parquet(f"{path}/rows"), own)


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, unit, and for each list its angle to the query (array, by list) of usable queries."""
    centroids = index.centroids
    dim = centroids.shape[1]

    def run(batches):
        for batch in batches:
            unit, at = matrix(batch.column("query"), dim)
            if len(unit):
                angles = np.arccos(np.clip(unit @ centroids.T, -1, 1))
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)).cast(pa.int64()), lists(unit), lists(angles)], ["query_id", "unit", "angles"])

    return queries.select("query_id", "query").mapInArrow(run, "query_id long, unit array<double>, angles array<double>")


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): the first k rows of a block for each query."""
    out: list[tuple[np.ndarray, ...]] = []
    if left.num_rows and right.num_rows:
        m = np.array(left.column("unit").to_pylist(), np.float64)
        ids = left.column("vec_id").to_numpy()
        for i in range(0, right.num_rows, QUERIES):
            some = right.slice(i, QUERIES)
            scores = np.round(np.array(some.column("unit").to_pylist(), np.float64) @ m.T, 6)
            for q, row in zip(some.column("query_id").to_pylist(), scores, strict=True):
                best = np.lexsort((ids, -row))[:k]
                out.append((np.full(len(best), q), ids[best], row[best]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def _score(index: Index, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the first k of each block that a query probes. probes: query_id, unit, list."""
    probes = probes.select("query_id", "unit", "list")
    groups = probes.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups")).join(index.lists.select("list", "blocks"), "list")
    groups = F.broadcast(shared.cut(groups))  # a row a list: at most a quarter of the sample
    asked = probes.join(groups, "list").withColumn("group", F.pmod(F.xxhash64("query_id"), "groups").cast("int"))
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "group", "query_id", "unit")
    rows = index.table.join(groups, "list").select("list", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "vec_id", "unit")
    on = ["list", "block", "group"]
    return rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(lambda left, right: _best(left, right, k), "query_id long, vec_id long, score double")


def units(df: DataFrame, id_: str, vector: str, dim: int) -> DataFrame:
    """(id_, unit) of the usable vectors of a table."""

    def run(batches):
        for batch in batches:
            unit, at = matrix(batch.column(vector), dim)
            if len(unit):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(id_).take(pa.array(at)).cast(pa.int64()), flat], [id_, "unit"])

    return df.select(id_, vector).mapInArrow(run, f"{id_} long, unit array<double>")


def against_all(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the first k of each block of all vectors for each query, without an index."""
    sizes = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (sizes.dim, sizes.n) if sizes else (1, 0)
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-queries.count() // ASKED))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    rows = units(vectors, "vec_id", "embedding", dim).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("group", each(groups))
    asked = units(queries, "query_id", "query", dim).withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups))).withColumn("block", each(blocks))
    on = ["block", "group"]
    return rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(lambda left, right: _best(left, right, k), "query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k of the `probes` lists nearest to each query of queries(query_id, query)."""
    nearest = F.slice(F.array_sort(F.transform("angles", lambda a, i: F.struct(a.alias("angle"), i.cast("int").alias("list")))), 1, probes)
    asked = _asked(index, queries).select("query_id", "unit", F.explode(F.transform(nearest, lambda x: x["list"])).alias("list"))
    return top_k(_score(index, asked, k), ["query_id"], k, F.desc("score"), "vec_id")


def search_exact(index: Index, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
    """As `search`, but exact: after the nearest lists come those whose rim is within reach of the k-th best score so far."""
    asked = shared.cut(_asked(index, queries))
    ranked = F.array_sort(F.transform("angles", lambda a, i: F.struct(a.alias("angle"), i.cast("int").alias("list"))))
    each = asked.select("query_id", "unit", F.posexplode(ranked).alias("at", "x")).select("query_id", "unit", "at", F.col("x.angle").alias("angle"), F.col("x.list").alias("list"))
    first = shared.cut(top_k(_score(index, each.where(F.col("at") < probes), k), ["query_id"], k, F.desc("score"), "vec_id"))
    floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = each.where(F.col("at") >= probes).join(F.broadcast(index.lists.select("list", "rim")), "list").join(floor, "query_id", "left")
    most = F.cos(F.greatest(F.col("angle") - F.col("rim") - SLACK, F.lit(0.0)))
    rest = rest.where(F.col("floor").isNull() | (most + SLACK >= F.col("floor")))
    more = _score(index, rest.select("query_id", "unit", "list"), k)
    return top_k(first.drop("rank").unionByName(more), ["query_id"], k, F.desc("score"), "vec_id")
