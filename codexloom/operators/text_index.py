"""A stored inverted index with impact bounds: BM25 over weighted fields, postings skipped by block maxima.

Documents are dealt into cells of CELL documents. A posting row is (term, cell) with the impacts of that term on the cell's documents, and
the largest of them; terms have their document counts. An impact is a term's share of the score without the idf: the weighted sum over
fields of the saturated counts. A search knows from the maxima the most that any document of a cell can reach for a query. It
scores the most promising cells of each query, and with the k-th best score known it reads postings of those cells alone which can still
reach it; the result is that of scoring everything.

Building shuffles each text once, to its cell, and cuts it into words there; a cell's postings are made as its texts pass. A cell's
postings meet a group of ASKED queries as matrices, and only what can be among the best k of a query leaves it.

Rows: null fields are empty; documents without words have no postings; terms of a query count once; a query without known terms finds
nothing; ties go to the smaller doc_id. Postings of a term of any share are spread over its cells. Memory: an Arrow batch, the counted
words of a cell, and ASKED queries' terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators.search import B, K1, ascii_tokens, top_k
from codexloom.sources import shared

#: Documents in a cell, and cells that a query scores before it knows its k-th best score.
CELL, FIRST = 256, 4
#: Texts counted at a time, queries that meet a cell in one group, and queries and terms that do so as one matrix.
TEXTS, ASKED, QUERIES, TERMS = 512, 8192, 256, 8192
#: What sums of doubles in another order may differ by.
SLACK = 1e-7


@dataclass
class Index:
    """postings: term, cell, most, ids, impacts; bounds: the same without ids and impacts; terms: term, idf.

    In a search: keep is how many rows a query keeps of a cell, and how near to the last of them others stay too; groups of queries.
    """

    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    tokenise: Callable[[Column], Column]
    keep: tuple[int, float] | None = None
    groups: int = 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words with their counts; a text's words are together already, so nothing is shuffled to count them."""
    for batch in batches:
        words = batch.column("words")
        flat = pc.list_flatten(words).dictionary_encode()
        pairs = pc.list_parent_indices(words).to_numpy().astype(np.int64) * max(1, len(flat.dictionary)) + flat.indices.to_numpy()
        pairs, tf = np.unique(pairs, return_counts=True)
        rows, codes = np.divmod(pairs, max(1, len(flat.dictionary)))
        columns = {c: batch.column(c).take(pa.array(rows)) for c in batch.schema.names if c != "words"}
        yield pa.RecordBatch.from_pydict(columns | {"term": flat.dictionary.take(pa.array(codes)), "tf": pa.array(tf.astype(np.int32))})


def _ranked(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """A column's distinct values in order, and which of them each row has."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(codes.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return codes.dictionary.take(order), rank[codes.indices.to_numpy()]


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[0] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _cell(counted: list[pa.RecordBatch], weights: list[float], means: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """The postings of one cell; fields, and rows that share a doc_id, are summed."""
    rows = pa.Table.from_batches(counted)
    if not rows.num_rows:
        return
    (terms, t), (docs, d) = _ranked(rows["term"]), _ranked(rows["doc_id"])
    field, size, tf = (rows[c].to_numpy() for c in ("field", "size", "tf"))
    order = np.lexsort((tf, size, field, d, t))
    t, d, field, size, tf = (x[order] for x in (t, d, field, size, tf))
    mean = np.array([means.get(i) or 1.0 for i in range(len(weights))])  # a field without words has no rows here
    impact = np.array(weights)[field] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean[field]))
    at = _starts(t, d)
    impact, t, d = np.add.reduceat(impact, at), t[at], d[at]
    at = _starts(t)
    ends = pa.array(np.append(at, len(t)).astype(np.int32))
    columns = {"term": terms.take(pa.array(t[at])), "cell": pa.repeat(rows["cell"][0], len(at)), "most": pa.array(np.maximum.reduceat(impact, at))}
    yield pa.RecordBatch.from_pydict(columns | {"ids": pa.ListArray.from_arrays(ends, docs.take(pa.array(d))), "impacts": pa.ListArray.from_arrays(ends, pa.array(impact))})


def _postings(weights: list[float], means: dict[int, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: postings of rows that come by cell; a batch may end anywhere in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            cells = batch.column("cell").to_pylist()
            starts = [i for i in range(len(cells)) if i == 0 or cells[i] != cells[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(cells)], strict=True):
                if held and cells[i] != last:
                    yield from _cell(held, weights, means)
                    held = []
                held += _counts(batch.slice(x, min(TEXTS, j - x)) for x in range(i, j, TEXTS))
                last = cells[i]
        if held:
            yield from _cell(held, weights, means)

    return run


def build(spark: SparkSession, docs: DataFrame, fields: dict[str, float], tokenise: Callable[[Column], Column] = ascii_tokens, cell: int = CELL, path: str | None = None) -> Index:
    """Write the index of docs(doc_id, one text column a field) with a weight for each field."""
    path = path or shared.folder(spark, "postings")

    def words(rows: DataFrame, *keys: str) -> DataFrame:
        whole = rows.select(*keys, F.posexplode(F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields))).alias("field", "text"))
        return whole.select(*keys, "field", tokenise(F.col("text")).alias("words")).withColumn("size", F.size("words"))

    means = {r.field: r["mean"] for r in words(docs).groupBy("field").agg(F.avg("size").alias("mean")).collect()}  # a row a field
    placed = docs.select("doc_id", F.floor(F.col("doc_id") / cell).alias("cell"), *fields)
    placed = shared.dealt(placed, "cell").sortWithinPartitions("cell")  # texts are shuffled, not their words
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = words(placed, "doc_id", "cell").mapInArrow(_postings(list(map(float, fields.values())), means), f"term string, cell long, most double, ids array<{kind}>, impacts array<double>")
    postings = shared.written(rows, f"{path}/postings")
    n = docs.agg(F.count("*").alias("n"))
    often = postings.groupBy("term").agg(F.sum(F.size("ids")).alias("df")).join(F.broadcast(n))  # a single row
    often.select("term", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")
    return Index(postings, postings.select("term", "cell", "most"), spark.read.parquet(f"{path}/terms"), tokenise)


def _met(held: pa.Table, asked: pa.Table, keep: tuple[int, float] | None) -> pa.Table:
    """(query_id, doc_id, score) of a cell's postings and queries' terms; of each query those that can be among its first."""
    ids = held["ids"].combine_chunks()
    if not held.num_rows or not asked.num_rows:
        return pa.table({"query_id": asked["query_id"][:0], "doc_id": pc.list_flatten(ids)[:0], "score": pa.array([], pa.float64())})
    docs, d = _ranked(pa.chunked_array([pc.list_flatten(ids)]))
    impacts = pc.list_flatten(held["impacts"].combine_chunks()).to_numpy()
    lengths = pc.list_value_length(ids).to_numpy()
    begins = np.cumsum(lengths) - lengths
    asked = asked.append_column("at", pc.index_in(asked["term"], held["term"].combine_chunks())).drop_null()
    queries, q = _ranked(asked["query_id"])
    order = np.argsort(q, kind="stable")
    q, at, idf = q[order], asked["at"].to_numpy()[order], asked["idf"].to_numpy()[order]
    firsts = np.searchsorted(q, np.arange(len(queries) + 1))
    positive = bool((impacts > 0).all() and (idf > 0).all())
    out: list[tuple[np.ndarray, ...]] = []
    i = 0
    while i < len(queries):  # some queries and their terms, as many as make small matrices
        j = max(i + 1, min(i + QUERIES, int(np.searchsorted(firsts, firsts[i] + TERMS, "right")) - 1))
        own = slice(firsts[i], firsts[j])
        terms, t = np.unique(at[own], return_inverse=True)
        share = np.zeros((j - i, len(terms)))
        share[q[own] - i, t] = idf[own]
        row = np.repeat(np.arange(len(terms)), lengths[terms])
        places = np.arange(len(row)) + np.repeat(begins[terms] - np.cumsum(lengths[terms]) + lengths[terms], lengths[terms])
        weight = np.zeros((len(terms), len(docs)))
        weight[row, d[places]] = impacts[places]
        scores = share @ weight
        if positive:
            hit = scores > 0
        else:  # terms that weigh nothing find their documents too
            there, has = np.zeros(share.shape), np.zeros(weight.shape)
            there[q[own] - i, t], has[row, d[places]] = 1, 1
            hit = there @ has > 0
        if keep and keep[0] < len(docs):
            last = np.partition(np.where(hit, scores, -np.inf), -keep[0], axis=1)[:, -keep[0]]
            hit &= scores >= last[:, None] - keep[1]
        a, b = np.nonzero(hit)
        out.append((a + i, b, scores[a, b]))
        i = j
    a, b, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"query_id": queries.take(pa.array(a)), "doc_id": docs.take(pa.array(b)), "score": pa.array(scores)})


def _scores(index: Index, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) over the postings of wanted(query_id, term, idf, cell)."""
    keep, groups = index.keep, index.groups
    asked = wanted.select("cell", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group"), "query_id", "term", "idf")
    held = index.postings.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "term", "ids", "impacts")
    kind = lambda x: x.dataType.simpleString()
    schema = f"query_id {kind(wanted.schema['query_id'])}, doc_id {index.postings.schema['ids'].dataType.elementType.simpleString()}, score double"
    on = ["cell", "group"]
    return held.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(lambda left, right: _met(left, right, keep), schema)


def search(index: Index, queries: DataFrame, k: int, digits: int = 6, first: int = FIRST) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k of each query of queries(query_id, text), scores rounded."""
    # rounded scores tie within half a digit, so what is that near to a cell's k-th best stays too
    index = replace(index, keep=(k, SLACK + 10.0**-digits), groups=max(1, -(-queries.count() // ASKED)))
    terms = queries.select("query_id", F.explode(F.array_distinct(index.tokenise(F.col("text")))).alias("term")).join(index.terms, "term")
    terms = shared.kept(terms, "terms")
    known = terms.select("term").distinct()
    postings = shared.among(index.postings, known, "term")
    reach = shared.kept(terms.join(shared.among(index.bounds, known, "term"), "term"), "reach")
    cells = reach.groupBy("query_id", "cell").agg(F.sum(F.col("most") * F.col("idf")).alias("bound"))
    cells = shared.kept(top_k(cells, ["query_id"], 1 << 30, F.desc("bound"), "cell"), "cells")

    def scores(some: DataFrame) -> DataFrame:
        wanted = reach.select("query_id", "term", "idf", "cell").join(some, ["query_id", "cell"], "left_semi")
        return _scores(replace(index, postings=shared.among(postings, some.select("cell").distinct(), "cell")), wanted)

    start = shared.cut(scores(cells.where(F.col("rank") <= first).select("query_id", "cell")))
    best = top_k(start, ["query_id"], k, F.desc("score"), "doc_id")
    floor = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    # rounded scores tie within half a digit, so a cell that reaches the floor but for that is read too
    rest = cells.where(F.col("rank") > first).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + SLACK + 10.0**-digits >= F.col("floor")))
    more = scores(shared.kept(rest.select("query_id", "cell"), "rest"))
    found = start.unionByName(more).withColumn("score", F.round("score", digits))
    return top_k(found, ["query_id"], k, F.desc("score"), "doc_id")
