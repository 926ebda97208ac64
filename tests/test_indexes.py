"""Vector lists, postings with bounds and segmented scans against brute force."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from codexloom.operators import carried, search, text_index, vector_index
from codexloom.plans import catalogue
from tests.compare import rows as sorted_rows

RNG = random.Random(8)


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[0 if i % 3 == 0 else i % 12] + 0.35 * rng.normal(size=dim)).tolist()) for i in range(n)]


def best(rows, k):
    """The k nearest by cosine to every fiftieth row."""
    ok = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    m = np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            scores = np.round(m @ v, 6)
            out[i] = [ok[j][0] for j in sorted(range(len(ok)), key=lambda j: (-scores[j], ok[j][0]))[:k]]
    return out


def test_vector_index(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "ASKED", 8)
    rows = clustered(1500) + [(2000, None), (2050, [0.0] * 16), (2100, [1.0] * 3), (2101, [1.0] * 15 + [None]), (2102, [float("nan")] * 16), (2103, clustered(1)[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(spark, vectors, sample=400)
    assert index.table.count() == 1501 and index.table.groupBy("list", "block").count().agg(F.max("count")).first()[0] <= 64 * 2
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def lists(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.vec_id)
        return out

    want = best(rows, 10)
    assert lists(vector_index.search_exact(index, asked, 10)) == want
    near = lists(vector_index.search(index, asked, 10, probes=6))
    recall = sum(len(set(near[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert set(near) == set(want) and recall >= 0.9
    few = lists(vector_index.search_exact(index, asked, 2000))
    assert all(len(x) == 1501 for x in few.values())
    none = vector_index.build(spark, vectors.limit(0))
    assert vector_index.search_exact(none, asked, 3).count() == 0


def test_recall_on_the_driver_s_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector_index.build(spark, vectors)
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    want, found = pairs(search.cosine_top_k(vectors, asked, 10)), pairs(vector_index.search(index, asked, 10, probes=17))  # of 23 lists: these vectors hardly cluster
    assert len(want & found) >= 0.9 * len(want)


def test_text_index_skips_postings_and_loses_nothing(spark):
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    rows = [(i, " ".join(RNG.choices(words, weights, k=RNG.randrange(0, 60)))) for i in range(3000)] + [(5000, None), (5001, ""), (5002, "w150 w150 w150 w151")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w0 w150"), (2, "w3 w77 w199"), (3, "zz"), (4, ""), (5, "w150 w151 w0 w1 w2")], "query_id long, text string")
    index = text_index.build(spark, docs, {"text": 1.0}, cell=16)
    read = []
    scores = text_index._scores

    def spy(i, wanted):
        read.append(wanted.count())
        return scores(i, wanted)

    text_index._scores = spy
    try:
        got = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in text_index.search(index, asked, 5).collect()}
    finally:
        text_index._scores = scores
    want = search.top_k(search.bm25(docs.fillna({"text": ""}), asked).withColumn("score", F.round("score", 6)), ["query_id"], 5, F.desc("score"), "doc_id").collect()
    assert got == {(r.query_id, r.doc_id, r.score, r["rank"]) for r in want}
    terms = asked.select("query_id", F.explode(F.array_distinct(search.ascii_tokens(F.col("text")))).alias("term"))
    assert 0 < sum(read) < 0.6 * terms.join(index.bounds, "term").count()
    assert text_index.search(text_index.build(spark, docs.limit(0), {"text": 1.0}), asked, 5).count() == 0


def brute_carried(rows):
    out, state = [], {}
    for k, o, a, b, c, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s = state.setdefault(k, [None, None, None, None])
        if a is not None:
            s[:3] = [a, None, None]
        if b is not None:
            s[1:3] = [b, None]
        if c is not None:
            s[2] = c
        if v is not None:
            s[3] = v if s[3] is None else max(s[3], v)
        out.append((k, o, *s))
    return sorted(out, key=str)


def test_carried_over_ranges(spark):
    some = lambda p, x: x if RNG.random() < p else None
    for share in (1.0, 0.4):
        rows = [("hot" if RNG.random() < share else RNG.choice(["x", "y", None]), i, some(0.01, f"d{i}"), some(0.05, f"a{i}"), some(0.2, f"c{i}"), some(0.5, float(RNG.randrange(10**6)))) for i in range(3000)]
        df = spark.createDataFrame(rows, "k string, o long, a string, b string, c string, v double")
        got = carried.carried(df, ["k"], ["o"], {"document": "a", "article": "b", "clause": "c"}, {"best": "v"}, ranges=8)
        assert sorted(((r.k, r.o, r.document, r.article, r.clause, r.best) for r in got.collect()), key=str) == brute_carried(rows)
    empty = carried.carried(df.limit(0), ["k"], ["o"], {"document": "a"})
    assert empty.count() == 0 and empty.columns == [*df.columns, "document"]


def test_words_are_counted_where_their_text_is(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [5, 6], "field": pa.array([0, 0], pa.int32()), "words": [["a", "b", "a"], []], "size": pa.array([3, 0], pa.int32())})
    (got,) = text_index._counts([batch])
    assert got.to_pylist() == [{"doc_id": 5, "field": 0, "size": 3, "term": "a", "tf": 2}, {"doc_id": 5, "field": 0, "size": 3, "term": "b", "tf": 1}]
    docs = spark.createDataFrame([(1, "a b", "a"), (1, "a", None), (2, "b", "b b")], "doc_id long, x string, y string")
    (held,) = text_index.build(spark, docs, {"x": 1.0, "y": 2.0}).postings.where("term = 'a'").collect()
    assert held.ids == [1] and len(held.impacts) == 1 and held.most == held.impacts[0]


def test_cells_leave_their_first_rows_alone(spark, monkeypatch):
    """No posting is shuffled to be grouped, batches may end anywhere in a cell, and a cell gives a query its first rows, not all."""
    docs = spark.createDataFrame([(i, "a " * (i % 7) + "b " * (i % 5) + f"c{i} é", "b") for i in range(300)] + [(3, None, "a b"), (299, "", "c1")], "doc_id long, x string, y string")
    fields = {"x": 1.0, "y": 2.0}
    held = lambda: sorted(map(str, text_index.build(spark, docs, fields, cell=32).postings.collect()))
    whole = held()
    monkeypatch.setattr(text_index, "TEXTS", 3)
    monkeypatch.setattr(text_index, "TERMS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert held() == whole and len(whole) > 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = text_index.build(spark, docs, fields, cell=300)
    asked = spark.createDataFrame([(1, "a"), (2, "a b zz"), (3, "zz"), (4, "c1 b")], "query_id int, text string")
    wanted = asked.select("query_id", F.explode(search.ascii_tokens(F.col("text"))).alias("term")).join(index.terms, "term").withColumn("cell", F.lit(0).cast("long"))
    every = {(r.query_id, r.doc_id): r.score for r in text_index._scores(index, wanted).collect()}
    assert sum(q == 1 for q, _ in every) > 250 and {q for q, _ in every} == {1, 2, 4}
    for groups in (1, 3):
        few = text_index._scores(text_index.replace(index, keep=(5, 1e-9), groups=groups), wanted).collect()
        assert len(few) < 150 and all(abs(every[r.query_id, r.doc_id] - r.score) < 1e-9 for r in few)
        for q in (1, 2, 4):
            least = sorted((s for (x, _), s in every.items() if x == q), reverse=True)[4]
            assert {r.doc_id for r in few if r.query_id == q} == {d for (x, d), s in every.items() if x == q and s >= least - 1e-9}
    light = text_index.build(spark, docs, {"x": 0.0, "y": 0.0}, cell=32)
    assert [(r.query_id, r.doc_id, r.score) for r in text_index.search(light, asked.where("query_id = 1"), 2).orderBy("rank").collect()] == [(1, 1, 0.0), (1, 2, 0.0)]


def asks_every_question(spark, folder, name):
    """The query over a few documents and questions finds something for each question, and what its SQL finds."""
    spark.createDataFrame([(i, f"alpha w{i} beta", "en", "web") for i in range(9)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"w{i} beta") for i in range(7)] + [(50, "beta"), (51, "zz alpha")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = catalogue.queries()[name](spark, str(folder))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = c.execute(catalogue.oracle_sql()[name])
    names, got = [x[0] for x in want.description], [tuple(r) for r in found.collect()]
    assert sorted_rows(found.columns, got) == sorted_rows(names, want.fetchall()) and {r[0] for r in got} == {*range(7), 50, 51}


def test_fields_are_searched_for_every_question(spark, tmp_path):
    asks_every_question(spark, tmp_path, "bm25_index_fields")


def test_postings_are_searched_for_every_question(spark, tmp_path):
    asks_every_question(spark, tmp_path, "bm25_index_topk")
    assert "item_id" not in catalogue.oracle_sql()["bm25_index_topk"].split("FROM benchmark")[1]
