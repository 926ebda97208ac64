"""Stored indexes, segmented scans, adjacency in time, nested keys, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.operators import carried, graph, html, text_index, vector_index
from codexloom.plans.documents import _CLEAN, _text_sql
from codexloom.plans.registry import query, table
from codexloom.plans.retrieval import _BM25, _KNN, _TOP
from codexloom.sources import shared
from codexloom.sources.harvest import harvested
from codexloom.streaming import sink, state


@query(f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {_KNN}) WHERE rank <= 10")
def knn_index_topk(spark, d):
    """The ten nearest vectors to every fiftieth one, from inverted lists, exactly."""
    vectors = table(spark, d, "embeddings")
    index = vector_index.build(spark, vectors)
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.search_exact(index, asked, 10)


@query("SELECT count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings")
def knn_index_rows(spark, d):
    """Every row is in one list of the index, and its blocks are as long as their lists."""
    index = vector_index.build(spark, table(spark, d, "embeddings"))
    return index.table.join(index.lists, "list").where("block < blocks").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


_BM25_ALL = _BM25.replace(" WHERE item_id % 50 = 0", "")  # every question, where the queries without an index ask every fiftieth


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM {_BM25_ALL})) WHERE rank <= 5")
def bm25_index_topk(spark, d):
    """The five best documents of each question from stored postings."""
    index = text_index.build(spark, table(spark, d, "documents"), {"text": 1.0})
    return text_index.search(index, _questions(spark, d), 5)


_FIELDS = """(WITH f AS (SELECT doc_id, 0 AS field, 2.0::DOUBLE AS weight, regexp_extract_all(lower(substr(text, 1, 60)), '[a-z0-9]+') AS ws FROM documents
  UNION ALL SELECT doc_id, 1, 1.5::DOUBLE, regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]+') FROM documents
  UNION ALL SELECT doc_id, 2, 1.0::DOUBLE, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents),
 s AS (SELECT field, avg(len(ws)) AS mean FROM f GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text || ' en'), '[a-z0-9]+')) AS term FROM benchmark),
 tf AS (SELECT doc_id, field, weight, size, term, count(*) AS tf FROM (SELECT doc_id, field, weight, len(ws) AS size, unnest(ws) AS term FROM f) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 i AS (SELECT doc_id, term, sum(weight * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS impact FROM tf JOIN s USING (field) GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM i GROUP BY 1)
 SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * impact), 6) AS score FROM i JOIN df USING (term) JOIN q USING (term), n GROUP BY 1, 2)"""


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT *, {_TOP} AS rank FROM {_FIELDS}) WHERE rank <= 10")
def bm25_index_fields(spark, d):
    """Title, source and text with weights, the ten best documents of each question."""
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.concat_ws(" ", "source", "lang").alias("origin"), "text")
    index = text_index.build(spark, docs, {"title": 2.0, "origin": 1.5, "text": 1.0})
    return text_index.search(index, _questions(spark, d).withColumn("text", F.concat("text", F.lit(" en"))), 10)


_LAST = "last_value({0} IGNORE NULLS) OVER (PARTITION BY {1} ORDER BY {2} ROWS UNBOUNDED PRECEDING)"


def _levels_sql(key: str, order: str, where: str, top: str, middle: str, low: str, most: str) -> str:
    at = {n: _LAST.format(f"CASE WHEN {c} IS NOT NULL THEN {order} END", key, order) for n, c in (("ta", top), ("ma", middle), ("la", low))}
    value = {n: _LAST.format(c, key, order) for n, c in (("t", top), ("m", middle), ("l", low))}
    columns = ", ".join(f"{x} AS {n}" for n, x in (at | value).items())
    return f"""SELECT k, o, t AS document, CASE WHEN ta IS NULL OR ma >= ta THEN m END AS article, CASE WHEN (ta IS NULL OR la >= ta) AND (ma IS NULL OR la >= ma) THEN l END AS clause, best
 FROM (SELECT {key} AS k, {order} AS o, {columns}, max({most}) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS best FROM {where})"""


@query(_levels_sql("user_id", "event_id", "events", "CASE WHEN event_type = 'signup' THEN event_id END", "CASE WHEN event_type = 'purchase' THEN event_id END", "CASE WHEN event_type = 'view' OR event_id % 7 = 0 THEN event_id END", "value"))
def levels_by_user(spark, d):
    """Values in force by three levels, a higher one ending the lower ones, and the largest value so far, for each user."""
    e = table(spark, d, "events")
    when = lambda test: F.when(test, F.col("event_id"))
    rows = e.select(F.col("user_id").alias("k"), F.col("event_id").alias("o"), when(F.col("event_type") == "signup").alias("a"), when(F.col("event_type") == "purchase").alias("b"), when((F.col("event_type") == "view") | (F.col("event_id") % 7 == 0)).alias("c"), "value")
    return carried.carried(rows, ["k"], ["o"], {"document": "a", "article": "b", "clause": "c"}, {"best": "value"}).drop("a", "b", "c", "value")


@query(_levels_sql("o_orderstatus", "o_orderkey", "orders", "CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey END", "CASE WHEN o_custkey % 5 = 0 THEN o_custkey END", "CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END", "o_totalprice"))
def levels_by_status(spark, d):
    """The same over all orders under three keys: each key's rows lie in many ranges."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderstatus").alias("k"), F.col("o_orderkey").alias("o"), F.when(F.col("o_orderkey") % 97 == 0, F.col("o_orderkey")).alias("a"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_custkey")).alias("b"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("c"), F.col("o_totalprice").alias("p"))
    return carried.carried(rows, ["k"], ["o"], {"document": "a", "article": "b", "clause": "c"}, {"best": "p"}).drop("a", "b", "c", "p")


_VALID = """(SELECT o_custkey AS src, o_orderkey + 1000000000 AS dst, o_orderpriority AS rel, CAST(o_orderdate AS DATE) AS f, CASE o_orderstatus WHEN 'F' THEN CAST(o_orderdate AS DATE) + 90 WHEN 'P' THEN CAST(o_orderdate AS DATE) + 800 END AS u FROM orders)"""


@query(f"""WITH e AS {_VALID}, n AS (SELECT DISTINCT id, moment FROM (SELECT src AS id FROM e UNION SELECT dst FROM e WHERE dst % 5 = 0), (SELECT unnest([DATE '1994-06-17', DATE '1998-02-01']) AS moment)),
 b AS (SELECT src AS id, dst AS other, 'out' AS direction, rel, f, u FROM e UNION ALL SELECT dst, src, 'in', rel, f, u FROM e),
 r AS (SELECT n.id, n.moment, direction, other, rel, f, CAST(row_number() OVER (PARTITION BY n.id, n.moment, direction ORDER BY f, other, rel) AS INTEGER) AS rank FROM n JOIN b ON b.id = n.id AND f <= moment AND (u IS NULL OR moment < u))
 SELECT n.id, n.moment AS "at", direction, other, rel AS rel_type, f AS valid_from, rank FROM n LEFT JOIN r ON r.id = n.id AND r.moment = n.moment""")
def graph_adjacent_as_of(spark, d):
    """Orders in force of each customer, and customers of orders, at two moments, by date; those without any stay."""
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    until = F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).when(F.col("o_orderstatus") == "P", F.date_add(day, 800))
    edges = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000).alias("dst"), F.col("o_orderpriority").alias("rel_type"), day.alias("valid_from"), until.alias("valid_to"))
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.where("dst % 5 = 0").select(F.col("dst").alias("id"))).distinct()
    moments = F.explode(F.array(*(F.lit(x).cast("date") for x in ("1994-06-17", "1998-02-01"))))
    return graph.adjacent_as_of(ids.select("id", moments.alias("at")), edges)


_NESTED = """'{"user": {"doc_id": ' || event_id || ', "items": [{"doc_id": "' || user_id || '"}, {"x": {"doc_id": ' || (event_id % 2 = 0) || '}}, 7]}, "note": "\\"doc_id\\": 5, {}", "doc_id": null, "props": ' || props || '}'"""


@query(f"SELECT event_id, json_extract_string(value, '$') AS value FROM (SELECT event_id, t.key AS key, t.value AS value, t.type AS type FROM (SELECT event_id, CAST({_NESTED} AS JSON) AS j FROM events) e, json_tree(e.j) t) WHERE key = 'doc_id' AND type NOT IN ('OBJECT', 'ARRAY', 'NULL')")
def json_harvest(spark, d):
    """Every id at any depth of nested documents, but none inside strings."""
    e = table(spark, d, "events")
    text = F.concat(F.lit('{"user": {"doc_id": '), "event_id", F.lit(', "items": [{"doc_id": "'), "user_id", F.lit('"}, {"x": {"doc_id": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit('}}, 7]}, "note": "\\"doc_id\\": 5, {}", "doc_id": null, "props": '), "props", F.lit("}"))
    return harvested(e, ["event_id"], text, "doc_id")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_rows_once(spark, d):
    """A stream of events into the sink, and the whole stream again without its checkpoint: each row is there once."""
    path, columns = f"{d}/events.parquet", ["event_id", "user_id", "event_type"]
    folder = shared.folder(spark, "once")
    keep = sink.once(folder, "user_id", "event_id")
    for _ in range(2):
        stream = sink.bounded(spark, path, columns)
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", shared.folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return sink.rows(spark, folder, stream.schema)


@query(f"SELECT page_id, md5({_CLEAN}) AS digest, length({_text_sql(_CLEAN)}) AS n_text FROM pages")
def html_clean_stream(spark, d):
    """Pages cleaned as a stream of bounded batches with two columns read."""
    folder = shared.folder(spark, "pages")
    stream = sink.bounded(spark, f"{d}/pages.parquet", ["page_id", "html"])
    c = html.clean(F.col("html"))
    cleaned = stream.select("page_id", F.md5(c).alias("digest"), F.char_length(html.text_of(c)).cast("long").alias("n_text"))
    sink.run(cleaned, folder)
    return sink.rows(spark, folder, cleaned.schema)


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r AS (SELECT user_id, event_id, i, m AS start, 1 AS n FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.i, CASE WHEN o.m >= r.start + 3600000000 THEN o.m ELSE r.start END, CASE WHEN o.m >= r.start + 3600000000 THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
 SELECT user_id, event_id, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n FROM r""")
def stream_windows(spark, d):
    """Each event's window from the first hit, as keyed state of a stream."""
    folder = shared.folder(spark, "windows")
    stream = state.windows(sink.bounded(spark, f"{d}/events.parquet", ["event_id", "ts", "user_id"]))
    sink.run(stream, folder)
    return sink.rows(spark, folder, stream.schema).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "start", "n")


@query("SELECT user_id, CAST(dialogue AS BIGINT) AS dialogue, least(count(*), 50) AS held FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dialogue FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS gap FROM events)) GROUP BY 1, 2")
def stream_dialogues(spark, d):
    """Dialogues of users with the turns in memory at their end, as keyed state of a stream."""
    folder = shared.folder(spark, "dialogues")
    stream = state.dialogues(sink.bounded(spark, f"{d}/events.parquet", ["event_id", "ts", "user_id"]))
    sink.run(stream, folder)
    return sink.rows(spark, folder, stream.schema).groupBy(F.col("key").alias("user_id"), "dialogue").agg(F.max("held").alias("held"))
