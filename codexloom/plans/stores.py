"""Reads and writes of application stores, sources and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.operators import review, stores
from codexloom.plans.registry import query, table


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey = 7")
def store_live_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return stores.live(rows, 7).select("o_orderkey")


@query("SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE ts >= now - INTERVAL 60 MINUTE")
def store_last_hour(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    return stores.since(events.join(F.broadcast(now)), "ts", F.col("now")).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = 11)")
def store_owned_rows(spark, d):
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    return stores.owned(table(spark, d, "lineitem"), parents, "l_orderkey", 11).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def store_recent_5(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("at"))
    return stores.recent_first(rows, ["o_custkey"], "at", "o_orderkey", 5).drop("at")


@query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000)")
def store_least_recent_out(spark, d):
    return stores.least_recent_out(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS chunk FROM orders")
def store_fixed_chunks(spark, d):
    return stores.fixed_chunks(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3)


@query("SELECT c_custkey AS user_id, c_mktsegment AS tab, false AS is_new FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT o_custkey, 'new', true FROM orders UNION ALL SELECT c_custkey, c_mktsegment, true FROM customer WHERE c_acctbal <= 0")
def store_get_or_create(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tab"), "c_acctbal")
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("new").alias("tab")).unionByName(c.select("user_id", "tab"))
    return stores.get_or_create(c.where("c_acctbal > 0").select("user_id", "tab"), wanted, ["user_id", "tab"])


@query("SELECT c_custkey AS conv_id, CASE WHEN c_acctbal > 0 AND n IS NOT NULL THEN 'new ' || n ELSE c_name END AS title FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def store_retitle(spark, d):
    conversations = table(spark, d, "customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("title"), (F.col("c_acctbal") <= 0).alias("is_manual"))
    titles = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("conv_id")).agg(F.concat(F.lit("new "), F.count("*")).alias("new_title"))
    return stores.retitled(conversations, titles).select("conv_id", "title")


@query("SELECT run_id, name, supplier FROM (SELECT l_orderkey * 100 + l_linenumber AS run_id, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 100 + l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 25) JOIN (SELECT p_partkey, p_name AS name FROM part WHERE p_size > 20) ON p_partkey = l_partkey JOIN (SELECT s_suppkey, s_name AS supplier FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def store_complete_runs(spark, d):
    """The latest 25 runs of each supplier that still have part and supplier."""
    runs = table(spark, d, "lineitem").select(F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), "l_partkey").alias("run_id"), F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("version_id"), F.col("l_shipdate").alias("created_at"))
    docs = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"))
    versions = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("version_id"), F.col("s_name").alias("supplier"))
    return stores.complete(runs, docs, versions).select(F.col("run_id.id").alias("run_id"), "name", "supplier")


@query("SELECT c_custkey, n_name, r_name, n FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def store_verify_joins(spark, d):
    nation = table(spark, d, "nation").where("n_nationkey < 20")
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.join(counts, "c_custkey", "left").select("c_custkey", "n_name", "r_name", "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, event_type, i, event_id, ts AS start, 1 AS n FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_type, e.i, e.event_id, CASE WHEN e.ts >= r.start + INTERVAL 60 MINUTE THEN e.ts ELSE r.start END, CASE WHEN e.ts >= r.start + INTERVAL 60 MINUTE THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.i = r.i + 1)
 SELECT user_id, event_type, start, max(n) AS n, max(n) > 5 AS over FROM r GROUP BY 1, 2, 3""")
def rate_limit_windows(spark, d):
    """Windows of an hour that open at a user's first event of a type after the one before."""
    found = stores.rate_windows(table(spark, d, "events"), ["user_id", "event_type"]).groupBy("user_id", "event_type", F.col("window_start").cast("timestamp_ntz").alias("start")).agg(F.max("n").cast("long").alias("n"))
    return found.withColumn("over", F.col("n") > 5)


@query("SELECT user_id, dialogue, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, dialogue ORDER BY ts DESC, event_id DESC) AS back FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dialogue FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS gap FROM events))) WHERE back <= 50 GROUP BY 1, 2")
def session_last_50(spark, d):
    turns = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), "ts", F.col("event_id").alias("turn"))
    return stores.dialogues(turns).groupBy(F.col("conv_id").alias("user_id"), "dialogue").agg(F.count("*").alias("n"))


@query("SELECT user_id AS conv_id, max(event_id) AS turn_number, coalesce(string_agg(DISTINCT CASE WHEN event_type = 'purchase' THEN 'k' || (event_id % 3) END, ',' ORDER BY CASE WHEN event_type = 'purchase' THEN 'k' || (event_id % 3) END), '') AS contracts FROM events GROUP BY 1")
def conversation_registry(spark, d):
    turns = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("k"), F.col("event_id") % 3)).alias("contract"))
    return stores.registry(turns).select("conv_id", "turn_number", F.array_join(F.array_sort("contracts"), ",").alias("contracts"))


@query()
def one_time_codes(spark, d):
    """Events as tries of codes: each signup makes one, every other event tries it; tests fold them in plain Python."""
    e = table(spark, d, "events")
    codes = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("created_at"), stores.code_hash(F.lit("1"), F.lit("s")).alias("code_hash"))
    tries = e.where("event_type <> 'signup'").select("user_id", F.col("ts").alias("at"), stores.code_hash(F.when(F.col("event_id") % 3 == 0, "1").otherwise(F.concat(F.lit("x"), "event_id")), F.lit("s")).alias("hash"))
    return stores.code_checks(tries, codes).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN w THEN 'wage_payment' ELSE 'general' END AS risk_type, CASE WHEN w AND o_custkey % 2 = 0 THEN 11 WHEN w THEN 8 ELSE 2 END AS n_queries, CASE WHEN w AND o_custkey % 2 = 0 THEN 13 WHEN w THEN 10 ELSE 0 END AS n_keywords FROM (SELECT *, o_orderkey % 2 = 0 AS w FROM orders)")
def clause_plan(spark, d):
    """Plans of clauses about wages and about other things; one in two wage clauses repeats a query of the plan in capitals."""
    wage = F.col("o_orderkey") % 2 == 0
    text = F.when(wage & (F.col("o_custkey") % 2 == 0), F.upper(F.lit(review.WAGE_QUERIES[3]))).when(wage, F.concat(F.lit("dòng tiền "), "o_orderkey")).otherwise(F.concat(F.lit("Giao hàng "), "o_orderkey"))
    p = review.plan(text, F.lit("khác"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), p.alias("p")).select("id", "p.risk_type", F.size("p.search_queries").alias("n_queries"), F.size("p.keywords").alias("n_keywords"))


@query("SELECT o_orderkey AS id, 'Rà soát tuân thủ pháp luật lao động cho điều khoản hợp đồng.' || chr(10) || 'Loại điều khoản: ' || o_orderstatus || chr(10) || 'Nội dung điều khoản: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Nghĩa vụ: a; b' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'Số tiền: ' || o_custkey ELSE '' END AS text FROM orders")
def clause_query(spark, d):
    o = F.col("o_orderkey")
    duties = F.when(o % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    text = review.clause_query(F.col("o_orderstatus"), F.col("o_orderpriority"), duties, F.when(o % 3 == 0, F.col("o_custkey").cast("string")), F.lit(""))
    return table(spark, d, "orders").select(o.alias("id"), text.alias("text"))
