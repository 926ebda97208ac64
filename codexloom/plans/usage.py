"""Usage counters, sessions, conversations, batches, statistics, and their streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.operators import sessions
from codexloom.plans.registry import query, table
from codexloom.streaming import usage as streams


@query("SELECT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, count(*) > 10 AS over FROM events GROUP BY 1, 2, 3")
def usage_daily(spark, d):
    return sessions.usage(table(spark, d, "events"), "day", sessions.FREE["qa_per_day"]).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, date_trunc('month', ts)::TIMESTAMP AS period, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) > 5")
def usage_monthly_over_limit(spark, d):
    found = sessions.usage(table(spark, d, "events"), "month", sessions.FREE["contracts_per_month"]).where("over").drop("over")
    return found.withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS period, count(*) AS n, count(*) > 3 AS over FROM events GROUP BY 1, 2")
def rate_limit_hourly(spark, d):
    hours = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n"))
    return hours.withColumn("over", F.col("n") > 3)


@query("SELECT user_id, session, min(ts) AS \"start\", max(ts) AS \"end\", count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS gap FROM events)) GROUP BY 1, 2")
def session_ttl(spark, d):
    return sessions.sessions(table(spark, d, "events"), 60)


@query("SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn, coalesce(max(turn), -1) + 1 AS next_seq, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def conv_summary(spark, d):
    return sessions.conversation_summary(table(spark, d, "conversations"))


@query("SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1")
def conv_last_message(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5")
def conv_history_5(spark, d):
    return sessions.history(table(spark, d, "conversations"), 5).select("conv_id", "turn", "role")


@query("SELECT event_id, user_id, max(greatest(0.0::DOUBLE, least(100.0::DOUBLE, value))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def progress_monotone(spark, d):
    return sessions.monotone(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "user_id", "progress")


@query("SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def latest_state(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), r AS (SELECT source, doc_id, i, 0 AS batch, n_chars AS held FROM o WHERE i = 1
 UNION ALL SELECT o.source, o.doc_id, o.i, CASE WHEN r.held + o.n_chars > 20000 AND r.held > 0 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.held + o.n_chars > 20000 AND r.held > 0 THEN o.n_chars ELSE r.held + o.n_chars END FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
 SELECT source, doc_id, batch FROM r""")
def chunks_greedy(spark, d):
    return sessions.greedy_batches(table(spark, d, "documents"), "source", "doc_id", "n_chars", 20_000)


@query("SELECT conv_id, coalesce(max(turn), -1) + 1 AS next_seq FROM conversations GROUP BY 1")
def conv_next_seq(spark, d):
    return sessions.conversation_summary(table(spark, d, "conversations")).select("conv_id", "next_seq")


@query("SELECT item_id, greatest(ceil(length(text) / 5.0), 0)::BIGINT AS n_chunks, left(text, 5) AS first_chunk FROM benchmark")
def token_chunks(spark, d):
    pieces = sessions.chunks(F.col("text"), 5)
    return table(spark, d, "benchmark").select("item_id", F.size(pieces).cast("long").alias("n_chunks"), F.element_at(pieces, 1).alias("first_chunk"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def phase_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT count(*) AS n, count(*) FILTER (value >= 50) AS high, round(avg(value), 6) AS mean, round(count(*) FILTER (value >= 50)::DOUBLE / count(*), 6) AS share FROM events")
def score_stats(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.try_divide(F.count_if(F.col("value") >= 50), F.count("*")), 6).alias("share"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def source_buckets(spark, d):
    counts = table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1)))
    return counts.select("source", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("en", "de", "fr", "es")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k % 2 = 0")


@query("SELECT user_id, event_type, date_trunc('hour', ts)::TIMESTAMP AS period, count(*) AS n FROM events GROUP BY 1, 2, 3")
def stream_usage(spark, d):
    events = streams.event_stream(spark, f"{d}/events.parquet")
    counts = streams.drained(streams.hourly_usage(events))
    return counts.select("user_id", "event_type", F.col("w.start").cast("timestamp_ntz").alias("period"), "n")


@query("SELECT user_id, min(ts) AS \"start\", max(ts) + INTERVAL 60 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS gap FROM events)) GROUP BY user_id, session")
def stream_sessions(spark, d):
    events = streams.event_stream(spark, f"{d}/events.parquet")
    return streams.drained(streams.session_counts(events)).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY 1")
def stream_conv_agg(spark, d):
    messages = streams.event_stream(spark, f"{d}/conversations.parquet")
    return streams.drained(streams.conversation_counts(messages))
