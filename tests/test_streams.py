"""Sinks that hold rows once, bounded batches, nested keys, adjacency in time."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from codexloom.operators import graph
from codexloom.sources import shared
from codexloom.sources.harvest import harvested
from codexloom.streaming import sink


def source(spark, tmp_path, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "uid string, place long, other string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def test_a_stream_that_stops_between_write_and_commit(spark, tmp_path):
    files = [[(f"u{k}", 10 * i + j, "x" * 50) for k in range(3) for j in range(10)] for i in range(5)]
    path, folder = source(spark, tmp_path, files), shared.folder(spark, "t")
    keep = sink.once(folder, "uid", "place")
    failed = []

    def stops(batch, number):
        keep(batch, number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost before the commit")

    with pytest.raises(Exception, match="lost before the commit"):
        sink.run(sink.bounded(spark, path, ["uid", "place"]), folder, stops)
    read = sink.run(sink.bounded(spark, path, ["uid", "place"]), folder, stops)
    assert failed == [2] and len([n for n in read if n]) == 3 and max(read) <= 30  # a file a batch, the third again
    schema = spark.read.parquet(path).select("uid", "place").schema
    want = sorted(r[:2] for rows in files for r in rows)
    assert sorted(tuple(r) for r in sink.rows(spark, folder, schema).collect()) == want
    # delivered again in later batches: marks keep them out, new rows come in
    spark.createDataFrame([("u1", 3, "x"), ("u1", 99, "x"), ("u9", 1, "x"), ("u9", 1, "x")], "uid string, place long, other string").coalesce(1).write.mode("append").parquet(path)
    sink.run(sink.bounded(spark, path, ["uid", "place"]), folder, keep)
    assert sorted(tuple(r) for r in sink.rows(spark, folder, schema).collect()) == sorted([*want, ("u1", 99), ("u9", 1)])


def test_nested_keys(spark):
    rows = [
        (1, '{"a": [{"id": 7}, {"b": {"id": "x9", "c": [[{"id": true}], {"id": {"id": 1.5}}]}}], "id": null}', ["7", "x9", "true", "1.5"]),
        (2, '{"t": "\\"id\\": 5, {[", "id": "a,b}]"}', ["a,b}]"]),
        (3, "no json", []),
        (4, None, []),
        (5, "[]", []),
        (6, '"id"', []),
        (7, '[{"id": 1}, {"id": 1}]', ["1", "1"]),
        (8, "[" * 30 + '{"id": "deep"}' + "]" * 30, ["deep"]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "k int, j string")
    got = sorted((r.k, r.value) for r in harvested(df, ["k"], F.col("j"), "id").collect())
    assert got == sorted((k, v) for k, _, vs in rows for v in vs)
    assert harvested(df.limit(0), ["k"], F.col("j"), "id").count() == 0


def test_adjacency_against_brute_force(spark):
    rng = random.Random(6)
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(days=n)
    edges = []
    for _ in range(200):
        a = rng.randrange(3000)
        edges.append((rng.randrange(12), rng.randrange(12), rng.choice("xy"), day(a), rng.choice([None, day(a + rng.randrange(1500)), day(a)])))
    nodes = [(i, day(m)) for i in range(14) for m in (0, 700, 2500)]
    got = graph.adjacent_as_of(spark.createDataFrame(nodes, "id int, at date"), spark.createDataFrame(edges, "src int, dst int, rel_type string, valid_from date, valid_to date"))
    want = []
    for i, at in nodes:
        hits = [(d, o, r, f) for s, t, r, f, u in edges if f <= at and (u is None or at < u) for d, own, o in (("out", s, t), ("in", t, s)) if own == i]
        for d in ("out", "in"):
            own = sorted((x for x in hits if x[0] == d), key=lambda x: (x[3], x[1], x[2]))
            want += [(i, at, d, o, r, f, n + 1) for n, (_, o, r, f) in enumerate(own)]
        if not hits:
            want.append((i, at, None, None, None, None, None))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_state_over_batches_is_that_of_one(spark, tmp_path):
    """The same rows in one file and in five: state between batches carries windows, dialogues and codes on."""
    from codexloom.operators import stores
    from codexloom.streaming import state

    rng = random.Random(4)
    start, minute = datetime.datetime(2024, 1, 1), 0
    rows = []
    for i in range(240):
        minute += rng.choice([0, 0, 1, 1, 2, 2, 3, 3, 40, 70])
        rows.append((i, start + datetime.timedelta(minutes=minute, seconds=i % 50 if minute else i), rng.randrange(3)))
    rows.sort(key=lambda r: (r[1], r[0]))
    schema = "event_id long, ts timestamp, user_id long"
    for name, n in (("one", 240), ("five", 48)):
        for i in range(0, 240, n):
            spark.createDataFrame(rows[i : i + n], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    found = {}
    for name in ("one", "five"):
        events = sink.bounded(spark, f"{tmp_path}/{name}", ["event_id", "ts", "user_id"])
        is_code = F.col("event_id") % 5 == 0
        typed = F.when(is_code | (F.col("event_id") % 2 == 0), "1").otherwise("2")
        tries = events.select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), is_code.alias("is_code"), stores.code_hash(typed, F.lit("s")).alias("hash"))
        for kind, stream in (("windows", state.windows(events)), ("dialogues", state.dialogues(events, most=5)), ("codes", state.codes(tries))):
            folder = shared.folder(spark, "state")
            sink.run(stream, folder)
            found[name, kind] = sorted(tuple(r) for r in sink.rows(spark, folder, stream.schema).collect())
    for kind in ("windows", "dialogues", "codes"):
        assert found["one", kind] == found["five", kind] and found["one", kind]
    assert max(r[4] for r in found["five", "dialogues"]) == 5
    batch = spark.createDataFrame(rows, schema)
    made = batch.where("event_id % 5 = 0").select("user_id", F.col("ts").alias("created_at"), stores.code_hash(F.lit("1"), F.lit("s")).alias("code_hash"))
    tried = batch.where("event_id % 5 <> 0").select("user_id", F.col("ts").alias("at"), stores.code_hash(F.when(F.col("event_id") % 2 == 0, "1").otherwise("2"), F.lit("s")).alias("hash"))
    want = sorted((r.user_id, r.m, r.outcome) for r in stores.code_checks(tried, made).select("user_id", F.unix_micros("at").alias("m"), "outcome").collect())
    assert {x[3] for x in found["five", "codes"]} >= {"ok", "wrong", "used", "expired"}
    assert sorted((k, at, o) for k, _, at, o in found["five", "codes"]) == want
