"""Sources, sinks, text functions and streaming twins on small inputs; the entry module without its optional part."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from codexloom.functions import identifiers as ids
from codexloom.functions import text as tx
from codexloom.operators import effective, graph, qa, review, search, sessions
from codexloom.sources import tables
from codexloom.streaming import usage as streams

ROOT = Path(__file__).resolve().parents[1]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, tx.collapse(F.lit(" a \n b "))) == "a b"
    assert one(spark, tx.strip_tags(F.lit("<p>x<b>y</b></p>"))) == "xy"
    assert one(spark, tx.search_query(F.lit('a+b (c) "d"'))) == "a b c d"
    assert one(spark, tx.tidy_lines(F.lit("a  \r\n\n\n\nb\t\n"))) == "a\n\nb"
    assert one(spark, tx.token_estimate(F.lit(""))) == 0
    assert one(spark, tx.fallback_title(F.lit("  "))) == "Cuộc trò chuyện mới"
    assert one(spark, tx.instructed(tx.instructed(F.lit("q"), "do"), "do")) == "Instruct: do\nQuery: q"
    assert one(spark, tx.squash(F.lit(0.0))) == 0.0 and 0.99 < one(spark, tx.squash(F.lit(50.0))) <= 1.0
    assert one(spark, tx.fuzzy_confidence(F.lit(2))) == 0.7
    assert one(spark, tx.fill_template(F.lit("a {{x}} b"), {"x": F.lit("1")})) == "a 1 b"
    assert tuple(one(spark, tx.numbered_structure(F.lit("1. a\n2. b\na) c\nđ) d")))) == (2, 2)


def test_identifiers(spark):
    assert one(spark, ids.normal_key(F.lit("45/2019/QH14"), F.lit(None).cast("string"))) == "LT-045-2019"
    assert one(spark, ids.hinted_key(F.lit("135/2020/NĐ-CP"), F.lit(None).cast("string"))) == "ND-135-2020"
    assert one(spark, ids.build_uid(F.lit(42), F.lit("5"), F.lit("2"), F.lit("a"))) == "doc_42_dieu_5_khoan_2_diem_a"
    assert one(spark, ids.clean_optional(F.lit("None"))) is None
    assert one(spark, ids.citation(F.lit("17"), F.lit("2"), F.lit(None).cast("string"), F.lit("Luật X"), F.lit("?"))) == "Điều 17 khoản 2 Luật X"


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "x": "a"}\n\nbroken\n{"id": "2", "x": "b"}\n')
    assert {r.id for r in tables.json_lines(spark, f"{tmp_path}/a.jsonl", "id string, x string").where("id is not null").collect()} == {"1", "2"}
    (tmp_path / "m.json").write_text(json.dumps({"k1": "v1", "k2": "v2"}))
    assert {tuple(r) for r in tables.json_map(spark, f"{tmp_path}/m.json").collect()} == {("k1", "v1"), ("k2", "v2")}
    assert one(spark, tables.harvest(F.lit('{"a": [{"doc_id": 7}, {"b": {"doc_id": "x9"}}]}'), "doc_id")) == ["7", "x9"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/u.txt").write_bytes("điều".encode())
    (tmp_path / "t/l.txt").write_bytes("é\x81".encode("latin-1"))
    assert {r.text for r in tables.text_files(spark, f"{tmp_path}/t").collect()} >= {"điều"}
    df = spark.range(5).withColumn("raw_html", F.lit("x"))
    assert tables.pick_column(df, ["html", "raw_html"], "body").columns == ["id", "body"]
    tables.write_parquet(df, f"{tmp_path}/p")
    assert tables.parquet(spark, f"{tmp_path}/p", ["id"]).count() == 5
    tables.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 5


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "A"), (2, 3, "A"), (3, 1, "B"), (4, 9, "A")], "src long, dst long, rel_type string")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    assert graph.valid_edges(edges, nodes).count() == 3
    assert {tuple(r) for r in graph.orphan_ends(edges, nodes).collect()} == {(9, 1)}
    got = {(r.id, r.depth) for r in graph.reach(nodes.where("id = 1"), edges, 5).collect()}
    assert got == {(1, 0), (2, 1), (3, 2)}


def test_search_by_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 2").selectExpr("vec_id as query_id", "embedding as query")
    got = {(r.query_id, r.vec_id) for r in search.cosine_top_k(v, q, 3).collect()}
    assert got == {(0, 0), (0, 3), (0, 6), (1, 1), (1, 4), (1, 7)}


def test_effective_without_amendments(spark):
    articles = spark.createDataFrame([("u", "1. a\n2. b")], "uid string, text string")
    none = spark.createDataFrame([], "target_uid string, source_uid string, ngay date, action string, khoan int, new_text string")
    assert effective.compose(articles, none).first().text == "1. a\n2. b"
    assert one(spark, effective.action(F.lit("sửa đổi"))) == "sua_doi" and one(spark, effective.status(F.lit("?"))) == "unknown"
    assert str(one(spark, effective.date_or_min(F.lit("x")))) == "0001-01-01" and str(one(spark, effective.date_or_min(F.lit("2023-06-15")))) == "2023-06-15"


def test_review(spark):
    assert one(spark, review.guardrail(F.lit("Hợp đồng lao động"))) == "supported"
    assert one(spark, qa.requirements(F.array(F.lit("lịch sử sửa đổi"), F.lit("x"), F.lit("citation_validation")), F.lit("TOPIC"), F.lit("hybrid_search"))) == ["effective_text", "citation_validation", "legal_provision"]
    assert one(spark, qa.strategy(F.lit("lookup"), F.lit("VALIDITY"), F.lit("Điều 5"))) == "validity_check"
    assert one(spark, sessions.chunks(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    got = {(r.user_id, r.event_type, r.w.start): r.n for r in streams.drained(streams.hourly_usage(stream)).collect()}
    want = {(r.user_id, r.event_type, r.p): r.n for r in events.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp").alias("p")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_drained_streams_are_whole(spark, tmp_path):
    from codexloom.plans import catalogue
    from tests.compare import duck

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")  # a folder, as written tables are
    for d in ("/root/testdata/sf0.001", str(tmp_path)):
        names, want = duck(d, catalogue.oracle_sql()["session_ttl"]) if d != str(tmp_path) else (names, want)
        last = {(r[names.index("user_id")], r[names.index("start")], r[names.index("n")]) for r in want}
        got = catalogue.queries()["stream_sessions"](spark, d)
        assert {(r.user_id, r.start.replace(tzinfo=None), r.n) for r in got.collect()} == last and got.count() == len(want)
        assert catalogue.queries()["stream_usage"](spark, d).agg(F.sum("n")).first()[0] == events.count()
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    whole = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    assert {tuple(r) for r in catalogue.queries()["stream_conv_agg"](spark, "/root/testdata/sf0.001").collect()} == {tuple(r) for r in whole.collect()}
    empty = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events.parquet").where("false")
    assert streams.drained(streams.session_counts(empty)).count() == 0


def test_references_by_nearest_keyword(spark):
    from codexloom.operators import refs

    rows = [
        ("doc_1_dieu_1", "Người nộp thuế khai bổ sung hồ sơ Điều 5", True, "internal", None),
        ("doc_1_dieu_2", "Sửa đổi Chương II, bãi bỏ Điều 3", True, "modification", "bai_bo"),
        ("doc_1_dieu_3", "Trường hợp này không áp dụng Điều 8", False, "exception", None),
        ("doc_1_dieu_4", "nội dung đã bổ sung tại Điều 4", True, "internal", None),
        ("doc_1_dieu_5", "Làm theo mẫu. Thay thế Điều 6", True, "modification", "thay_the"),
        ("doc_1_dieu_6", "trừ việc nhỏ; xem Điều 9", False, "exception", None),
        ("doc_1_dieu_7", "Trừ trường hợp khác, hết hiệu lực Điều 2", True, "modification", "het_hieu_luc"),
    ]
    rows += [(f"doc_2_dieu_{i}", f"nội dung {m}sửa đổi Điều 90", True, "internal", None) for i, m in enumerate(["được ", "đã ", "nêu tại ", "theo ", "tại ", "quy định ", "thông tư ", "luật ", "nghị định "])]
    got = refs.extract(spark.createDataFrame([r[:3] for r in rows], "uid string, text string, is_modifying boolean")).collect()
    assert {(r.uid, r.kind, r.action) for r in got} == {(u, k, a) for u, _, _, k, a in rows}


def test_entry_without_training_operators(tmp_path):
    for name in ("codexloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    shutil.rmtree(tmp_path / "codexloom/llm", ignore_errors=True)  # it may be gone already
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
