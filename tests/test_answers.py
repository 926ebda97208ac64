"""Operators against plain Python: spans, personal data, amendments, segments, codes, windows, texts compared."""

import datetime
import difflib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from codexloom.functions import compare, spans
from codexloom.functions import identifiers as ids
from codexloom.operators import citations, context, effective, html, hybrid, lookup, pii, qa, refs, segment, stores
from codexloom.plans import knowledge, references
from codexloom.sources.tables import spread


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_places_are_those_of_the_matches(spark):
    rng = random.Random(1)
    pattern = r"(?<![0-9])[0-9]{3,5}(?![0-9])"
    texts = ["", "123", "1234567 123", "a123 1234567 1234 12345x"] + ["".join(rng.choice("123 é中😀x") for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", spans.places(F.col("t"), pattern, "n").alias("s")).collect()
    for r in rows:
        assert [(x.start, x.end, x.value) for x in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, texts[r.id])]
        assert all(texts[r.id][x.start : x.end] == x.value for x in r.s)


def test_personal_data_never_leaks(spark):
    rows = [
        (0, "CCCD 1234567890123 va CCCD 123456789.", "CCCD 1234567890123 va CCCD [REDACTED_CCCD_1]."),
        (1, "Gọi 091234567890123 hoặc 0912345678.", "Gọi 091234567890123 hoặc [REDACTED_PHONE_1]."),
        (2, "a@b.vn, c@d.vn và a@b.vn", "[REDACTED_EMAIL_3], [REDACTED_EMAIL_2] và [REDACTED_EMAIL_1]"),
        (3, None, None),
        (4, "", ""),
    ]
    got = pii.redact(spark.createDataFrame([r[:2] for r in rows], "id int, text string")).select("id", "text", "redacted", pii.restore(F.col("redacted"), F.col("pii_map")).alias("back")).collect()
    for r in got:
        assert r.redacted == rows[r.id][2] and r.back == r.text


def test_no_break_blanks_hide_nothing(spark):
    """Blanks of any kind between words and numbers: texts cleaned from HTML are full of them."""
    rows = [
        (0, "STK\u00a0123456789012", "STK\u00a0[REDACTED_BANK_ACCOUNT_1]"),
        (1, "CCCD:\u00a0879087654321", "CCCD:\u00a0[REDACTED_CCCD_1]"),
        (2, "tại quận\u00a0Hoàn Kiếm, Hà Nội", "tại [REDACTED_ADDRESS_1], Hà Nội"),
        (3, "Mã\u2009số\u3000thuế:\u00a00312345678", "Mã\u2009số\u3000thuế:\u00a0[REDACTED_MST_1]"),
        (4, "+84\u00a091\u00a0234\u00a05678", "[REDACTED_PHONE_1]"),
        (5, "é.a@b.vn \uffff CCCD 123456789012 \uffff", "é[REDACTED_EMAIL_1] \uffff CCCD [REDACTED_CCCD_1] \uffff"),
        (6, "phố A\uffffB, hết", "[REDACTED_ADDRESS_1], hết"),
    ]
    got = pii.redact(spark.createDataFrame([r[:2] for r in rows], "id int, text string")).select("id", "text", "redacted", pii.restore(F.col("redacted"), F.col("pii_map")).alias("back")).collect()
    for r in got:
        assert r.redacted == rows[r.id][2] and r.back == r.text, r
    def found(text):
        return [(r.article, r.clause, r.point) for r in refs.extract(spark.createDataFrame([("doc_1_dieu_9", text, False)], "uid string, text string, is_modifying boolean")).collect()]
    assert found("theo Điều\u00a03") == [("3", None, None)]
    assert found("theo khoản 1\u00a0Điều 3") == [("3", "1", None)]


def test_personal_data_takes_one_pass_a_family(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = texts.select(pii.detect(F.col("text")).alias("s"))._jdf.queryExecution().executedPlan().toString()
    # one for each family, and the trimmed value of an address
    assert plan.count("regexp_replace(") == len(pii.FAMILIES) + 1 and plan.count("split(") == len(pii.FAMILIES) and "regexp_extract_all" not in plan


def test_references_look_back_from_their_own_place(spark):
    rows = [("doc_1_dieu_9", "trừ Điều 155ab. Nội dung rất dài để ra khỏi tầm nhìn lại của sáu mươi chữ cái trước đó theo Điều 155", False)]
    (r,) = refs.extract(spark.createDataFrame(rows, "uid string, text string, is_modifying boolean")).collect()
    assert r.kind == "internal" and r.article == "155" and rows[0][1][r.start :].startswith("Điều 155") and r.start > 60


def test_sentences_of_extractors(spark):
    def found(text, modifying):
        return [(r.kind, r.action, r.article, r.clause, r.point) for r in refs.extract_articles(spark.createDataFrame([("doc_1_dieu_1", text, modifying)], "uid string, text string, is_modifying boolean")).collect()]

    assert found("theo quy định tại Điều 5 của Luật này", False) == [("internal", None, "5", None, None)]
    assert found("tại khoản 2 Điều 10 của Luật này", False) == [("internal", None, "10", "2", None)]
    assert found("tại điểm a khoản 3 Điều 7", False) == [("internal", None, "7", "3", "a")]
    assert found("khoản 2 Điều 5 Nghị định số 46/2014/NĐ-CP", False) == [("external", None, "5", "2", None)]
    assert found("Sửa đổi khoản 2 Điều 10 Nghị định số 46/2014/NĐ-CP như sau: “Nội dung mới ở Điều 3”", True) == [("modification", "sua_doi", "10", "2", None)]
    assert found("Bãi bỏ điểm a khoản 1 Điều 3", True) == [("modification", "bai_bo", "3", "1", "a")]
    assert found("Sửa đổi khoản 2 Điều 10", False)[0][0] == "internal"
    kinds = refs.external(spark.createDataFrame([("u", "theo Thông tư liên tịch số 05/2016/TTLT-NHNN-BTC")], "uid string, text string")).collect()
    assert [(r.doc_type, r.so_ky_hieu) for r in kinds] == [("Thông tư liên tịch", "05/2016/TTLT-NHNN-BTC")]


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_articles_are_read_once_and_not_shuffled(spark):
    """Each unit's references are told in its own row: also those of units without a uid or with the same one."""
    text = "Sửa đổi khoản 1; khoản 2 và điểm b khoản 3 Điều 7 / Điều 8, theo Điều 8"
    units = spark.createDataFrame([(u, text, m) for u in (None, "u", "u") for m in (True, False, None)] + [("v", None, True), ("w", "", None)], "uid string, text string, is_modifying boolean")
    found = refs.extract_articles(units)
    assert _shuffles(found) == 0 and _shuffles(refs.extract(units)) == 0
    changes = [(0, "modification", "7", "1", None), (0, "modification", "7", "2", None), (0, "modification", "7", "3", "b")]
    free = [(0, "internal", "7", "3", "b"), (0, "internal", "8", None, None)]
    of = lambda u: sorted((tuple(r) for r in got if r[0] == u), key=str)
    got = [(r.uid, r.part, r.kind, r.article, r.clause, r.point) for r in found.collect()]
    for u, times in ((None, 1), ("u", 2)):
        assert [r for r in of(u) if r[3] != "8" and r[2] == "modification"] == sorted([(u, *c) for c in changes] * times, key=str)
        assert [r for r in of(u) if r[2] == "internal"] == sorted([(u, *c) for c in free] * (2 * times), key=str)
    assert {r[0] for r in got} == {None, "u"}


def test_changes_are_told_in_their_own_row(spark):
    """Carried articles, documents and the most specific references need no window over all sentences."""
    text = "5. Sửa đổi khoản 1 và khoản 2 Điều 7 Nghị định số 46/2014/NĐ-CP , khoản 2 Điều 7, điểm a khoản 2 Điều 7; khoản 9, Điều 8a vào sau Điều 8, khoản 4"
    pieces = spark.createDataFrame([(u, 0, text) for u in ("u", "u", None)] + [("v", 0, None)], "uid string, part int, fragment string")
    found = refs.modifications(pieces, ["uid", "part"])
    assert _shuffles(found) == 0 and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    one = [("7", "1", None), ("7", "2", "a"), ("7", "9", None), ("8", "4", None)]
    got = sorted(((r.uid, r.article, r.clause, r.point, r.doc_ref, r.action, r.source_clause) for r in found.collect()), key=str)
    assert got == sorted([(u, *r, "46/2014/NĐ-CP", "sua_doi", "5") for u in ("u", "u", None) for r in one], key=str)


def test_rows_are_dealt_without_sorting_them(spark):
    """Dealing in turn would sort each split's rows in one task; amending texts are made behind the shuffle, and columns without a hash don't hinder it."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for make in (references.refs_modification, references.refs_articles, knowledge.pii_detect, knowledge.pii_redact):
        shown = plan(make(spark, "/root/testdata/sf0.001"))
        assert "Exchange hashpartitioning" in shown and "RoundRobin" not in shown
    assert "Nghị định" not in plan(references.refs_modification(spark, "/root/testdata/sf0.001")).split("Exchange hashpartitioning")[1]
    rows = spark.range(1000, numPartitions=1).select("id", F.lit("same").alias("a `b`.c"), F.create_map(F.lit("k"), "id").alias("m"), F.array(F.create_map("id", "id")).alias("n"))
    for dealt in (spread(rows), spread(rows, "id"), spread(rows.select("m"))):
        assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert sorted(r.m["k"] for r in dealt.collect()) == list(range(1000))
    assert all(spread(rows, *keys).groupBy(F.spark_partition_id()).count().count() == spark.sparkContext.defaultParallelism for keys in ((), ("id",)))


def test_mojibake_is_scored_once_for_each_reading(spark):
    """One other reading at most is made and counted; a sign beyond Latin-1 at the very end keeps a text from being read anew."""
    frame = spark.createDataFrame([("Điều".encode().decode("latin-1"), "Điều"), ("é\u2028", "é\u2028"), ("plain", "plain"), ("", ""), (None, None), ("á»‡", "ệ"), ("á»\x87 €", "á»\x87 €")], "t string, want string")
    fixed = frame.select("t", "want", compare.repair_mojibake(F.col("t")).alias("got"))
    assert fixed._jdf.queryExecution().executedPlan().toString().count("translate(") <= 9
    assert all(r.got == r.want for r in fixed.collect())


def test_segments_of_a_code(spark):
    lines = ["CHỦ TỊCH", "Phần thứ nhất", "mở đầu", "CHƯƠNG I", "tên", "Mục 1. A", "sau mục", "Điều 1. X «mở", "1. khoản", "Điều 2. Y»", "ii) không", "1. Khoản", "ii) điểm nhỏ", "“Điều 9. trích", "vẫn trích”", "Chương II", "Điều 3: Z", "KT. BỘ TRƯỞNG", "Điều 4. W"]
    frame = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    got = {r.uid: r for r in segment.segments(frame.withColumn("kind", F.lit("Bộ luật"))).collect()}
    assert list(sorted(got)) == sorted(["doc_7_chương_1", "doc_7_chương_2", "doc_7_dieu_1", "doc_7_dieu_1_khoan_1", "doc_7_dieu_2", "doc_7_dieu_2_khoan_1", "doc_7_dieu_2_khoan_1_diem_ii", "doc_7_dieu_3"])
    assert got["doc_7_chương_1"].text == "CHƯƠNG I\ntên\nsau mục" and got["doc_7_dieu_1"].section == "Mục 1. A" and got["doc_7_dieu_3"].section is None
    assert got["doc_7_dieu_2_khoan_1_diem_ii"].text == "ii) điểm nhỏ\n“Điều 9. trích\nvẫn trích”" and got["doc_7_dieu_2_khoan_1_diem_ii"].path == "Chương I / Điều 2 / Khoản 1 / Điểm ii"
    assert got["doc_7_dieu_3"].parent_uid == "doc_7_chương_2" and got["doc_7_dieu_1_khoan_1"].parent_uid == "doc_7_dieu_1"
    assert segment.segments(frame.limit(0)).count() == 0


def test_amendments_of_points_and_odd_numbers(spark):
    articles = spark.createDataFrame([("u", "A\n1. a\n1. b\n99999999999. z\n2. c\na) x\nb) y")], "uid string, text string")
    steps = [("u", "s1", "2020-01-01", "sửa đổi", 1, None, "mới"), ("u", "s2", "2020-01-02", "bãi bỏ", 2, "a", None), ("u", "s3", "2020-01-03", "bổ sung", 2, "c", "c) thêm"), ("u", "s4", "2020-01-04", "bổ sung", 3, None, "cuối")]
    frame = spark.createDataFrame(steps, "target_uid string, source_uid string, ngay string, action string, khoan int, diem string, new_text string")
    assert effective.compose(articles, frame).first().text == "A\n1. mới\n1. b\n99999999999. z\n2. c\na) [Đã bãi bỏ]\nb) y\nc) thêm\n3. cuối"


def test_html_of_many_blanks(spark):
    page = F.concat(F.lit("<p>"), F.repeat(F.lit(" \n&nbsp;<br/>"), 80_000), F.lit("</p>x"))
    assert one(spark, html.clean(page)) == "x"


def test_texts_compared(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("a", ""), ("abc", "abc")] + [("".join(rng.choice("ab c\n") for _ in range(40)), "".join(rng.choice("ab c\n") for _ in range(40))) for _ in range(20)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a string, b string")
    for r in frame.select("id", compare.char_similarity("a", "b").alias("s"), compare.unified_diff("a", "b").alias("d"), compare.nfc(F.lit("é")).alias("n")).collect():
        a, b = pairs[r.id]
        assert abs(r.s - (difflib.SequenceMatcher(None, a.strip(), b.strip()).ratio() if a and b else float(a == b))) < 1e-12
        assert r.d == "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), fromfile="composed", tofile="hop_nhat", lineterm="")) and r.n == unicodedata.normalize("NFC", "é")
    for text in ("Điều khoản về lương", "plain", "được"):
        for charset in ("latin-1", "cp1252"):
            try:
                broken = text.encode().decode(charset)
            except UnicodeDecodeError:
                continue
            assert one(spark, compare.repair_mojibake(F.lit(broken))) == text
        assert one(spark, compare.repair_mojibake(F.lit(text))) == text


def test_windows_from_the_first_hit(spark):
    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    events = [(i, rng.randrange(4), start + datetime.timedelta(seconds=rng.randrange(40_000))) for i in range(300)]
    got = {(r.id, r.n) for r in stores.rate_windows(spark.createDataFrame(events, "id int, k int, ts timestamp_ntz"), ["k"]).collect()}
    opened, counts = {}, {}
    for _, k, ts in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        if k not in opened or ts >= opened[k] + datetime.timedelta(hours=1):
            opened[k] = ts
        counts[(k, opened[k])] = counts.get((k, opened[k]), 0) + 1
    assert sorted(n for _, n in got) == sorted(n for c in counts.values() for n in range(1, c + 1)) and len(got) == len(events)


def test_codes_lock_and_expire(spark):
    rng, start = random.Random(4), datetime.datetime(2024, 1, 1)
    codes = [(u, start + datetime.timedelta(minutes=rng.randrange(300)), f"h{k}") for u in range(3) for k in range(4)]
    tries = [(u, start + datetime.timedelta(seconds=17 + 31 * rng.randrange(700)), rng.choice(["h0", "h1", "h2", "h3", "x", "y", "z"])) for u in range(4) for _ in range(120)]
    tries = list({(u, t): (u, t, h) for u, t, h in tries}.values())
    got = {(r.user_id, r.at): r.outcome for r in stores.code_checks(spark.createDataFrame(tries, "user_id int, at timestamp_ntz, hash string"), spark.createDataFrame(codes, "user_id int, created_at timestamp_ntz, code_hash string")).collect()}
    state = {}
    for u, t, h in sorted(tries, key=lambda x: x[1]):
        own = [c for c in codes if c[0] == u and c[1] <= t]
        if not own:
            assert got[(u, t)] == "none"
            continue
        last = max(c[1] for c in own)
        code = max(c[2] for c in own if c[1] == last)
        s = state.setdefault((u, last), {"used": False, "failed": 0, "locked": start})
        if s["used"]:
            want = "used"
        elif s["locked"] > t:
            want = "locked"
        elif last + datetime.timedelta(minutes=10) < t:
            want = "expired"
        elif h == code:
            want, s["used"] = "ok", True
        else:
            want = "wrong"
            s["failed"] += 1
            if s["failed"] >= 5:
                s["locked"] = t + datetime.timedelta(minutes=15)
        if len({c[2] for c in own if c[1] == last}) == 1:
            assert got[(u, t)] == want


def test_blocks_hold_all_near_keys(spark):
    rng = random.Random(5)
    base = [f"{rng.choice(['ND', 'TT', 'TTLT'])}-{rng.randrange(1000):03d}-{rng.randrange(1990, 2020)}" for _ in range(60)]

    def bent(key):
        parts = key.split("-")
        for _ in range(2):
            i = rng.randrange(3)
            at = rng.randrange(len(parts[i]) + 1)
            parts[i] = rng.choice([parts[i][:at] + "7" + parts[i][at:], parts[i][:at] + parts[i][at + 1 :], parts[i][: max(at - 1, 0)] + "5" + parts[i][at:]])
        return "-".join(parts)

    pairs = [(k, bent(k)) for k in base for _ in range(5)]
    frame = spark.createDataFrame(pairs, "a string, b string").where(F.levenshtein("a", "b") <= 2)
    assert frame.count() > 200 and frame.where(~F.arrays_overlap(lookup.blocks(F.col("a")), lookup.blocks(F.col("b")))).count() == 0


def test_leaf_texts_and_ladders_of_one_document(spark):
    articles = spark.createDataFrame([("a1", "ch", "1", " A1 "), ("a2", "7", "155a", "A2")], "uid string, parent string, idx string, text string")
    clauses = spark.createDataFrame([("c1", "a1", "1", "C1"), ("c2", "a1", "2", "C2")], "uid string, parent string, idx string, text string")
    points = spark.createDataFrame([("p1", "c1", "a", "P1")], "uid string, parent string, letter string, text string")
    leaves = {(r.uid, r.text) for r in context.leaf_contexts(articles.withColumn("doc_id", F.lit("7")), clauses, points).collect()}
    assert leaves == {("p1", "A1\nC1\nP1"), ("c2", "A1\nC2"), ("a2", "A2")}
    chapters, docs = spark.createDataFrame([("ch", "7")], "uid string, parent string"), spark.createDataFrame([("7", "Luật X")], "doc_id string, title string")
    nodes = spark.createDataFrame([("p1",), ("c2",), ("a2",), ("zz",)], "uid string")
    got = {r.uid: r for r in context.ladder(nodes, points, clauses, articles, chapters, docs).collect()}
    assert got["p1"].display_citation == "Điều 1 khoản 1 điểm a Luật X" and got["p1"].chapter_uid == "ch" and got["a2"].chapter_uid is None and got["a2"].doc_id == "7"
    assert got["zz"].display_citation == "zz" and got["zz"].segment_type is None


def test_lookup_of_articles_clauses_and_points(spark):
    articles = spark.createDataFrame([("a", "7", 17, "T", "A", False)], "uid string, doc_id string, idx int, title string, text string, is_current boolean")
    clauses = spark.createDataFrame([("a_1", "a", 1, "C1"), ("a_2", "a", 2, "C2")], "uid string, parent string, idx int, text string")
    points = spark.createDataFrame([("a_1_a", "a_1", "a", "P")], "uid string, parent string, letter string, text string")
    ask = [(1, "7", "17", None, None), (2, "7", "17", "1", None), (3, "7", "17", "1", "A"), (4, "7", "17", "9", None), (5, "8", "17", None, None), (6, "7", None, None, None)]
    got = {}
    for r in qa.direct_lookup(spark.createDataFrame(ask, "query_id int, target_doc string, article string, clause string, point string"), articles, clauses, points).collect():
        got.setdefault(r.query_id, set()).add(r.uid)
    assert got == {1: {"a", "a_1", "a_2", "a_1_a"}, 2: {"a_1", "a_1_a"}, 3: {"a_1_a"}}


def test_citations_by_position_and_prompt(spark):
    pairs = one(spark, citations.zipped(F.array(F.lit("v1"), F.lit("v2")), F.array(F.lit("c1"))))
    assert [(p.violation, p.check) for p in pairs] == [("v1", "c1")]
    assert one(spark, citations.amendment_lines(F.array().cast("array<struct<source: string, action: string, date: string>>"))) == "Không có lịch sử sửa đổi."


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_moments_before_the_first_version_stay(spark):
    versions = spark.createDataFrame([("a", "2020-01-01", "x"), ("a", "2021-01-01", "y"), ("b", "2022-01-01", "z")], "uid string, as_of string, text string").selectExpr("uid", "cast(as_of as date) as as_of", "text")
    moments = spark.createDataFrame([("a", "2019-01-01"), ("a", "2020-06-01"), ("b", "2021-01-01"), ("c", "2021-01-01")], "uid string, at string").selectExpr("uid", "cast(at as date) as at")
    got = {(r.uid, str(r.at), r.text) for r in effective.as_of(versions, moments).collect()}
    assert got == {("a", "2019-01-01", None), ("a", "2020-06-01", "x"), ("b", "2021-01-01", None), ("c", "2021-01-01", None)}


def test_titles_that_hold_hints_meet_by_strings(spark):
    rng = random.Random(3)
    titles = ["".join(rng.choice("abc é") for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    hints = sorted({"".join(rng.choice("abc é") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    df = qa.holders(spark.createDataFrame(list(enumerate(titles)), "doc_id int, _t string"), spark.createDataFrame([(h,) for h in hints], "_hint string"))
    assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
    got = sorted((r.doc_id, r._hint) for r in df.collect())
    assert got == sorted((i, h) for i, t in enumerate(titles) for h in hints if h in t)


def test_reach_plans_do_not_grow(spark):
    from codexloom.operators import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 0), (7, 7)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (30,)], "id long")
    got = {(r.seed, r.id): r.depth for r in graph.reach(seeds, edges, 10).collect()}
    assert got == {(0, k): k for k in range(11)} | {(30, 30 + k): k for k in range(11) if k <= 10}
    assert plan_of(graph.reach(seeds, edges, 10)).count("Join") == 0
    assert {(r.seed, r.id): r.depth for r in graph.recursive_reach(spark, seeds, edges, 3).collect()} == {k: v for k, v in got.items() if v <= 3}


def test_direct_lookup_joins_each_level_once(spark):
    plan = plan_of(qa.direct_lookup(
        spark.createDataFrame([(1, 1, "1", None, None)], "query_id int, target_doc int, article string, clause string, point string"),
        spark.createDataFrame([("a", 1, 1, "t", "x", True)], "uid string, doc_id int, idx int, title string, text string, is_current boolean"),
        spark.createDataFrame([("c", "a", 1, "x")], "uid string, parent string, idx int, text string"),
        spark.createDataFrame([("p", "c", "a", "x")], "uid string, parent string, letter string, text string"),
    ))
    assert plan.count("HashJoin") + plan.count("SortMergeJoin") == 1


def test_one_bad_document_fails_no_other(spark):
    lines = [(1, 0, "Điều 1. A"), (1, 1, "1. Một"), (2, 0, "Điều 1. A"), (2, None, "1. Một"), (3, 0, "Điều 1. A"), (3, 0, "1. Một"), (4, 0, " "), (4, 1, None), (5, 0, "Ngày"), (6, 0, "Điều 1. A"), (6, 1, "1. x"), (6, 2, "2. y"), (6, 3, "3. z")]
    frame = spark.createDataFrame(lines, "doc_id int, pos long, line string")
    got = {r.doc_id: (r.segments, r.articles, r.parse_error) for r in segment.parsed(frame, most=3).collect()}
    assert got == {1: (2, 1, None), 2: (0, 0, "a line has no position"), 3: (0, 0, "lines share a position"), 4: (0, 0, "no text"), 5: (0, 0, "no segment"), 6: (0, 0, "more than 3 lines")}
    assert segment.parsed(frame.limit(0)).count() == 0


def test_payloads(spark):
    from codexloom.operators import payloads

    found = spark.createDataFrame([(1, 2, "u2", None, None, None, "t2", "unknown", None, "a2"), (1, 1, "u1", "L", 7, "e1", "t1", "verified", "d1", None), (2, 1, "u3", "", 8, "", None, None, "", "")], "query_id int, rank int, uid string, document_title string, article int, effective_text string, text string, status string, display_citation string, article_title string")
    checks = spark.createDataFrame([("u2", 1, False), ("u2", 2, True), ("u1", 1, False), ("", 3, True), ("u3", 1, True), ("u3", 2, None)], "uid string, at int, verified boolean")
    got = {r.query_id: [tuple(p) for p in r.provisions] for r in payloads.provisions(found, checks).collect()}
    assert got == {1: [("L", "Điều 7", "e1", True, "d1"), ("", "", "t2", True, "a2")], 2: [("", "Điều 8", "", False, "u3")]}
    raw = spark.createDataFrame([([(None, None), ("A", 0.2)], 0.7), ([], None), ([(None, None)], None)], "i array<struct<type: string, confidence: double>>, c double")
    assert [[tuple(x) for x in r.o] for r in raw.select(payloads.intents(F.col("i"), F.col("c")).alias("o")).collect()] == [[("SEARCH", 0.7), ("A", 0.2)], [], [("SEARCH", 0.0)]]
    levels = spark.createDataFrame([("high",)] * 8 + [("low",)] * 2, "confidence string")
    assert {r.confidence: (r.n, r.percent, r.on_target) for r in payloads.within_targets(levels).collect()} == {"high": (8, 80.0, True), "medium": (0, 0.0, True), "low": (2, 20.0, False)}
    assert all(r.on_target for r in payloads.within_targets(levels.limit(0)).collect())


def test_segments_stream_their_lines(spark):
    """Lines pass one by one: no document is gathered, and batches may end anywhere in it."""
    rows = [(d, 10 * i, x) for d in (None, 1, 2) for i, x in enumerate(["Chương I", "mở", "Mục 1. A", "sau", *(y for n in range(300) for y in (f"Điều {n}. T", "lời", f"{n}. khoản", "b) điểm", "“1. trích", "hết”")), "KT. B", "Điều 999. Z"])]
    frame = spark.createDataFrame(rows, "doc_id long, pos int, line string").repartition(3)
    found = segment.segments(frame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan
    whole = sorted(map(str, found.collect()))
    assert len(whole) == 3 * (1 + 3 * 300) and sum("text='Chương I\\nmở\\nsau'" in r for r in whole) == 3 and sum("text='b) điểm\\n“1. trích\\nhết”'" in r for r in whole) == 900
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(str, segment.segments(frame).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_joins_of_levels_keep_parts_small(spark):
    """What a task sorts doesn't grow by merged parts: the joins' sides are dealt into parts of their own number."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = lambda ddl: spark.createDataFrame([], ddl)
    a, c, p = made("uid string, parent string, doc_id string, idx int, text string"), made("uid string, parent string, idx int, text string"), made("uid string, parent string, letter string, text string")
    found = plan(context.ladder(made("uid string"), p, c, a, made("uid string, parent string"), made("doc_id string, title string")))
    assert found.count("REPARTITION_BY_NUM") == 3
    assert plan(context.leaf_contexts(a, c, p)).count("REPARTITION_BY_NUM") == 3
    way = made("query_id long, uid long, score double")
    found = plan(hybrid.retrieve(way, way, made("uid long, haystack string, doc_type string"), made("query_id long, keywords array<string>, title_hints array<string>"), made("src long, dst long, rel_type string")))
    assert "REPARTITION_BY_NUM" in found


def test_words_before_numbers_are_dropped(spark):
    rows = spark.createDataFrame([("Điều 5", "KHOẢN  2", "đIểm a"), ("5", "2", "đ"), ("đ", None, "k"), (" Null ", "1", "x")], "a string, k string, p string")
    got = [r.uid for r in rows.select(ids.build_uid(F.lit(1), F.col("a"), F.col("k"), F.col("p")).alias("uid")).collect()]
    assert got == ["doc_1_dieu_5_khoan_2_diem_a", "doc_1_dieu_5_khoan_2_diem_đ", "doc_1_dieu_đ", "doc_1"]


def test_equal_titles_meet_hints_once(spark, monkeypatch):
    seen, holders = [], qa.holders
    monkeypatch.setattr(qa, "holders", lambda titles, hints: seen.append(titles.count()) or holders(titles, hints))
    docs = spark.createDataFrame([(i, None, None, t) for i, t in enumerate(["Luật Đất đai", "luật đất đai ", "LUẬT ĐẤT ĐAI", None, "khác"])], "doc_id long, so_ky_hieu string, key string, title string")
    asked = spark.createDataFrame([(1, None, None, "đất đai"), (2, None, None, "không có")], "query_id long, doc_id string, so_ky_hieu string, document_hint string")
    assert {(r.query_id, r.target_doc, r.how) for r in qa.resolve_documents(asked, docs).collect()} == {(1, 0, "title"), (2, None, "none")} and seen == [3]


def test_all_segments_meet_their_article_in_one_join(spark):
    """`ladders` gives what `ladder` gives of every uid; lines are read, and shuffled, once."""
    articles = spark.createDataFrame([(1, "a1", "ch", "1", " A1 "), (2, "a2", "7", "155a", "A2"), (3, None, "7", "3", "x"), (None, "a4", "7", "4", "x"), (5, "a5", "zz", "5", None)], "key int, uid string, parent string, idx string, text string")
    clauses = spark.createDataFrame([(1, "1", "C1", [("a", "P1"), ("b", None)]), (1, "2", "C2", None), (2, "Khoản 3", "C3", []), (5, "1", None, [("k", "P")]), (9, "1", "lost", [])], "key int, idx string, text string, points array<struct<letter: string, text: string>>")
    chapters, docs = spark.createDataFrame([("ch", "7")], "uid string, parent string"), spark.createDataFrame([("7", "Luật X")], "doc_id string, title string")
    got = context.ladders(articles, clauses, chapters, docs)
    c = clauses.join(articles.select("key", F.col("uid").alias("parent")), "key").where("parent is not null").withColumn("uid", ids.clause_uid(F.col("parent"), F.col("idx")))
    p = c.select(F.col("uid").alias("parent"), F.inline("points")).withColumn("uid", ids.point_uid(F.col("parent"), F.col("letter")))
    a = articles.where("key is not null and uid is not null")
    nodes = a.select("uid").union(c.select("uid")).union(p.select("uid"))
    want = context.ladder(nodes, p, c.select("uid", "parent", "idx", "text"), a, chapters, docs)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 10
    odd = context.ladders(articles, spark.createDataFrame([(1, None, "C", [("a", "P")]), (2, "1", "C", [(None, "P")])], clauses.schema), chapters, docs)
    assert [(r.uid, r.segment_type, r.clause_uid) for r in odd.where("segment_type <> 'Article'").orderBy("uid", "segment_type").collect()] == [(None, "Clause", None), (None, "Point", "a2_khoan_1"), ("a2_khoan_1", "Clause", "a2_khoan_1")]
    from codexloom.plans import answers

    plan = plan_of(answers.hier_ladder(spark, "/root/testdata/sf0.001"))
    assert plan.count("/lineitem.parquet") == 1


def test_retrieval_against_brute_force(spark):
    """Only the first neighbours of a node travel, texts stay where they are, and the ranks are those of scoring everything twice."""
    rng = random.Random(5)
    texts = [(u, rng.choice(["Small brass ring", "ring", "x", "BRASS", "small"]), rng.choice(["Luật", "Nghị định", None])) for u in range(60)]
    plans = [(q, rng.choice([["small", "ring"], ["x", ""], []]), rng.choice([["brass"], []])) for q in range(12)]
    rows = [(rng.randrange(14), rng.choice([rng.randrange(64), 3]), rng.choice([0.0, 0.1, 0.4, None]), rng.choice([0.0, 0.2, 0.3])) for _ in range(500)] + [(None, 1, 1.0, 1.0), (1, None, 1.0, 1.0)]
    edges = [(rng.randrange(60), rng.choice([rng.randrange(70), 3]), rng.choice(["MODIFIES", "REFERENCES", None])) for _ in range(500)]
    merged, near, hay, plan = {}, {}, {u: t for u, *t in texts}, {q: t for q, *t in plans}
    for q, u, v, x in rows:
        a, b = merged.get((q, u), (0.0, 0.0))
        merged[q, u] = max(a, v or 0.0), max(b, x)
    for s, t, r in edges:
        for a, b in ((s, t), (t, s)):
            near.setdefault(a, {}).setdefault(b, set()).add(r == "MODIFIES")

    def score(q, u, graph=1.0, validity=1.0):
        held = lambda words: sum(w != "" and w in hay[u][0].lower() for w in words)
        v, x = merged.get((q, u), (0.0, 0.0))
        weight = {"Luật": 3.0, "Nghị định": 2.0}.get(hay[u][1], 1.0)
        return round((0.5 * v + 0.25 * x + min(held(plan[q][0]) * 0.08, 0.24) + min(held(plan[q][1]) * 0.12, 0.24)) * graph * weight * validity, 9)

    want = set()
    for q in plan:
        old = {u: score(q, u) for p, u in merged if p == q and u in hay}
        first = sorted(old, key=lambda u: (-old[u], u))[:5]
        found = {}
        for s in first:
            for u, changed in near.get(s, {}).items():
                found.setdefault(u, set()).update(changed)
        new = {u: score(q, u, 1.25, 0.95 if True in found[u] else 1.0) for u in sorted(found)[:10] if u in hay}
        every = old | new
        want |= {(q, u, round(every[u], 6), i + 1) for i, u in enumerate(sorted(every, key=lambda u: (-every[u], u))[:5])}
    frame = spark.createDataFrame
    tables = frame(texts, "uid long, haystack string, doc_type string"), frame(plans, "query_id long, keywords array<string>, title_hints array<string>"), frame(edges, "src long, dst long, rel_type string")
    got = hybrid.ranked(frame(rows, "query_id long, uid long, vector double, lexical double"), *tables)
    assert {(r.query_id, r.uid, round(r.score, 6), r["rank"]) for r in got.collect()} == want and len(want) == 60
    ways = [frame([(r[0], r[1], r[i] or 0.0) for r in rows], "query_id long, uid long, score double") for i in (2, 3)]
    assert {(r.query_id, r.uid, round(r.score, 6), r["rank"]) for r in hybrid.retrieve(*ways, *tables).collect()} == want
    hub = hybrid.neighbours(frame([(1, 0), (1, 1), (2, 1)], "query_id long, src long"), frame([(0, i, "MODIFIES" if i % 2 else "x") for i in range(500)] + [(7, 1, None)], "src long, dst long, rel_type string"), 3)
    assert {tuple(r) for r in hub.collect()} == {(1, 0, True), (1, 1, True), (1, 2, False), (2, 0, True), (2, 7, False)} and "collect_list(struct(dst" in hub._jdf.queryExecution().analyzed().toString()
