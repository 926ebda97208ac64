"""References, segments and effective texts over sentences that are written from the driver's tables.

The texts are made of a row's own keys, so that the SQL tells the expected parts from the keys and never reads the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.functions import identifiers as ids
from codexloom.functions.compare import nfc, repair_mojibake
from codexloom.operators import effective, html, refs, segment
from codexloom.plans.registry import query, table
from codexloom.sources.tables import spread


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.lower("o_orderstatus").alias("s"), F.concat(F.lit("doc_"), "o_custkey", F.lit("_dieu_"), "o_orderkey").alias("uid"))


@query("""WITH o AS (SELECT 'doc_' || o_custkey || '_dieu_' || o_orderkey AS uid, o_orderkey AS o, o_custkey AS c, lower(o_orderstatus) AS s FROM orders)
 SELECT uid, CAST(o AS VARCHAR) AS article, CAST(c AS VARCHAR) AS clause, s AS point FROM o UNION SELECT uid, CAST(o AS VARCHAR), CAST(c AS VARCHAR), NULL FROM o UNION SELECT uid, CAST(o AS VARCHAR), NULL, NULL FROM o
 UNION SELECT uid, c || 'a', '3', NULL FROM o UNION SELECT uid, c || 'a', NULL, NULL FROM o""")
def refs_internal(spark, d):
    o = _orders(spark, d)
    return refs.internal(o.select("uid", F.concat(F.lit("theo điểm "), "s", F.lit(" khoản "), "c", F.lit(" Điều "), "o", F.lit(" và khoản 3 điều "), "c", F.lit("a, hết")).alias("text")))


@query("""SELECT 'doc_' || o_custkey || '_dieu_' || o_orderkey AS uid, unnest(['Nghị định', 'Thông tư liên tịch', 'Thông tư', 'Luật']) AS doc_type,
 unnest([(o_custkey % 900 + 1) || '/2014/NĐ-CP', (o_custkey % 900 + 1) || '/2016/TTLT-BTC-BTP', (o_orderkey % 900 + 1) || '/2018/TT-BTC', (o_orderkey % 900 + 1) || '/2020/QH14']) AS so_ky_hieu FROM orders""")
def refs_external(spark, d):
    o = _orders(spark, d)
    c, k = (F.col("c") % 900 + 1).cast("string"), (F.col("o") % 900 + 1).cast("string")
    text = F.concat(F.lit("Theo Nghị định số "), c, F.lit("/2014/NĐ-CP, Thông tư liên tịch số "), c, F.lit("/2016/TTLT-BTC-BTP, thông tư "), k, F.lit("/2018/TT-BTC và Luật Đất đai số "), k, F.lit("/2020/QH14."))
    return refs.external(o.select("uid", text.alias("text"))).drop("start")


def _amending(spark, d):
    o, c = spread(_orders(spark, d), "o"), F.col("c").cast("string")  # dealt by their keys before texts are made
    text = (
        F.when(F.col("o") % 4 == 0, F.concat(F.lit("1. Sửa đổi khoản 2 Điều "), c, F.lit(" Nghị định số 46/2014/NĐ-CP như sau: “Điều 99 mới, khoản 7 Điều 98")))
        .when(F.col("o") % 4 == 1, F.concat(F.lit("Bãi bỏ điểm a khoản 1 Điều "), c, F.lit("; Bãi bỏ khoản 4 Điều "), c))
        .when(F.col("o") % 4 == 2, F.concat(F.lit("Bổ sung Điều "), c, F.lit("a vào sau Điều "), c))
        .otherwise(F.concat(F.lit("Sửa đổi khoản 1; khoản 2 và điểm b khoản 3 Điều "), c, F.lit(" / Điều "), c))
    )
    return o.select("uid", text.alias("text"), F.lit(True).alias("is_modifying"))


_MODS = """SELECT uid, 0 AS part, c AS article, '2' AS clause, NULL AS point, '46/2014/NĐ-CP' AS doc_ref, 'sua_doi' AS action, '1' AS source_clause FROM o WHERE o % 4 = 0
 UNION ALL SELECT uid, 0, c, '1', 'a', NULL, 'bai_bo', NULL FROM o WHERE o % 4 = 1 UNION ALL SELECT uid, 1, c, '4', NULL, NULL, 'sua_doi', NULL FROM o WHERE false UNION ALL SELECT uid, 1, c, '4', NULL, NULL, 'bai_bo', NULL FROM o WHERE o % 4 = 1
 UNION ALL SELECT uid, 0, c, NULL, NULL, NULL, 'bo_sung', NULL FROM o WHERE o % 4 = 2
 UNION ALL SELECT uid, 0, c, unnest(['1', '2', '3']), unnest([NULL, NULL, 'b']), NULL, 'sua_doi', NULL FROM o WHERE o % 4 = 3"""
_MODDED = "WITH o AS (SELECT 'doc_' || o_custkey || '_dieu_' || o_orderkey AS uid, o_orderkey AS o, CAST(o_custkey AS VARCHAR) AS c FROM orders)"


@query(f"{_MODDED} {_MODS}")
def refs_modification(spark, d):
    cut = _amending(spark, d).select("uid", F.posexplode(refs.fragments(F.col("text"), F.col("is_modifying"))).alias("part", "fragment"))
    return refs.modifications(cut, ["uid", "part"]).select("uid", "part", "article", "clause", "point", "doc_ref", "action", "source_clause")


@query(f"{_MODDED}, m AS ({_MODS}) SELECT uid, part, article, clause, point, 'modification' AS kind, action FROM m UNION ALL SELECT uid, 0, c || 'a', NULL, NULL, 'modification', 'bo_sung' FROM o WHERE o % 4 = 2 UNION ALL SELECT uid, 0, c, NULL, NULL, 'modification', 'sua_doi' FROM o WHERE o % 4 = 3")
def refs_articles(spark, d):
    """All references of amending units: what the sentences aim at, and what else they name."""
    return refs.extract_articles(_amending(spark, d)).select("uid", "part", "article", "clause", "point", "kind", "action")


@query("""SELECT 'doc_' || o_custkey || '_dieu_' || o_orderkey AS uid, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Luật ' || o_custkey END AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey || '/2012/QH13' END AS so_ky_hieu FROM orders""")
def preamble_anchor(spark, d):
    o = _orders(spark, d)
    text = F.when(F.col("o") % 3 == 0, "Căn cứ Hiến pháp").otherwise(F.concat(F.lit("Căn cứ Luật cũ số 1/2001/QH10; ban hành Luật sửa đổi, bổ sung một số điều của Luật "), "c", F.lit(" số "), "c", F.lit("/2012/QH13 đã được sửa đổi, bổ sung một số điều của Luật khác số 5/2009/QH12")))
    return o.select("uid", refs.preamble_anchor(text).alias("a")).select("uid", "a.title", "a.so_ky_hieu")


@query("""WITH n AS (SELECT p_partkey % 300 AS m, min(p_partkey) AS id FROM part WHERE p_partkey <> 7 GROUP BY 1)
 SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'LT-059-2020' WHEN 1 THEN 'ND-' || lpad(CAST(o_custkey % 300 + 1 AS VARCHAR), 3, '0') || '-2014' ELSE 'ND-' || lpad(CAST(o_custkey % 900 + 1 AS VARCHAR), 3, '0') || '-2099' END AS key, CASE o_orderkey % 3 WHEN 0 THEN '7' WHEN 1 THEN CAST(n.id AS VARCHAR) END AS target_doc_id,
 CASE o_orderkey % 3 WHEN 0 THEN 'short_title_map' WHEN 1 THEN CASE WHEN n.id IS NULL THEN 'unresolved' ELSE 'exact' END ELSE 'unresolved' END AS match_method FROM orders LEFT JOIN n ON n.m = o_custkey % 300""")
def resolve_prefix_year(spark, d):
    """References by short title, by number, and by a number that nobody has, to documents made of all parts."""
    from codexloom.operators import lookup

    way, p = F.col("o") % 3, F.col("p_partkey")
    raw = F.when(way == 0, "Luật Doanh nghiệp").when(way == 1, F.concat((F.col("c") % 300 + 1).cast("string"), F.lit("/2014/NĐ-CP"))).otherwise(F.concat((F.col("c") % 900 + 1).cast("string"), F.lit("/2099/NĐ-CP")))
    found = _orders(spark, d).select(F.col("o").alias("id"), raw.alias("raw"), F.when(way == 0, "Luật").otherwise("Nghị định").alias("doc_type"))
    number = F.when(p == 7, "59/2020/QH14").otherwise(F.concat((p % 300 + 1).cast("string"), F.lit("/2014/NĐ-CP")))
    docs = table(spark, d, "part").select(p.alias("doc_id"), number.alias("so_ky_hieu"), F.when(p == 7, "Luật").otherwise("Nghị định").alias("loai_van_ban"), p.alias("ord"))
    titles = docs.where("loai_van_ban = 'Luật'").select(F.lit("Luật Doanh nghiệp").alias("title"), "so_ky_hieu")
    return refs.resolve_external(found, titles, lookup.lookup_table(docs)).select("id", "key", "target_doc_id", "match_method")


@query("SELECT 'doc_' || o_custkey || '_dieu_' || o_orderkey || '_khoan_2' AS uid, 'Xem Điều ' || o_orderkey || ', khoản 2 Điều ' || o_orderkey || ' và điểm này' AS text FROM orders")
def self_ref_resolve(spark, d):
    uid = F.concat("uid", F.lit("_khoan_2"))
    return _orders(spark, d).select(uid.alias("uid"), refs.resolve_self(F.lit("Xem điều này, Khoản này và điểm này"), uid).alias("text"))


@query("SELECT o_orderkey AS id, 'khoản ' || o_custkey || ' Điều ' || o_orderkey || ' , khoản 2a Điều ' || o_orderkey || '; điểm a khoản ' || o_custkey || ' và điểm đ khoản ' || o_custkey AS text FROM orders")
def chain_expand(spark, d):
    text = F.concat(F.lit("khoản "), "c", F.lit(", khoản 2a Điều "), "o", F.lit("; điểm a và điểm đ khoản "), "c")
    return _orders(spark, d).select(F.col("o").alias("id"), refs.expand_chains(text).alias("text"))


# segments of documents: a customer's orders are articles, their line numbers clauses, flags of a line points


def _document_lines(spark, d):
    """doc_id, pos, line: a chapter every 50 orders, an article for each order, a quoted line that looks like an article behind it."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("o"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"), F.lower("l_returnflag").alias("p")).distinct().join(o, "o")  # noqa: E741
    at = lambda k, p: (F.col("o") * 1000 + k * 100 + p).cast("long").alias("pos")
    zero = F.lit(0)
    heads = o.select("doc_id", at(zero, zero), F.concat(F.lit("Điều "), "o", F.lit(". Tên")).alias("line"))
    quotes = o.select("doc_id", at(zero, F.lit(1)), F.lit("“Điều 9. trong trích dẫn”").alias("line"))
    clauses = l.select("doc_id", "o", "k").distinct().select("doc_id", at(F.col("k"), zero), F.concat("k", F.lit(". khoản")).alias("line"))
    points = l.select("doc_id", at(F.col("k"), F.ascii("p") - 96), F.concat("p", F.lit(") điểm")).alias("line"))
    first = o.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("pos"), F.lit("Căn cứ Hiến pháp").alias("line"))
    return heads.unionByName(quotes).unionByName(clauses).unionByName(points).unionByName(first)


_SEG = """WITH a AS (SELECT o_custkey AS doc_id, o_orderkey AS o FROM orders), l AS (SELECT DISTINCT doc_id, o, l_linenumber AS k, lower(l_returnflag) AS p FROM lineitem JOIN a ON l_orderkey = o),
 s AS (SELECT doc_id, 'article' AS level, CAST(o AS VARCHAR) AS idx, 'doc_' || doc_id || '_dieu_' || o AS uid, NULL AS parent_uid, 'Điều ' || o || '. Tên' || chr(10) || '“Điều 9. trong trích dẫn”' AS text FROM a
  UNION ALL SELECT DISTINCT doc_id, 'clause', CAST(k AS VARCHAR), 'doc_' || doc_id || '_dieu_' || o || '_khoan_' || k, 'doc_' || doc_id || '_dieu_' || o, k || '. khoản' FROM l
  UNION ALL SELECT doc_id, 'point', p, 'doc_' || doc_id || '_dieu_' || o || '_khoan_' || k || '_diem_' || p, 'doc_' || doc_id || '_dieu_' || o || '_khoan_' || k, p || ') điểm' FROM l)"""


@query(f"{_SEG} SELECT * FROM s")
def segment_tree(spark, d):
    return segment.segments(_document_lines(spark, d)).select("doc_id", "level", "idx", "uid", "parent_uid", "text")


@query(f"{_SEG} SELECT doc_id, level, count(*) AS n FROM s GROUP BY 1, 2")
def segment_counts(spark, d):
    return segment.segments(_document_lines(spark, d)).groupBy("doc_id", "level").agg(F.count("*").alias("n"))


_CONF = f"""{_SEG}, f AS (SELECT doc_id, count(*) FILTER (level = 'article') AS articles, count(DISTINCT CASE WHEN level = 'clause' THEN parent_uid END) AS clauses FROM s GROUP BY 1),
 c AS (SELECT doc_id, round(0.5::DOUBLE * least(1.0::DOUBLE, articles::DOUBLE / 12) + 0.2::DOUBLE * least(1.0::DOUBLE, clauses::DOUBLE / articles / 0.25::DOUBLE) + 0.3::DOUBLE, 6) AS score FROM f)"""


def _confidence(spark, d):
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(12).cast("long").alias("expected"))
    return segment.confidence(segment.segments(_document_lines(spark, d)), expected)


@query(f"{_CONF} SELECT doc_id, score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM c")
def segment_confidence(spark, d):
    return _confidence(spark, d).select("doc_id", F.round("score", 6).alias("score"), "confidence")


@query(f"{_CONF} SELECT confidence, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM c GROUP BY 1)")
def confidence_distribution(spark, d):
    from pyspark.sql import Window

    counts = _confidence(spark, d).withColumn("confidence", F.when(F.round("score", 6) >= 0.9, "high").when(F.round("score", 6) >= 0.6, "medium").otherwise("low")).groupBy("confidence").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # three rows


@query("""SELECT o_orderkey AS doc_id, CASE WHEN way IN (1, 2, 3, 4) THEN 0 ELSE 3 END AS segments, CASE WHEN way IN (1, 2, 3, 4) THEN 0 ELSE 1 END AS articles,
 CASE way WHEN 1 THEN 'a line has no position' WHEN 2 THEN 'lines share a position' WHEN 3 THEN 'no text' WHEN 4 THEN 'no segment' END AS parse_error FROM (SELECT o_orderkey, o_orderkey % 9 AS way FROM orders)""")
def segment_errors(spark, d):
    """Orders as documents of three lines, some with faults planted: each has a row, and faults are told."""
    o = F.col("o_orderkey")
    way, i = o % 9, F.col("i")
    texts = F.when(way == 4, F.concat(F.lit("Ngày "), o)).when(i == 0, F.concat(F.lit("Điều "), o, F.lit(". Phạm vi"))).when(i == 1, "1. Khoản một").otherwise("a) Điểm a")
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("i"))
    pos = F.when((way == 2) & (i == 2), 1).when((way != 1) | (i < 2), i)
    return segment.parsed(rows.select(o.alias("doc_id"), pos.cast("long").alias("pos"), F.when(way != 3, texts).alias("line")))


@query("""SELECT confidence, n, round(100.0::DOUBLE * n / total, 1) AS percent, CASE confidence WHEN 'high' THEN n >= 0.80 * total WHEN 'low' THEN n <= 0.05 * total ELSE true END AS on_target
 FROM (SELECT unnest(['high', 'medium', 'low']) AS confidence, unnest([h, m, l]) AS n, total FROM (SELECT count(*) FILTER (value >= 50) AS h, count(*) FILTER (value >= 5 AND value < 50) AS m, count(*) FILTER (value < 5) AS l, count(*) AS total FROM events))""")
def confidence_targets(spark, d):
    """Levels of all events' values against the targets."""
    from codexloom.operators import payloads

    v = F.col("value")
    return payloads.within_targets(table(spark, d, "events").select(F.when(v >= 50, "high").when(v >= 5, "medium").otherwise("low").alias("confidence")))


# effective texts: an order is an article of two clauses, its lines are amendments


def _amendments(spark, d):
    action = F.when(F.col("l_returnflag") == "R", "Bãi bỏ").otherwise("Sửa đổi")
    return table(spark, d, "lineitem").select(F.concat(F.lit("a"), "l_orderkey").alias("target_uid"), F.concat(F.lit("p"), "l_partkey").alias("source_uid"), F.col("l_shipdate").cast("date").alias("ngay"), action.alias("action"), F.col("l_linenumber").cast("int").alias("khoan"), F.concat(F.lit("v"), "l_partkey").alias("new_text"))


_AM = "am AS (SELECT 'a' || l_orderkey AS uid, 'p' || l_partkey AS src, CAST(l_shipdate AS DATE) AS ngay, CASE WHEN l_returnflag = 'R' THEN 'bai_bo' ELSE 'sua_doi' END AS action, l_linenumber AS k, 'v' || l_partkey AS txt FROM lineitem)"


@query(f"""WITH {_AM}, last AS (SELECT uid, k, arg_max(CASE WHEN action = 'bai_bo' THEN '[Đã bãi bỏ]' ELSE txt END, (ngay, src, action, k)) AS t FROM am GROUP BY 1, 2), base AS (SELECT 'a' || o_orderkey AS uid, unnest([0, 1, 2]) AS k FROM orders),
 whole AS (SELECT uid, k, CASE WHEN t IS NOT NULL THEN k || '. ' || t WHEN k = 0 THEN 'Mở đầu' ELSE k || '. cũ' END AS line FROM base FULL JOIN last USING (uid, k) WHERE uid IN (SELECT uid FROM base))
 SELECT w.uid, string_agg(line, chr(10) ORDER BY k) AS text, any_value(coalesce(n, 0)) AS n_changes FROM whole w LEFT JOIN (SELECT uid, count(*) AS n FROM am GROUP BY 1) c USING (uid) GROUP BY 1""")
def effective_text(spark, d):
    articles = table(spark, d, "orders").select(F.concat(F.lit("a"), "o_orderkey").alias("uid"), F.lit("Mở đầu\n1. cũ\n2. cũ").alias("text"))
    return effective.compose(articles, _amendments(spark, d)).select("uid", "text", "n_changes")


@query(f"WITH {_AM} SELECT uid AS target_uid, count(*) AS n, max(ngay) AS latest, string_agg(src, ',' ORDER BY ngay, src, action, k) AS chain FROM am GROUP BY 1")
def amendment_chain(spark, d):
    return effective.chains(_amendments(spark, d)).select("target_uid", "n", "latest", F.array_join("chain.source_uid", ",").alias("chain"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS t, 100 + c_custkey % 40 AS s FROM customer UNION SELECT 100 + n_nationkey, 200 + n_regionkey FROM nation), r AS (SELECT t AS target, s AS source, 1 AS depth FROM e UNION SELECT r.target, e.s, r.depth + 1 FROM r JOIN e ON e.t = r.source WHERE r.depth < 10)
 SELECT CAST(target AS VARCHAR) AS target_uid, CAST(source AS VARCHAR) AS source_uid, min(depth) AS depth, min(depth) > 1 AS is_transitive FROM r GROUP BY 1, 2""")
def amendment_traversal(spark, d):
    day = F.lit("2020-01-01").cast("date").alias("ngay")
    one = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("target_uid"), (100 + F.col("c_custkey") % 40).cast("string").alias("source_uid"), day)
    two = table(spark, d, "nation").select((100 + F.col("n_nationkey")).cast("string").alias("target_uid"), (200 + F.col("n_regionkey")).cast("string").alias("source_uid"), day)
    return effective.transitive_chains(one.unionByName(two).distinct()).select("target_uid", "source_uid", "depth", "is_transitive")


@query("SELECT uid, as_of, text, 'eff_' || uid || '_' || strftime(as_of, '%Y-%m-%d') AS version_uid, as_of = max(as_of) OVER (PARTITION BY uid) AS is_current FROM (SELECT 'c' || o_custkey AS uid, CAST(o_orderdate AS DATE) AS as_of, arg_max(o_orderpriority, o_orderkey) AS text FROM orders GROUP BY 1, 2)")
def effective_versions(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("uid"), F.col("o_orderdate").cast("date").alias("as_of"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("n_changes"))
    return effective.versions(rows).select("uid", "as_of", "text", "version_uid", "is_current")


@query(f"WITH {_AM} SELECT 'eff_' || uid || '_' || strftime(max(ngay) OVER (PARTITION BY uid), '%Y-%m-%d') AS version_uid, src AS dst, 'AMENDED_BY' AS rel_type, CAST(row_number() OVER (PARTITION BY uid ORDER BY ngay, src, action, k) AS INTEGER) AS place FROM am UNION ALL SELECT 'eff_' || uid || '_' || strftime(max(ngay), '%Y-%m-%d'), uid, 'COMPOSED_FROM', 0 FROM am GROUP BY uid")
def version_edges(spark, d):
    return effective.version_edges(effective.chains(_amendments(spark, d)))


@query("SELECT doc_id, text, coalesce('new ' || quality, text) AS effective_text, CASE WHEN quality IS NULL THEN 'fallback' ELSE 'composed' END AS effective_status FROM (SELECT doc_id, lang AS text FROM documents) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def effective_fallback(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.col("lang").alias("text"))
    new = table(spark, d, "labels").groupBy(F.col("doc_id").alias("uid")).agg(F.concat(F.lit("new "), F.max("quality")).alias("text")).withColumn("is_current", F.lit(True))
    return effective.effective_or_raw(docs, new).withColumnRenamed("uid", "doc_id")


@query("SELECT source AS doc_type, count(*) FILTER (quality = 1) AS current, count(*) FILTER (quality <> 1) AS voided FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1")
def validity_report(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return effective.validity_report(table(spark, d, "documents").join(labels, "doc_id").select(F.col("source").alias("doc_type"), (F.col("quality") == 1).alias("is_current")))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 1.0::DOUBLE WHEN item_id % 3 = 1 THEN round(2.0::DOUBLE * length(trim(text)) / (2 * length(trim(text)) + 4), 6) ELSE 0.0::DOUBLE END AS similarity, item_id % 3 < 2 AS structural FROM benchmark")
def text_agreement(spark, d):
    """A text against itself, against itself with four signs more, and against nothing."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("uid"), "text")
    other = F.when(F.col("uid") % 3 == 0, F.col("text")).when(F.col("uid") % 3 == 1, F.concat(F.trim("text"), F.lit("ЖЖЖЖ"))).otherwise("")
    found = effective.agreement(b, b.select("uid", other.alias("text")))
    return found.select(F.col("uid").alias("item_id"), F.round("char_similarity", 6).alias("similarity"), (F.col("structural") & (F.col("uid") % 3 < 2)).alias("structural"))


@query("SELECT source, count(*) AS n, round(coalesce(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 0.0), 6) AS rate FROM documents GROUP BY 1")
def agreement_rate(spark, d):
    rows = effective.agreement_rate(table(spark, d, "documents").select("source", (F.col("n_chars") > 1000).alias("is_match")), "source")
    return rows.withColumn("rate", F.round("rate", 6))


# text repair, pages


@query("SELECT doc_id, true AS repaired, true AS composed FROM documents")
def mojibake_repair(spark, d):
    """Each text read as Latin-1 from its UTF-8 bytes is repaired, and decomposed letters are composed again.

    Capitals such as Ó count as marks of bad decoding, and signs below À become an Â, which counts as a letter: the texts are put in
    lower case, without such signs.
    """
    texts = table(spark, d, "documents").select("doc_id", F.lower(F.regexp_replace("text", r"[\x80-\xBF]", "")).alias("t"))
    t = F.col("t")
    broken = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    accents = F.replace(F.replace(t, F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    return texts.select("doc_id", (repair_mojibake(broken) == t).alias("repaired"), (nfc(accents) == nfc(t)).alias("composed"))


@query("SELECT page_id, count(*) AS n, sum(length(x)) AS total FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1)), '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS x FROM pages) WHERE x <> '' GROUP BY 1")
def html_lines(spark, d):
    lines = html.lines(table(spark, d, "pages").select("page_id", "html")).where("tag = 'li'")
    return lines.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.char_length("line")).alias("total"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6]\\b[^>]*>[^<]+</h[1-6]>')) AS headings FROM pages")
def html_leaf_blocks(spark, d):
    """Headings are leaf blocks on the driver's pages."""
    lines = html.lines(table(spark, d, "pages").select("page_id", "html")).where("tag like 'h%'").groupBy("page_id").agg(F.count("*").alias("n"))
    return table(spark, d, "pages").select("page_id").join(lines, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("headings"))


@query("SELECT page_id, page_id % 2 = 0 AS is_empty FROM pages")
def html_empty_p(spark, d):
    """An empty paragraph put in front of a page goes, and one with a word stays."""
    front = F.when(F.col("page_id") % 2 == 0, "<P class='x'> &nbsp;<br/>\n</p>").otherwise("<p>&nbsp;x</p>")
    page = F.col("html")
    return table(spark, d, "pages").select("page_id", (html.clean(F.concat(front, page)) == html.clean(page)).alias("is_empty"))


@query("SELECT o_orderkey AS id, 'Điều ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' khoản ' || o_custkey ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' Luật X' ELSE '' END AS citation FROM orders")
def hier_citation(spark, d):
    o = _orders(spark, d)
    text = ids.citation(F.col("o"), F.when(F.col("o") % 2 == 0, F.col("c")), F.lit(""), F.when(F.col("o") % 3 == 0, "Luật X"), F.lit("?"))
    return o.select(F.col("o").alias("id"), text.alias("citation"))
