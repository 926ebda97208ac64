"""Graph, segmentation, references, effective text, personal data, review rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.operators import effective, graph, pii, refs, review, segment
from codexloom.plans.registry import fixture, query, table
from codexloom.sources.tables import spread

#: Types of the labels that the view of edges holds.
_EDGE_TYPE = """CASE label WHEN 'Văn bản căn cứ' THEN 'CITES' WHEN 'CAN_CU' THEN 'CITES' WHEN 'SUA_DOI' THEN 'AMENDS' WHEN 'Văn bản sửa đổi' THEN 'AMENDS' WHEN 'LIEN_QUAN' THEN 'RELATED'
 WHEN 'THAY_THE' THEN 'SUPERSEDES' WHEN 'Văn bản HD, QĐ chi tiết' THEN 'DETAILS' WHEN 'Văn bản quy định hết hiệu lực 1 phần' THEN 'PARTIALLY_SUPERSEDES' ELSE 'UNKNOWN' END"""


@query(f"SELECT {_EDGE_TYPE} AS rel_type, count(*) AS n FROM {{fx_edges}} GROUP BY 1")
def rel_type_map_counts(spark, d):
    return fixture(spark, d, "edges").groupBy(F.coalesce(graph.edge_type(F.col("label")), F.lit("UNKNOWN")).alias("rel_type")).agg(F.count("*").alias("n"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderstatus").alias("rel_type"), F.col("o_orderkey").alias("ord"))


@query("SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1, 2")
def edge_fk_valid(spark, d):
    suppliers = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    parts = table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return graph.valid_edges(edges, suppliers.unionByName(parts)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("WITH ends AS (SELECT DISTINCT o_orderkey, unnest([o_custkey, o_custkey + 7]) AS id FROM orders) SELECT id, count(*) AS n_edges FROM ends WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def edge_orphans(spark, d):
    nodes = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 7).alias("dst"))
    return graph.orphan_ends(edges, nodes)


@query("SELECT doc_id AS id, false AS is_stub FROM {fx_docs} WHERE doc_id % 3 > 0 UNION ALL SELECT DISTINCT id, true FROM (SELECT src AS id FROM {fx_edges} UNION SELECT dst FROM {fx_edges}) WHERE id NOT IN (SELECT doc_id FROM {fx_docs} WHERE doc_id % 3 > 0)")
def edge_stub_docs(spark, d):
    return graph.with_stubs(fixture(spark, d, "docs").where("doc_id % 3 > 0").select(F.col("doc_id").alias("id")), fixture(spark, d, "edges"))


@query(f"SELECT src, dst, rel_type, max(ord) AS ord FROM (SELECT src, dst, {_EDGE_TYPE} AS rel_type, ord FROM {{fx_edges}}) WHERE src <> dst GROUP BY 1, 2, 3")
def edge_upsert(spark, d):
    edges = fixture(spark, d, "edges").withColumn("rel_type", F.coalesce(graph.edge_type(F.col("label")), F.lit("UNKNOWN")))
    return graph.upsert_edges(edges, "ord")


@query("""WITH e AS (SELECT o_custkey AS s, o_orderkey + 1000000000 AS t, o_orderpriority AS r FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderpriority FROM orders)
 SELECT DISTINCT s AS seed, t AS id, r AS rel_type FROM e WHERE s % 50 = 0""")
def graph_neighbors(spark, d):
    """Neighbours of every fiftieth customer and order, in both directions."""
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000).alias("dst"), F.col("o_orderpriority").alias("rel_type"))
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).where("id % 50 = 0").distinct()
    return graph.neighbours(ids, edges)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS s, (l_partkey * 7 + l_suppkey) % (SELECT max(p_partkey) FROM part) + 1 AS t FROM lineitem WHERE l_linenumber = 1), r AS
 (SELECT p_partkey AS seed, p_partkey AS id, 0 AS depth FROM part WHERE p_partkey % 50 = 0 UNION SELECT seed, t, depth + 1 FROM r JOIN e ON r.id = e.s WHERE depth < 3)
 SELECT CAST(seed AS BIGINT) AS seed, CAST(id AS BIGINT) AS id, min(depth) AS depth FROM r GROUP BY 1, 2""")
def graph_expand_seeds(spark, d):
    """Every fiftieth part's surroundings: parts named by its lines, three steps far."""
    most = table(spark, d, "part").agg(F.max("p_partkey").alias("most"))
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").join(F.broadcast(most))  # a single row
    edges = lines.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("most") + 1).alias("dst"))
    return graph.reach(table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id")), edges, 3)


@query("SELECT o_orderkey, concat_ws(' > ', r_name, n_name, c_name) AS path, concat_ws(' ', 'Điều ' || o_orderkey, 'khoản ' || o_orderpriority) AS citation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hier_path(spark, d):
    from codexloom.functions.identifiers import citation

    null = F.lit(None).cast("string")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("o_orderkey", F.concat_ws(" > ", "r_name", "n_name", "c_name").alias("path"), citation(F.col("o_orderkey"), F.col("o_orderpriority"), null, F.lit(""), F.lit("?")).alias("citation"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS lines, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses, count(*) AS n FROM lineitem GROUP BY 1")
def hier_nested_doc(spark, d):
    line = F.struct("l_linenumber", "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"), F.array_sort(F.collect_set("l_linestatus")).alias("ss"), F.count("*").alias("n"))
    return rows.select("l_orderkey", F.array_join(F.transform("ls", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_returnflag"])), ",").alias("lines"), F.array_join("ss", ",").alias("statuses"), "n")


@query("SELECT n_nationkey, coalesce(r_name, 'Văn bản') || ' - ' || n_name || ' - ' || coalesce(c.top, '') AS rich_text FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, max(c_name) AS top FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def hier_rich_text(spark, d):
    top = table(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_name").alias("top"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(top, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("n_nationkey", F.concat(F.coalesce("r_name", F.lit("Văn bản")), F.lit(" - "), "n_name", F.lit(" - "), F.coalesce("top", F.lit(""))).alias("rich_text"))


@query("""SELECT 'doc_' || c || '_dieu_' || o || CASE way WHEN 0 THEN '_khoan_2' ELSE '' END AS uid, CAST(CASE WHEN way = 0 AND nth = 2 THEN o ELSE k END AS VARCHAR) AS article, CASE way WHEN 0 THEN CASE nth WHEN 0 THEN '1' WHEN 1 THEN '2' END WHEN 1 THEN '3' WHEN 2 THEN '2' WHEN 3 THEN '1' END AS clause,
  CASE WHEN way IN (1, 3) THEN 'a' END AS point, CASE way WHEN 1 THEN 'Nghị định số 46/2014/NĐ-CP' END AS doc_ref, CASE way WHEN 0 THEN 'internal' WHEN 1 THEN 'external' WHEN 4 THEN 'exception' ELSE 'modification' END AS kind, CASE way WHEN 2 THEN 'sua_doi' WHEN 3 THEN 'bai_bo' END AS action
 FROM (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 5 AS way, o_custkey % 90 + 1 AS k, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [0, 1, 2] ELSE [0] END) AS nth FROM orders)""")
def refs_unified(spark, d):
    """References of every kind in units with places of their own."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    k, way = (c % 90 + 1).cast("string"), o % 5
    says = [("Theo khoản 1, khoản 2 Điều ", " của Luật này và Điều này."), ("Thực hiện theo điểm a khoản 3 Điều ", " Nghị định số 46/2014/NĐ-CP"), ("Sửa đổi khoản 2 Điều ", " như sau"), ("Bãi bỏ điểm a khoản 1 Điều ", ""), ("trừ trường hợp quy định tại Điều ", "")]
    text = F.coalesce(*(F.when(way == i, F.concat(F.lit(a), k, F.lit(b))) for i, (a, b) in enumerate(says)))
    uid = F.concat(F.lit("doc_"), c, F.lit("_dieu_"), o, F.when(way == 0, "_khoan_2").otherwise(""))
    units = table(spark, d, "orders").select(uid.alias("uid"), text.alias("text"), way.isin(2, 3).alias("is_modifying"))
    return refs.extract(units).select("uid", "article", "clause", "point", "doc_ref", "kind", "action")


@query("""SELECT source_uid, CASE way WHEN 0 THEN 'doc_' || c || '_dieu_5' WHEN 1 THEN 'doc_' || k || '_dieu_7_khoan_1' ELSE 'doc_' || k END AS target_uid, CASE way WHEN 0 THEN 'REFERENCES' ELSE 'MODIFIES' END AS rel_type, CASE way WHEN 3 THEN 'Document' ELSE 'Article' END AS target_label, CASE way WHEN 1 THEN 'sua_doi' WHEN 3 THEN 'bai_bo' END AS action
 FROM (SELECT o_orderkey AS o, o_custkey AS c, o_custkey % 100 AS k, o_orderkey % 5 AS way, 'doc_' || o_custkey || '_dieu_' || o_orderkey AS source_uid FROM orders) WHERE way IN (1, 3) OR way = 0 AND o <> 5""")
def relation_prepare(spark, d):
    """Relations into the own document, to others by name, to unknown ones, and of a unit to itself."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    k, way, none = (c % 100).cast("string"), o % 5, F.lit(None).cast("string")
    pick = lambda *xs: F.coalesce(*(F.when(way == i, x) for i, x in enumerate(xs)), none)
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("doc_"), c, F.lit("_dieu_"), o).alias("source_uid"),
        pick(F.lit("Luật này"), F.concat(F.lit("Luật số "), k), F.lit("Luật lạ"), F.concat(F.lit("luật số "), k), F.lit("luật này")).alias("target_doc"),
        pick(F.lit("Điều 5"), F.lit("7"), F.lit("1"), F.lit(""), F.lit("")).alias("target_article"),
        F.when(way == 1, "1").otherwise("").alias("target_clause"),
        F.when(way != 1, "").alias("target_diem"),
        pick(*map(F.lit, ("references", "MODIFY", "references", "modify_text", "references"))).alias("relationship_type"),
        F.when(way == 1, "thay_the").when(way == 3, "het_hieu_luc").alias("modify_action"),
    )
    known = table(spark, d, "part").select(F.concat(F.lit("Luật số "), "p_partkey").alias("name"), F.col("p_partkey").cast("string").alias("doc_id"))
    return refs.relation_rows(rows, known)


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events")
def carry_forward(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("last_signup"))
    return refs.carry_forward(rows, "user_id", "event_id", "last_signup")


@query("""SELECT uid, reason = 'con_hieu_luc' AS is_current, reason FROM (SELECT a.uid, CASE WHEN s.status IN ('Hết hiệu lực toàn bộ', 'Ngưng hiệu lực') THEN 'doc_het_hieu_luc' WHEN a.doc_id IN (SELECT dst FROM {fx_edges} WHERE label = 'THAY_THE') THEN 'superseded'
 WHEN a.doc_id IN (SELECT dst FROM {fx_edges} WHERE label = 'Văn bản quy định hết hiệu lực 1 phần') THEN 'partially_superseded' WHEN a.uid IN (SELECT target_uid FROM {fx_amend} WHERE action = 'Bãi bỏ') THEN 'bai_bo' ELSE 'con_hieu_luc' END AS reason FROM {fx_articles} a LEFT JOIN {fx_status} s USING (doc_id))""")
def validity_priority(spark, d):
    edges = fixture(spark, d, "edges").withColumn("rel_type", graph.edge_type(F.col("label"))).where("ord % 3 = 0 or ord % 9 = 8")
    return effective.validity(fixture(spark, d, "articles"), fixture(spark, d, "status"), edges, fixture(spark, d, "amend"))


@query("SELECT a.uid AS a, b.uid AS b, CASE a.form WHEN 3 THEN 2 ELSE a.form END = CASE b.form WHEN 3 THEN 2 ELSE b.form END AS same FROM {fx_articles} a JOIN {fx_articles} b ON b.doc_id = a.doc_id + 1")
def similarity_structural(spark, d):
    """Each article and the next: as many clauses and points or not."""
    articles = fixture(spark, d, "articles")
    a = articles.select(F.col("uid").alias("a"), (F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("x"))
    return a.join(articles, "doc_id").select("a", F.col("uid").alias("b"), effective.structural_match(F.col("x"), F.col("text")).alias("same"))


@query("SELECT m.uid, m.at, v.text, v.as_of FROM (SELECT DISTINCT o_custkey AS uid, unnest([DATE '1992-06-01', DATE '1997-01-01']) AS at FROM orders) m ASOF LEFT JOIN (SELECT o_custkey AS uid, CAST(o_orderdate AS DATE) AS as_of, max(o_orderpriority) AS text FROM orders GROUP BY 1, 2) v ON v.uid = m.uid AND v.as_of <= m.at")
def as_of_version(spark, d):
    orders = table(spark, d, "orders")
    versions = orders.groupBy(F.col("o_custkey").alias("uid"), F.col("o_orderdate").cast("date").alias("as_of")).agg(F.max("o_orderpriority").alias("text"))
    moments = orders.select(F.col("o_custkey").alias("uid"), F.explode(F.array(*(F.lit(x).cast("date") for x in ("1992-06-01", "1997-01-01")))).alias("at")).distinct()
    return effective.as_of(versions, moments)


#: Families as the SQL engine writes them, by kind; spans that two families share would be counted twice there.
_PII = {
    "cccd": "(?i)(?:CCCD|CMND|Căn\\s*cước\\s*(?:công\\s*dân)?|Chứng\\s*nhân\\s*dân|Số)\\s*(?:số\\s*)?[:\\-]?\\s*\\d{9,12}\\b",
    "mst": "(?i)(?:MST|Mã\\s*số\\s*thuế|Thuế\\s*):\\s*[:\\-]?\\s*\\d{10,13}\\b",
    "phone": "(?:\\+84|0)\\d{8,10}\\b|\\+84[\\s\\-]?\\d{1,3}[\\s\\-]?\\d{3,4}[\\s\\-]?\\d{3,4}\\b",
    "email": "\\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}\\b",
    "bank_account": "(?i)(?:STK|Số\\s*tài\\s*khoản|Tài\\s*khoản|Ngân\\s*hàng|Bank|Account)\\s*[:\\-]?\\s*\\d{10,16}\\b",
    "address": "(?i)(?:đường|phố|ngõ|hẻm|quận|huyện|phường|xã|tỉnh|thành\\s*phố|TP\\.)\\s+[^,.\\n]{3,50}",
}
#: Blanks, digits and their bounds as the SQL engine writes those of Unicode.
_PII = {k: p.replace("\\s", "[\\s\\p{Z}\\x{85}]").replace("[[\\s\\p{Z}\\x{85}]", "[\\s\\p{Z}\\x{85}").replace("\\d", "\\p{Nd}") for k, p in _PII.items()}
#: A phone number may stand inside the digits of an account, whose longer span wins there: it is counted beside them.
_PHONES = "'. 09' || lpad(CAST(doc_id AS VARCHAR), 8, '1') || ', hết'"
#: Each document with a sentence of personal data behind it, so that all families occur; its blanks are no-break blanks in every other one.
_PERSONAL = "replace('. CCCD: 0790' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || ', MST: 03' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '; STK 77' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || ', 09' || lpad(CAST(doc_id AS VARCHAR), 8, '1') || ', tại quận Ba ' || doc_id || ', hết', ' ', CASE WHEN doc_id % 2 = 1 THEN chr(160) ELSE ' ' END)"


def _personal(spark, d):
    pad = lambda n, c="0": F.lpad(F.col("doc_id").cast("string"), n, c)
    more = F.concat(F.lit(". CCCD: 0790"), pad(8), F.lit(", MST: 03"), pad(8), F.lit("; STK 77"), pad(12), F.lit(", 09"), pad(8, "1"), F.lit(", tại quận Ba "), "doc_id", F.lit(", hết"))
    more = F.replace(more, F.lit(" "), F.when(F.col("doc_id") % 2 == 1, F.lit("\u00a0")).otherwise(F.lit(" ")))
    return spread(table(spark, d, "documents").select("doc_id", F.concat("text", more).alias("text")))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all({'u' if k == 'phone' else 't'}, '{p}')) AS {k}" for k, p in _PII.items()) + f" FROM (SELECT doc_id, text || {_PERSONAL} AS t, text || {_PHONES} AS u FROM documents)")
def pii_detect(spark, d):
    """Spans of each family in whole texts."""
    spans = pii.detect(F.col("text"))
    rows = _personal(spark, d).select("doc_id", spans.alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).alias(kind)
    return rows.select("doc_id", *map(count, _PII))


@query("SELECT doc_id, replace('Gửi [REDACTED_EMAIL_2], [REDACTED_EMAIL_1]; CCCD: [REDACTED_CCCD_1], STK [REDACTED_BANK_ACCOUNT_1], gọi [REDACTED_PHONE_1], tại [REDACTED_ADDRESS_1], hết', ' ', CASE WHEN doc_id % 2 = 1 THEN chr(160) ELSE ' ' END) AS redacted, 6 AS n FROM documents")
def pii_redact(spark, d):
    """A sentence of each document: every family leaves its mark, whatever blanks stand between words."""
    number = lambda n, c: F.lpad(F.col("doc_id").cast("string"), n, c)
    text = F.concat(F.lit("Gửi a"), "doc_id", F.lit("@x.vn, b@y.com; CCCD: 0790"), number(8, "0"), F.lit(", STK 77"), number(12, "0"), F.lit(", gọi 09"), number(8, "1"), F.lit(", tại quận Ba "), "source", F.lit(", hết"))
    blank = F.when(F.col("doc_id") % 2 == 1, F.lit("\u00a0")).otherwise(F.lit(" "))
    rows = table(spark, d, "documents").select("doc_id", F.replace(text, F.lit(" "), blank).alias("text"))
    return pii.redact(rows).select("doc_id", "redacted", F.size("pii").alias("n"))


@query(f"SELECT doc_id, md5(text || {_PERSONAL}) AS digest, true AS hidden FROM documents")
def pii_roundtrip(spark, d):
    """Redacted texts hold no account, and their maps bring the whole texts back."""
    rows = pii.redact(_personal(spark, d)).select("doc_id", "redacted", "pii_map")
    account = F.concat(F.lit("STK 77"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return rows.select("doc_id", F.md5(pii.restore(F.col("redacted"), F.col("pii_map"))).alias("digest"), (~F.contains("redacted", account)).alias("hidden"))


@query("SELECT kind, sum(n) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, len(regexp_extract_all(t, '{p}')) AS n FROM (SELECT text || {_PHONES if k == 'phone' else _PERSONAL} AS t FROM documents)" for k, p in _PII.items()) + ") GROUP BY 1")
def pii_type_counts(spark, d):
    found = _personal(spark, d).select(F.explode(pii.detect(F.col("text"))).alias("s"))
    return found.groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT clause_id, CASE WHEN form IN (0, 5) THEN 'supported' WHEN form = 2 THEN 'rental' ELSE 'unsupported' END AS verdict FROM {fx_clauses}")
def guardrail(spark, d):
    return fixture(spark, d, "clauses").select("clause_id", review.guardrail(F.col("text")).alias("verdict"))


@query("""SELECT clause_id, CASE form WHEN 0 THEN 'wage_benefits' WHEN 1 THEN 'penalty_cap' WHEN 3 THEN 'confidentiality' WHEN 5 THEN 'termination' ELSE 'general' END AS risk_type,
 CASE form WHEN 0 THEN 'tiền lương|phụ cấp|bảo hiểm xã hội|người lao động' WHEN 1 THEN 'phạt vi phạm|mức phạt|8%|nghĩa vụ bị vi phạm' WHEN 3 THEN 'bảo mật|thông tin mật|bí mật kinh doanh' WHEN 5 THEN 'chấm dứt hợp đồng|đơn phương chấm dứt|thông báo trước' ELSE '' END AS keywords FROM {fx_clauses}""")
def rewrite_fallback(spark, d):
    return fixture(spark, d, "clauses").select("clause_id", review.rewrite(F.col("text")).alias("r")).select("clause_id", "r.risk_type", F.array_join("r.keywords", "|").alias("keywords"))


@query("SELECT clause_id, CASE WHEN form IN (1, 5) THEN 'non_compliant' WHEN form IN (0, 3) THEN 'compliant_but_restrictive' ELSE 'compliant_and_efficient' END AS class FROM {fx_clauses}")
def policy_class(spark, d):
    law = F.array(F.lit("Người sử dụng lao động trả lương."))
    return fixture(spark, d, "clauses").select("clause_id", review.policy_class(F.col("text"), law, F.col("n_violations")).alias("class"))


@query("SELECT o_custkey, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS risk FROM orders GROUP BY 1")
def risk_rollup(spark, d):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").when(F.col("o_orderpriority") == "3-MEDIUM", "low")
    return review.risk(table(spark, d, "orders").select("o_custkey", name.alias("severity")), "o_custkey", "severity")


@query("""SELECT c.doc_id AS cite_id, c.uid, coalesce(p.uid IS NOT NULL AND c.lang = p.lang AND p.quality = 1, false) AS verified, CASE WHEN p.uid IS NULL THEN 'not_found' WHEN c.lang <> p.lang THEN 'article_mismatch' WHEN p.quality <> 1 THEN 'not_current' ELSE 'ok' END AS reason
 FROM (SELECT doc_id, doc_id - doc_id % 3 AS uid, lang FROM documents) c LEFT JOIN (SELECT doc_id AS uid, lang, quality FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)) p USING (uid)""")
def citation_verify(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    null = F.lit(None).cast("string")
    cites = docs.select(F.col("doc_id").alias("cite_id"), (F.col("doc_id") - F.col("doc_id") % 3).alias("uid"), F.col("lang").alias("article"), null.alias("title"))
    known = docs.join(labels, "doc_id").select(F.col("doc_id").alias("uid"), F.col("lang").alias("article"), null.alias("title"), (F.col("quality") == 1).alias("is_current"))
    return review.verify_citations(cites, known)


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'unknown' END AS status FROM orders GROUP BY 1")
def validity_aggregate(spark, d):
    return review.one_status(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 4 THEN NULL WHEN 3 THEN 0 ELSE 1 END AS n, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || '|y' WHEN 4 THEN NULL WHEN 3 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS names FROM orders")
def json_coerce(spark, d):
    """A fenced array, a wrapped one, one object, an empty array, and no JSON."""
    o = F.col("o_orderkey")
    item = F.concat(F.lit('{"a": "'), o, F.lit('"}'))
    forms = [F.concat(F.lit("```json\n["), item, F.lit(', {"a": "y"}]\n```')), F.concat(F.lit('{"results": ['), item, F.lit("]}")), item, F.lit("[]"), F.concat(F.lit("kein json "), o)]
    raw = F.coalesce(*(F.when(o % 5 == i, x) for i, x in enumerate(forms)))
    rows = table(spark, d, "orders").select(o.alias("id"), raw.alias("raw"))
    items = review.json_items(F.col("raw"), "struct<a: string>")
    return rows.select("id", F.when(items.isNotNull(), F.size(items)).alias("n"), F.array_join(F.transform(items, lambda x: x["a"]), "|").alias("names"))
