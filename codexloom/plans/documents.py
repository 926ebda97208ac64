"""Scans, filters, duplicates, HTML, keys, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.functions import identifiers as ids
from codexloom.functions import text as tx
from codexloom.operators import dedup, html, lookup
from codexloom.plans.registry import fixture, query, table


@query("SELECT doc_id AS id, source, n_chars, lang = 'en' AS is_en FROM documents WHERE n_chars >= 500 AND lang IN ('en', 'de')")
def scan_project_filter(spark, d):
    docs = table(spark, d, "documents").where((F.col("n_chars") >= 500) & F.col("lang").isin("en", "de"))
    return docs.select(F.col("doc_id").alias("id"), "source", "n_chars", (F.col("lang") == "en").alias("is_en"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def filter_keyset_semi(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").join(good, "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= DATE '1995-01-01'")
def filter_core_docs(spark, d):
    core = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("date")))
    return core.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'missing' ELSE 'short' END AS why FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR length(coalesce(text, '')) < 500")
def filter_short_or_missing_anti(spark, d):
    docs, known = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct()
    missing = docs.join(known, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("why"))
    short = docs.join(known, "doc_id", "left_semi").where(F.char_length(F.coalesce("text", F.lit(""))) < 500).select("doc_id", F.lit("short").alias("why"))
    return missing.unionByName(short)


@query("SELECT d.doc_id, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)")
def join_metadata_left(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


#: Keys told by the form of each document, not by its number's text.
_NORMAL = """(SELECT doc_id, ord, CASE WHEN way NOT IN (4, 5) THEN CASE way WHEN 0 THEN 'ND' WHEN 1 THEN 'TT' WHEN 2 THEN 'LT' WHEN 3 THEN 'TTLT' WHEN 6 THEN 'UNKNOWN' ELSE 'BL' END || '-' || lpad(num, 3, '0') || '-' || yr END AS key FROM {fx_docs})"""


@query(f"SELECT doc_id, key FROM {_NORMAL}")
def norm_so_ky_hieu(spark, d):
    return fixture(spark, d, "docs").select("doc_id", ids.normal_key(F.col("so_ky_hieu"), F.col("loai_van_ban")).alias("key"))


@query("""SELECT doc_id, CASE way WHEN 0 THEN 'ND' WHEN 1 THEN 'TT' WHEN 2 THEN 'LT' WHEN 3 THEN 'TTLT' WHEN 7 THEN 'LT' ELSE 'UNKNOWN' END AS kind, CASE WHEN way NOT IN (4, 5) THEN lpad(num, 3, '0') END AS number, CASE WHEN way NOT IN (4, 5) THEN yr END AS year,
 CASE way WHEN 0 THEN 'CP' WHEN 1 THEN 'BTC' WHEN 2 THEN 'QH14' WHEN 3 THEN 'NHNN-BTC' WHEN 7 THEN 'QH13' END AS issuer FROM {fx_docs}""")
def parse_so_ky_hieu(spark, d):
    n = ids.parse_number(F.col("so_ky_hieu"))
    return fixture(spark, d, "docs").select("doc_id", n["kind"].alias("kind"), n["number"].alias("number"), n["year"].alias("year"), n["issuer"].alias("issuer"))


@query("SELECT doc_id, CASE way WHEN 5 THEN 'KHÔNG' WHEN 6 THEN 'SỐ' WHEN 4 THEN NULL ELSE num || '/' || yr || CASE way WHEN 0 THEN '/NĐ-CP' WHEN 1 THEN '/TT-BTC' WHEN 2 THEN '/QH14' WHEN 3 THEN '/TTLT-NHNN-BTC' ELSE '/QH13' END END AS stripped FROM {fx_docs}")
def norm_so_hieu_strip(spark, d):
    return fixture(spark, d, "docs").select("doc_id", ids.strip_number(F.col("so_ky_hieu")).alias("stripped"))


@query("SELECT doc_id, CASE way WHEN 0 THEN 'ND' WHEN 1 THEN 'TT' WHEN 2 THEN 'LT' WHEN 3 THEN 'TTLT' WHEN 7 THEN 'LT' WHEN 6 THEN CASE WHEN longer THEN 'LT' END END || '-' || lpad(num, 3, '0') || '-' || yr AS key FROM {fx_docs}")
def norm_hint(spark, d):
    return fixture(spark, d, "docs").select("doc_id", ids.hinted_key(F.col("so_ky_hieu"), F.when(F.col("longer") & (F.col("way") == 6), "Luật")).alias("key"))


@query("""SELECT doc_id, pos, CASE pos WHEN 0 THEN 'luật ' || name || word || ' ' || yr WHEN 1 THEN 'luật ' || name || word ELSE name || word || ' ' || yr END AS alias
 FROM (SELECT *, CASE WHEN longer THEN ' năm' ELSE '' END AS word, CAST(unnest([0, 1, 2]) AS INTEGER) AS pos FROM {fx_docs} WHERE way IN (2, 4, 5))""")
def title_aliases(spark, d):
    docs = fixture(spark, d, "docs").where("loai_van_ban = 'Luật'")
    return docs.select("doc_id", F.posexplode(ids.title_aliases(F.col("title"), F.col("loai_van_ban"))).alias("pos", "alias"))


@query("SELECT doc_id, 'Nghị định ' || name || CASE WHEN longer THEN ' năm ' ELSE ' ' END || yr AS short_title FROM {fx_docs} WHERE way = 0 UNION ALL SELECT doc_id, 'Nghị định ' || name FROM {fx_docs} WHERE way = 0 AND longer")
def short_titles(spark, d):
    docs = fixture(spark, d, "docs").where("loai_van_ban = 'Nghị định'")
    bare = F.when(F.col("doc_id") % 16 == 0, F.substring("title", 11, 1000)).otherwise(F.col("title"))  # some come without their type
    return docs.select("doc_id", F.explode(ids.short_titles(bare, F.col("loai_van_ban"))).alias("short_title"))


@query(f"SELECT key, min(doc_id) AS doc_id FROM {_NORMAL} WHERE key IS NOT NULL GROUP BY 1")
def lookup_keep_first(spark, d):
    return lookup.lookup_table(fixture(spark, d, "docs")).select("key", "doc_id")


@query(f"SELECT key, max(doc_id) AS doc_id FROM {_NORMAL} WHERE key IS NOT NULL GROUP BY 1")
def lookup_keep_last(spark, d):
    return lookup.lookup_table(fixture(spark, d, "docs"), "last").select("key", "doc_id")


@query(f"SELECT k.ref_id, k.key, l.doc_id FROM {{fx_keys}} k LEFT JOIN (SELECT key, min(doc_id) AS doc_id FROM {_NORMAL} WHERE key IS NOT NULL GROUP BY 1) l ON k.key = l.key")
def resolve_exact(spark, d):
    known = lookup.lookup_table(fixture(spark, d, "docs")).select("key", "doc_id")
    return fixture(spark, d, "keys").join(known, "key", "left").select("ref_id", "key", "doc_id")


_RESOLVED = f"""(WITH l AS (SELECT key, min(doc_id) AS doc_id FROM {_NORMAL} WHERE key IS NOT NULL GROUP BY 1),
 e AS (SELECT k.ref_id, k.key, l.doc_id FROM (SELECT * FROM {{fx_keys}} WHERE ref_id % 50 = 0) k LEFT JOIN l ON k.key = l.key),
 f AS (SELECT e.ref_id, arg_min(l.doc_id, levenshtein(e.key, l.key) * 1000000000 + l.doc_id) AS fid, min(levenshtein(e.key, l.key)) AS dist FROM e JOIN l ON levenshtein(e.key, l.key) <= 2 WHERE e.doc_id IS NULL GROUP BY 1),
 s AS (SELECT e.ref_id, min(l.doc_id) AS sid FROM e JOIN l ON split_part(e.key, '-', 1) = split_part(l.key, '-', 1) AND split_part(e.key, '-', 3) = split_part(l.key, '-', 3) GROUP BY 1)
 SELECT e.ref_id, e.key, coalesce(e.doc_id, fid, sid) AS doc_id, CASE WHEN e.doc_id IS NOT NULL THEN 'exact' WHEN fid IS NOT NULL THEN 'fuzzy' WHEN sid IS NOT NULL THEN 'substring' ELSE 'unresolved' END AS method,
 round(CASE WHEN e.doc_id IS NOT NULL THEN 1.0::DOUBLE WHEN fid IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - 0.15::DOUBLE * dist) WHEN sid IS NOT NULL THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END, 6) AS confidence
 FROM e LEFT JOIN f USING (ref_id) LEFT JOIN s USING (ref_id))"""


@query(f"SELECT * FROM {_RESOLVED}")
def resolve_fuzzy(spark, d):
    """A stated set of references against all documents: exact, near, or of the same kind and year."""
    return lookup.resolve(fixture(spark, d, "keys").where("ref_id % 50 = 0"), lookup.lookup_table(fixture(spark, d, "docs")))


@query(f"SELECT count(*) AS total, count(*) FILTER (method = 'exact') AS exact, count(*) FILTER (method = 'fuzzy') AS fuzzy, count(*) FILTER (method = 'substring') AS substring, round(count(*) FILTER (method <> 'unresolved')::DOUBLE / count(*), 6) AS resolution_rate FROM {_RESOLVED}")
def resolve_report(spark, d):
    return lookup.resolve_report(resolve_fuzzy(spark, d))


@query("""WITH d AS (SELECT * FROM {fx_docs}), n AS (SELECT way, num, yr, max(doc_id) AS id FROM d WHERE way IN (0, 1, 2, 3, 7) GROUP BY ALL), t AS (SELECT loai_van_ban, name, max(doc_id) AS id FROM d WHERE NOT longer GROUP BY ALL)
 SELECT d.doc_id AS target_id, CASE WHEN d.doc_id % 3 = 0 THEN n.id WHEN d.doc_id % 3 = 1 THEN t.id END AS doc_id, CASE WHEN d.doc_id % 3 = 0 AND n.id IS NOT NULL THEN 'so_hieu' WHEN d.doc_id % 3 = 1 AND t.id IS NOT NULL THEN 'title' ELSE 'none' END AS match_method
 FROM d LEFT JOIN n USING (way, num, yr) LEFT JOIN t USING (loai_van_ban, name)""")
def match_two_phase(spark, d):
    """Each document looked up by its number in another spelling, by its title without the year, or by neither."""
    docs = fixture(spark, d, "docs")
    turn, numbered = F.col("doc_id") % 3, F.col("way").isin(0, 1, 2, 3, 7)
    number = F.when(turn == 0, F.when(numbered, F.concat(F.lit("0"), F.lower("so_ky_hieu"))).otherwise("xyz")).when(turn == 1, "").otherwise("xyz")
    title = F.when(turn == 1, F.concat_ws(" ", "loai_van_ban", "name")).when(turn == 0, "").otherwise("Không có")
    targets = docs.select(F.col("doc_id").alias("target_id"), number.alias("so_hieu"), title.alias("title"), F.col("loai_van_ban").alias("kind"))
    return lookup.match_two_phase(targets, docs)


_PARTS = "(SELECT p_partkey AS id, split_part(p_type, ' ', 1) || '-' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '-' || CAST(2000 + p_partkey % 20 AS VARCHAR) AS key FROM part)"


@query(f"""WITH known AS (SELECT key, min(id) AS id FROM {_PARTS} GROUP BY 1), refs AS (SELECT id, left(key, length(key) - 6) || 'x' || right(key, 5) AS key FROM {_PARTS} WHERE id % 50 = 0)
 SELECT r.id AS ref_id, arg_min(k.id, (levenshtein(r.key, k.key), k.id)) AS doc_id FROM refs r JOIN known k ON levenshtein(r.key, k.key) <= 2 GROUP BY 1""")
def resolve_blocked_fuzzy(spark, d):
    """A stated set of keys with a wrong sign against all keys."""
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("-", kind, F.lpad(F.col("p_size").cast("string"), 3, "0"), (2000 + F.col("p_partkey") % 20).cast("string")).alias("key"))
    known = part.groupBy("key").agg(F.min("id").alias("doc_id"), F.min("id").alias("ord"))
    refs = part.where("id % 50 = 0").select(F.col("id").alias("ref_id"), F.regexp_replace("key", r".(-\d{4})$", "x$1").alias("key"))
    return lookup.resolve(refs, known).where("method = 'fuzzy'").select("ref_id", "doc_id")


@query("SELECT md5(text) AS digest, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(spark, d):
    return dedup.duplicate_groups(table(spark, d, "documents").select(F.md5("text").alias("digest"), "lang"), ["digest", "lang"])


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_keep_longest(spark, d):
    return dedup.ranked(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], "n_chars", "doc_id").where("keeper_rank = 1").select("doc_id", "source", "n_chars")


@query("SELECT k.doc_id AS kept, m.doc_id AS merged FROM (SELECT *, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) k JOIN (SELECT *, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) m USING (h) WHERE k.rn = 1 AND m.rn > 1")
def dedup_merge_log(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("h"), "doc_id", "n_chars")
    return dedup.merge_log(docs, ["h"], "n_chars", "doc_id", "doc_id")


@query("""SELECT h, arg_min(doc_id, rn) AS doc_id, arg_min(s, rn) FILTER (s IS NOT NULL) AS source, arg_min(l, rn) FILTER (l IS NOT NULL) AS lang FROM
 (SELECT md5(text) AS h, doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS s, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS l, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) GROUP BY 1""")
def dedup_merged_fields(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("h"), "doc_id", "n_chars", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 2 != 0, F.col("lang")).alias("lang"))
    return dedup.merge_groups(docs, ["h"], "n_chars", "doc_id", ["source", "lang"]).select("h", "doc_id", "source", "lang")


@query("SELECT k, arg_max(v, g * 1000000 + doc_id) AS v FROM (SELECT doc_id % 100 AS k, doc_id, n_chars AS v, 0 AS g FROM documents UNION ALL SELECT doc_id % 50, doc_id, -n_chars, 1 FROM documents WHERE lang = 'de') GROUP BY 1")
def keep_last_by_key(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select((F.col("doc_id") % 100).alias("k"), "doc_id", F.col("n_chars").alias("v"))
    new = docs.where("lang = 'de'").select((F.col("doc_id") % 50).alias("k"), "doc_id", (-F.col("n_chars")).alias("v"))
    return dedup.merge_append(old, new, "k", "doc_id").select("k", "v")


_CLEAN = "html"
for _tag in ("script", "style", "dir"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?i)</?(?:font|span)\\b[^>]*>', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?is)<table[^>]*detailcontent[^>]*>(.*?)</table>', '\\1', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?i)<p\\b[^>]*>(?:\\s|&nbsp;|<br\\s*/?>)*</p>', '', 'g')"


def _text_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_CLEAN}) AS digest, length({_text_sql(_CLEAN)}) AS n_text FROM pages")
def html_clean(spark, d):
    c = html.clean(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(c).alias("digest"), F.char_length(html.text_of(c)).cast("long").alias("n_text"))


@query(f"SELECT page_id, round(length({_text_sql(_CLEAN)})::DOUBLE / length({_text_sql('b')}), 6) AS kept_ratio, length({_text_sql(_CLEAN)})::DOUBLE / length({_text_sql('b')}) >= 0.9 AS is_ok FROM (SELECT *, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g') AS b FROM pages)")
def html_verify_ratio(spark, d):
    return html.cleaned(table(spark, d, "pages")).select("page_id", F.round("kept_ratio", 6).alias("kept_ratio"), "is_ok")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) = text AS is_flat, CASE WHEN text = '' THEN 0 ELSE greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 1) END AS n_tokens, substr(md5(substr(text, 1, 200)), 1, 16) AS cache_key, substr(regexp_replace(trim(text), '\\s+', ' ', 'g'), 1, 60) AS title FROM documents")
def text_functions(spark, d):
    t = F.col("text")
    title = F.substring(F.regexp_replace(F.trim(t), r"\s+", " "), 1, 60)
    return table(spark, d, "documents").select("doc_id", (F.trim(F.regexp_replace(t, r"\s+", " ")) == t).alias("is_flat"), tx.token_estimate(t).alias("n_tokens"), tx.cache_key(t).alias("cache_key"), title.alias("title"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '_' || doc_id || '.pdf' WHEN 1 THEN source || '-' || doc_id || '.DOCX' WHEN 2 THEN 'note' || doc_id ELSE 't_' || doc_id || '_.txt' END AS safe,
 CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'md' ELSE 'txt' END AS format FROM documents""")
def file_names(spark, d):
    turn, doc = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = F.when(turn == 0, F.concat("source", F.lit(" "), doc, F.lit(".pdf"))).when(turn == 1, F.concat(F.lit("__"), "source", F.lit("-"), doc, F.lit(".DOCX"))).when(turn == 2, F.concat(F.lit("note"), doc)).otherwise(F.concat(F.lit("t("), doc, F.lit(").txt..")))
    kind = F.when(turn == 2, "text/markdown")
    return table(spark, d, "documents").select("doc_id", tx.safe_filename(name).alias("safe"), tx.source_format(F.rtrim(name, F.lit(".")), kind).alias("format"))


@query("""SELECT o_orderkey AS ref_id, CASE o_orderkey % 3 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 2 THEN k || 'a' END AS article, CASE WHEN o_orderkey % 3 <> 1 THEN CAST(c AS VARCHAR) END AS clause, CASE o_orderkey % 3 WHEN 0 THEN 'đ' END AS point,
 CASE o_orderkey % 3 WHEN 1 THEN k || '/2020/NĐ-CP' END AS so_ky_hieu, CASE o_orderkey % 3 WHEN 0 THEN '2020' END AS year FROM (SELECT o_orderkey, o_orderkey % 400 + 1 AS k, o_custkey % 30 + 1 AS c FROM orders)""")
def direct_reference_parse(spark, d):
    o = F.col("o_orderkey")
    k, c = (o % 400 + 1).cast("string"), (F.col("o_custkey") % 30 + 1).cast("string")
    text = F.when(o % 3 == 0, F.concat(F.lit("Điều "), k, F.lit(" khoản\u00a0"), c, F.lit(" điểm đ Luật Doanh nghiệp 2020"))).when(o % 3 == 1, F.concat(F.lit("theo Nghị định "), k, F.lit("/2020/NĐ-CP"))).otherwise(F.concat(F.lit("khoản "), c, F.lit(" Điều "), k, F.lit("a")))
    return table(spark, d, "orders").select(o.alias("ref_id"), ids.parse_reference(text).alias("r")).select("ref_id", "r.*")


@query("""SELECT o_orderkey AS id, 'doc_' || o_custkey || CASE WHEN a IS NULL THEN '' ELSE '_dieu_' || a || CASE WHEN k IS NULL THEN '' ELSE '_khoan_' || k || '_diem_b' END END AS uid, CAST(o_custkey AS VARCHAR) AS doc, CAST(a AS VARCHAR) AS dieu, CASE WHEN a IS NOT NULL THEN CAST(k AS VARCHAR) END AS khoan, CASE WHEN a IS NOT NULL AND k IS NOT NULL THEN 'b' END AS diem
 FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey END AS a, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 9 END AS k FROM orders)""")
def uid_round_trip(spark, d):
    """Uids built from parts in words, with missing parts, and taken apart again."""
    o = F.col("o_orderkey")
    article = F.when(o % 4 == 0, F.concat(F.lit("Điều "), o)).when(o % 4 == 1, o.cast("string")).when(o % 4 == 2, "none")
    clause = F.when(o % 3 > 0, F.concat(F.lit("khoản "), o % 9)).otherwise("null")
    uid = ids.build_uid(F.col("o_custkey"), article, clause, F.lit("b"))
    rows = table(spark, d, "orders").select(o.alias("id"), uid.alias("uid"))
    return rows.select("id", "uid", *(ids.uid_part(F.col("uid"), x).alias(x) for x in ("doc", "dieu", "khoan", "diem")))
