"""Question answering over citations: planning, references in queries, direct lookup, validity, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.functions.identifiers import any_of, blank_to_null, citation, clean_optional, literal_map
from codexloom.sources.shared import cut, dealt

#: Intents by what they need. Fixed values.
DIRECT, HYBRID, VALIDITY, COMPARISON = ["LOOKUP"], ["TOPIC", "SEARCH", "SCENARIO", "CHECKLIST", "NUMERIC"], ["VALIDITY"], ["COMPARISON"]
#: Names of strategies, and what a query may require. Fixed values.
STRATEGIES = {
    "lookup": "direct_lookup",
    "direct": "direct_lookup",
    "direct_lookup": "direct_lookup",
    "vector_search": "hybrid_search",
    "semantic_search": "hybrid_search",
    "graph_traversal": "hybrid_search",
    "hybrid_search": "hybrid_search",
    "search": "hybrid_search",
    "topic": "hybrid_search",
    "validity": "validity_check",
    "validity_check": "validity_check",
    "currentity": "validity_check",
    "comparison": "comparison",
}
REQUIREMENTS = ["legal_provision", "effective_text", "document_metadata", "conversation_context", "contract_context", "citation_validation", "amendment_history"]
#: Words that tell a requirement, asked for in this order. Fixed values.
REQUIREMENT_WORDS = [
    ("conversation_context", ["hội thoại", "context", "ngữ cảnh"]),
    ("contract_context", ["hợp đồng"]),
    ("effective_text", ["hiệu lực", "sửa đổi", "bãi bỏ", "amend"]),
    ("document_metadata", ["cấu trúc", "metadata", "văn bản", "document"]),
    ("citation_validation", ["trích dẫn", "citation"]),
    ("amendment_history", ["lịch sử sửa đổi", "amendment"]),
    ("legal_provision", ["quy định", "provision", "điều", "khoản", "điểm"]),
]
#: What makes a query name a place in a document. Fixed values.
CITED = r"(?iuU)\bđiều\s+\d+"
SIGNAL = r"(?iuU)(?:\bđiều\s+(?:\d+|thứ|đầu|cuối|này|đó)\b|\bkhoản\b|\bđiểm\b)"
HAS_PLACE = r"(?iuU)\b(điều|khoản|điểm)\b"
#: Classes of queries by words, asked for in this order. Fixed values.
CLASSES = [
    ("chitchat", ["xin chào", "hello", "hi ", "chào bạn"]),
    ("contract_review", ["review", "hợp đồng", "upload"]),
    ("validity_question", ["còn hiệu lực", "hết hiệu lực", "validity"]),
    ("comparison_question", ["so sánh", "khác nhau", "comparison"]),
    ("topic_question", ["quy định về", "như thế nào", "quy định gì"]),
]
#: Phrases of follow-up questions and the entity that each means; the last means all. Fixed values.
FOLLOW_UPS = [("điều khoản đó", "clause"), ("điều đó", "article"), ("luật này", "document"), ("văn bản này", "document"), ("nghị định này", "document"), ("hợp đồng trên", "contract"), ("hợp đồng này", "contract")]
#: Number forms in queries, and the words before a document's name. Fixed values.
NUMBER = r"(?iuU)\b((?:LT|ND|TT|TTLT|BL)-\d{2,3}-\d{4}|\d+/\d{4}/[A-ZĐ0-9\-]+)\b"
HINT = r"(?iuU)(Luật|Bộ luật|Nghị định|Thông tư)\s+(.+?)(?:\s+\d{4}|\s+\d+/\d{4}/|\s+Điều|\s+khoản|$)"


def strategy(raw: Column, intent: Column, query: Column, article: Column | None = None) -> Column:
    """The strategy of a planned query: its name's, overruled by the intent; a lookup without a place is a search."""
    kind, name = F.upper(intent), F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    guess = F.when(kind.isin(*DIRECT), "direct_lookup").when(kind.isin(*VALIDITY), "validity_check").when(kind.isin(*COMPARISON), "comparison").otherwise("hybrid_search")
    named = F.coalesce(literal_map(STRATEGIES)[name], guess)
    cited = F.regexp_like(query, F.lit(CITED)) | F.regexp_like(query, F.lit(SIGNAL))
    if article is not None:
        cited = cited | (F.coalesce(article.cast("string"), F.lit("")) != "")
    return (
        F.when(kind.isin(*HYBRID) | (named == "hybrid_search"), "hybrid_search")
        .when(kind.isin(*DIRECT), F.when(cited, "direct_lookup").otherwise("hybrid_search"))
        .when(kind.isin(*VALIDITY), "validity_check")
        .when(kind.isin(*COMPARISON), "comparison")
        .otherwise(named)
    )


def requirements(raw: Column, intent: Column, chosen: Column) -> Column:
    """What a query requires: known names, else names told by words, each once, then the defaults of its intent."""

    def one(r: Column) -> Column:
        t = F.lower(F.trim(r))
        by_word = F.coalesce(*(F.when(any_of(t, words), F.lit(name)) for name, words in REQUIREMENT_WORDS))
        return F.when(t == "", F.lit(None)).when(t.isin(*REQUIREMENTS), t).otherwise(by_word)

    told = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), one), lambda x: x.isNotNull())
    lits = lambda *xs: F.array(*map(F.lit, xs))
    valid = F.upper(intent).isin(*VALIDITY) | (chosen == "validity_check")
    defaults = F.when(valid, lits("legal_provision", "document_metadata", "effective_text")).otherwise(lits("legal_provision", "effective_text"))
    return F.array_distinct(F.concat(told, defaults))


def query_text(article: Column, document: Column, number: Column, topic: Column, year: Column) -> Column:
    """A query from extracted entities: article, then document, number or topic, then year."""
    some = lambda c: blank_to_null(c.cast("string"))
    return F.concat_ws(" ", F.concat(F.lit("Điều "), some(article)), F.coalesce(some(document), some(number), some(topic)), some(year))


def classify(query: Column) -> Column:
    q = F.lower(query)
    found = [F.when(any_of(q, words), F.lit(name)) for name, words in CLASSES]
    return F.coalesce(*found, F.when(F.contains(q, F.lit("điều")) & F.contains(q, F.lit("luật")), F.lit("lookup_dieu")), F.lit("fallback"))


def certainty(confidence: Column, clear: float = 0.7, known: float = 0.4) -> Column:
    """unknown, clarify or clear."""
    return F.when(confidence < known, "unknown").when(confidence < clear, "clarify").otherwise("clear")


def follow_up(query: Column, entities: Column) -> Column:
    """The entity (of a map) that a follow-up question means: that of the first phrase in it; a map of all where it is unknown."""
    q = F.lower(query)
    kind = F.coalesce(*(F.when(F.contains(q, F.lit(w)), F.lit(k)) for w, k in FOLLOW_UPS))
    one = F.map_filter(entities, lambda k, v: k == kind)
    return F.when(F.size(one) > 0, one).otherwise(entities)


def intent_fields(raw: Column) -> Column:
    """struct(domain, confidence, intents, sub_queries) of a model's JSON output with the default of each missing field."""
    schema = "struct<domain: string, confidence: double, intents: array<struct<type: string, confidence: double>>, sub_queries: array<struct<intent: string, query: string, retrieval_strategy: string, requires: array<string>>>>"
    r = F.from_json(raw, schema)
    intents = F.transform(F.coalesce(r["intents"], F.array().cast("array<struct<type: string, confidence: double>>")), lambda i: F.struct(F.coalesce(i["type"], F.lit("LOOKUP")).alias("type"), F.coalesce(i["confidence"], F.lit(0.5)).alias("confidence")))
    subs = F.transform(
        F.coalesce(r["sub_queries"], F.array().cast("array<struct<intent: string, query: string, retrieval_strategy: string, requires: array<string>>>")),
        lambda s: F.struct(F.upper(F.coalesce(s["intent"], F.lit("LOOKUP"))).alias("intent"), s["query"].alias("query"), F.coalesce(s["retrieval_strategy"], F.lit("direct_lookup")).alias("strategy")),
    )
    return F.struct(F.coalesce(r["domain"], F.lit("QA")).alias("domain"), F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence"), intents.alias("intents"), subs.alias("sub_queries"))


def reference(text: Column) -> Column:
    """struct(article, clause, point, so_ky_hieu, year, document_hint) of a query in words; missing parts are null."""
    first = lambda p: blank_to_null(F.regexp_extract(text, p, 1))
    hint = F.concat_ws(" ", blank_to_null(F.regexp_extract(text, HINT, 1)), blank_to_null(F.regexp_extract(text, HINT, 2)))
    return F.struct(
        first(r"(?iuU)điều\s+(\d+)").alias("article"),
        first(r"(?iuU)khoản\s+(\d+)").alias("clause"),
        F.lower(first(r"(?iuU)điểm\s+([a-zA-Z])")).alias("point"),
        first(NUMBER).alias("so_ky_hieu"),
        first(r"(?U)\b(20\d{2}|19\d{2})\b").alias("year"),
        blank_to_null(hint).alias("document_hint"),
    )


def from_rewrite(raw: Column, canonical: Column) -> Column:
    """A rewritten reference: each field of raw (a struct) where it says something, else what its canonical citation says."""
    parsed = reference(F.coalesce(canonical, F.lit("")))
    field = lambda c: F.coalesce(clean_optional(raw[c].cast("string")), parsed[c])
    return F.struct(F.coalesce(raw["article"].try_cast("int").cast("string"), parsed["article"]).alias("article"), field("clause").alias("clause"), F.lower(field("point")).alias("point"), *(field(c).alias(c) for c in ("so_ky_hieu", "year", "document_hint")))


def canonical(ref: Column) -> Column:
    """điểm p khoản k Điều a document year; the year only where the rest doesn't hold it."""
    named = lambda word, c: F.concat(F.lit(word + " "), blank_to_null(ref[c]))
    rest = F.concat_ws(" ", named("điểm", "point"), named("khoản", "clause"), named("Điều", "article"), F.coalesce(blank_to_null(ref["document_hint"]), blank_to_null(ref["so_ky_hieu"])))
    year = blank_to_null(ref["year"])
    return F.concat_ws(" ", blank_to_null(rest), F.when(~F.contains(rest, year), year))


def number_key(raw: Column, hint: Column) -> Column:
    """PREFIX-number-year of a number as queries write it, its kind told by a hint, then by its issuer; other text in upper case."""
    t = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    pattern = r"(\d+)\s*/\s*(\d{4})\s*/\s*([A-ZĐ0-9\-]+)"
    part = lambda g: F.regexp_extract(t, pattern, g)
    issuer, h = part(3), F.lower(F.coalesce(hint, F.lit("")))
    other = F.coalesce(blank_to_null(F.regexp_replace(issuer, "[^A-ZĐ0-9]+", "")), F.lit("UNKNOWN"))
    prefix = (
        F.when(h.contains("nghị định") | issuer.contains("NĐ"), "ND")
        .when(h.contains("thông tư liên tịch") | issuer.contains("TTLT"), "TTLT")
        .when(h.contains("thông tư") | issuer.startswith("TT"), "TT")
        .when(h.contains("luật") | issuer.startswith("QH"), "LT")
        .otherwise(other)
    )
    return F.when(part(1) == "", t).otherwise(F.concat_ws("-", prefix, F.lpad(part(1), F.greatest(F.char_length(part(1)), F.lit(3)), F.lit("0")), part(2)))


def grams(text: Column, n: Column) -> Column:
    """The distinct strings of n signs in a text."""
    last = F.char_length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def holders(titles: DataFrame, hints: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, _hint) of titles(doc_id, _t) that hold a hint of hints(_hint), distinct and not empty.

    A title that holds a hint holds its string of n signs that fewest titles have (all of it, if it is shorter): titles and hints
    meet in an equi join on that string, and only what they share it with is compared.
    """
    sizes = [F.lit(k) for k in range(1, n + 1)]
    own = hints.select("_hint", F.explode(grams(F.col("_hint"), F.least(F.char_length("_hint"), F.lit(n)))).alias("_g"))
    held = titles.select("doc_id", "_t", F.explode(F.concat(*(grams(F.col("_t"), k) for k in sizes))).alias("_g"))
    held = held.join(own.select("_g").distinct(), "_g", "left_semi")
    often = held.groupBy("_g").agg(F.count("*").alias("_n"))
    rarest = own.join(often, "_g", "left").groupBy("_hint").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_r"))
    return held.join(rarest.select("_hint", F.col("_r._g").alias("_g")), "_g").where(F.contains("_t", "_hint")).select("doc_id", "_hint")


def resolve_documents(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs(query_id, doc_id, so_ky_hieu, document_hint) with target_doc and how: by id, else by number in one of its spellings, else by title.

    docs(doc_id, so_ky_hieu, key, title). Two equi joins and, for references with neither, titles that hold the hint.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    given = refs.withColumn("_id", blank_to_null(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_number", low("so_ky_hieu")).withColumn("_key", F.lower(number_key(F.col("so_ky_hieu"), F.col("document_hint"))))
    by_id = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("doc_id").alias("_by_id"))
    spelt = docs.select("doc_id", F.explode(F.array_distinct(F.array(low("so_ky_hieu"), low("key")))).alias("_s")).where("_s <> ''").groupBy("_s").agg(F.min("doc_id").alias("_d"))
    out = given.join(by_id, "_id", "left").join(spelt.withColumnsRenamed({"_s": "_number", "_d": "_by_number"}), "_number", "left").join(spelt.withColumnsRenamed({"_s": "_key", "_d": "_by_key"}), "_key", "left")
    out = out.withColumn("_found", F.when(F.col("_id").isNotNull(), F.col("_by_id")).otherwise(F.coalesce("_by_number", "_by_key")))
    hints = out.where(F.col("_found").isNull() & F.col("_id").isNull() & (low("document_hint") != "")).select(low("document_hint").alias("_hint")).distinct()
    titles = docs.groupBy(low("title").alias("_t")).agg(F.min("doc_id").alias("doc_id"))  # the smallest of equal titles would win anyway
    by_title = holders(titles.select("doc_id", "_t"), hints).groupBy("_hint").agg(F.min("doc_id").alias("_by_title"))
    out = out.withColumn("_hint", low("document_hint")).join(by_title, "_hint", "left")
    how = F.when(F.col("_id").isNotNull(), F.when(F.col("_by_id").isNotNull(), "doc_id")).when(F.col("_found").isNotNull(), "so_ky_hieu").when(F.col("_by_title").isNotNull(), "title")
    title = F.when(F.col("_id").isNull(), F.col("_by_title"))
    return out.select(*refs.columns, F.coalesce("_found", title).alias("target_doc"), F.coalesce(how, F.lit("none")).alias("how"))


def direct_lookup(refs: DataFrame, articles: DataFrame, clauses: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, uid, segment_type, text, display_citation, is_current) of what refs(query_id, target_doc, article, clause, point) name.

    An article alone gives it, its clauses and their points; with a clause, that clause and its points; with a point, that
    point. articles(uid, doc_id, idx, title, text, is_current), clauses(uid, parent, idx, text), points(uid, parent, letter, text).
    """
    a = articles.select(F.col("uid").alias("a_uid"), F.col("doc_id").alias("target_doc"), F.col("idx").cast("string").alias("article"), F.col("title").alias("a_title"), F.col("text").alias("a_text"), "is_current")
    hit = cut(refs.where("article is not null").join(a, ["target_doc", "article"]))  # three branches read it
    c = clauses.select(F.col("uid").alias("c_uid"), F.col("parent").alias("a_uid"), F.col("idx").cast("string").alias("c_idx"), F.col("text").alias("c_text"))
    p = points.select(F.col("uid").alias("p_uid"), F.col("parent").alias("c_uid"), F.lower("letter").alias("p_idx"), F.col("text").alias("p_text"))
    null = F.lit(None).cast("string")
    whole = hit.where("clause is null and point is null").select("query_id", F.col("a_uid").alias("uid"), F.lit("Article").alias("segment_type"), F.col("a_text").alias("text"), "a_title", "article", null.alias("k"), null.alias("l"), "is_current")
    in_clause = cut(dealt(hit.drop("a_text"), "a_uid").join(c, "a_uid").where("clause is null or clause = c_idx"))
    of_clause = in_clause.where("point is null").select("query_id", F.col("c_uid").alias("uid"), F.lit("Clause").alias("segment_type"), F.col("c_text").alias("text"), "a_title", "article", F.col("c_idx").alias("k"), null.alias("l"), "is_current")
    of_point = dealt(in_clause, "c_uid").join(p, "c_uid").where("point is null or lower(point) = p_idx").select("query_id", F.col("p_uid").alias("uid"), F.lit("Point").alias("segment_type"), F.col("p_text").alias("text"), "a_title", "article", F.col("c_idx").alias("k"), F.col("p_idx").alias("l"), "is_current")
    found = whole.unionByName(of_clause).unionByName(of_point)
    return found.select("query_id", "uid", "segment_type", "text", citation(F.col("article"), F.col("k"), F.col("l"), F.col("a_title"), F.col("uid")).alias("display_citation"), F.coalesce("is_current", F.lit(True)).alias("is_current"))


def validity_signal(is_current: Column) -> Column:
    """verified for what the graph says is current, else likely_current."""
    return F.when(F.coalesce(is_current, F.lit(True)), "verified").otherwise("likely_current")


def validity_of_candidate(signal: Column, n_modifies: Column) -> Column:
    """likely_current where a change is known, else unknown."""
    return F.when((signal == "possibly_modified") | (n_modifies > 0), "likely_current").otherwise("unknown")


def routed(plans: DataFrame, direct: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Provisions of plans(query_id, sub_id, strategy): found rows (sub_id, uid, score, validity) of the way that the strategy takes.

    A lookup takes direct rows; a validity check as well, and one that resolves to nothing gives a row without uid whose validity is
    unknown; all others, comparisons too, take hybrid rows.
    """
    columns = ["query_id", "sub_id", "strategy", "uid", "score", "validity"]
    by = lambda names: plans.where(F.col("strategy").isin(*names))
    looked = by(["direct_lookup"]).join(direct, "sub_id").select(columns)
    unsure = F.when(F.col("validity") == "verified", F.col("validity")).otherwise("unknown")
    checked = by(["validity_check"]).join(direct, "sub_id", "left").withColumn("validity", F.coalesce(unsure, F.lit("unknown"))).withColumn("uid", F.coalesce("uid", F.lit(""))).withColumn("score", F.coalesce("score", F.lit(0.0))).select(columns)
    searched = plans.where(~F.col("strategy").isin("direct_lookup", "validity_check")).join(hybrid, "sub_id").select(columns)
    return looked.unionByName(checked).unionByName(searched)


def dedupe_and_rank(provisions: DataFrame, top: int = 5) -> DataFrame:
    """Of provisions(query_id, uid, strategy, score) the best of each uid, ranked; at most `top` unless some came by lookup or check."""
    best = provisions.groupBy("query_id", "uid").agg(F.max_by(F.struct("strategy", "score"), F.struct("score", "strategy")).alias("b")).select("query_id", "uid", "b.*")
    whole = F.bool_or(F.col("strategy").isin("direct_lookup", "validity_check")).over(Window.partitionBy("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uid"))
    return best.withColumn("rank", rank).withColumn("_whole", whole).where(F.col("_whole") | (F.col("rank") <= top)).drop("_whole")


def statuses(plans: DataFrame, provisions: DataFrame, errors: DataFrame) -> DataFrame:
    """(query_id, n, status): ok with provisions, error where all that came were errors(query_id), else no_results."""
    n = provisions.groupBy("query_id").agg(F.count("*").alias("n"))
    failed = errors.select("query_id", F.lit(True).alias("_failed")).distinct()
    out = plans.select("query_id").distinct().join(n, "query_id", "left").join(failed, "query_id", "left")
    return out.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "ok").when(F.col("_failed"), "error").otherwise("no_results").alias("status"))
