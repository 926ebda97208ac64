"""Citations: parsed from text, read from a model's output, filtered by what was retrieved, verified, and put into prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.functions.identifiers import blank_to_null, clean_optional, first_of

#: Điều N, then optional khoản, điểm, type of document and its number. Fixed values.
CITATION = r"(?iuU)Điều\s+(\d+)(?:\s+khoản\s+(\d+))?(?:\s+điểm\s+([a-z]))?(?:\s+(Luật|Bộ luật|Nghị định|Thông tư))?(?:\s+([\w\-/]+))?"


def parse(text: Column) -> Column:
    """struct(article, clause, point, doc_type, so_ky_hieu) of the first citation in a text; missing parts are null."""
    part = lambda g: blank_to_null(F.regexp_extract(text, CITATION, g))
    return F.struct(part(1).try_cast("int").alias("article"), part(2).try_cast("int").alias("clause"), part(3).alias("point"), part(4).alias("doc_type"), part(5).alias("so_ky_hieu"))


def from_json(raw: Column) -> Column:
    """Citations of a model's output, in either spelling of their keys."""
    fields = ("uid", "segment_uid", "segmentUid", "display_text", "displayText", "text", "document_title", "documentTitle", "document", "article", "clause", "point")
    items = F.from_json(F.get_json_object(raw, "$.citations"), f"array<struct<{', '.join(f'{c}: string' for c in fields)}>>")
    some = F.coalesce(items, F.array().cast(f"array<struct<{', '.join(f'{c}: string' for c in fields)}>>"))
    return F.transform(
        some,
        lambda c: F.struct(
            first_of(c["uid"], c["segment_uid"], c["segmentUid"]).alias("uid"),
            first_of(c["display_text"], c["displayText"], c["text"]).alias("display_text"),
            first_of(c["document_title"], c["documentTitle"], c["document"]).alias("document_title"),
            *(clean_optional(c[x]).alias(x) for x in ("article", "clause", "point")),
        ),
    )


def allowed(citations: DataFrame, provisions: DataFrame) -> DataFrame:
    """citations(answer_id, pos, uid) that may stay: their uid is among the answer's provisions(answer_id, rank, uid).

    One without uid gets that of the only provision, if there is one only; an answer left without citations cites its first provision.
    """
    first = provisions.where("uid is not null").groupBy("answer_id").agg(F.count("*").alias("n"), F.min_by("uid", "rank").alias("first"))
    known = provisions.select("answer_id", "uid").distinct().withColumn("known", F.lit(True))
    rows = citations.join(known, ["answer_id", "uid"], "left").join(first, "answer_id", "left")
    kept = rows.where("uid is null or known").select("answer_id", "pos", F.coalesce("uid", F.when(F.col("n") == 1, F.col("first"))).alias("uid"))
    bare = first.join(kept.select("answer_id").distinct(), "answer_id", "left_anti").select("answer_id", F.lit(0).cast(citations.schema["pos"].dataType).alias("pos"), F.col("first").alias("uid"))
    return kept.unionByName(bare)


def only_cited(provisions: DataFrame, citations: DataFrame) -> DataFrame:
    """provisions(answer_id, uid, ...) that the answer cites."""
    return provisions.join(citations.select("answer_id", "uid").distinct(), ["answer_id", "uid"], "left_semi")


def verify_text(citations: DataFrame, articles: DataFrame, docs: DataFrame) -> DataFrame:
    """(cite_id, article_uid, is_current, verified, reason) of citations(cite_id, text) without uid.

    With a number: the article of that document, articles(uid, doc_id, idx, is_current), docs(doc_id, so_ky_hieu); without one: any
    article of that index, the smallest uid.
    """
    p = parse(F.col("text"))
    rows = citations.select("cite_id", p["article"].alias("article"), p["so_ky_hieu"].alias("so_ky_hieu"))
    known = articles.select("doc_id", F.col("idx").try_cast("int").alias("article"), F.col("uid").alias("_uid"), F.col("is_current").alias("_current"))
    one = F.min(F.struct("_uid", "_current"))
    numbered = known.join(docs.select("doc_id", "so_ky_hieu"), "doc_id").groupBy("article", "so_ky_hieu").agg(one.alias("_exact"))
    anywhere = known.groupBy("article").agg(one.alias("_any"))
    out = rows.join(numbered, ["article", "so_ky_hieu"], "left").join(anywhere, "article", "left")
    hit = F.when(F.col("so_ky_hieu").isNotNull(), F.col("_exact")).otherwise(F.col("_any"))
    reason = F.when(F.coalesce("article", F.lit(0)) == 0, "unparsed").when(hit.isNull(), "not_found").otherwise("ok")
    return out.select("cite_id", hit["_uid"].alias("article_uid"), hit["_current"].alias("is_current"), (reason == "ok").alias("verified"), reason.alias("reason"))


def verify_uid(citations: DataFrame, ladders: DataFrame) -> DataFrame:
    """(cite_id, article_uid, is_current, verified, reason) of citations(cite_id, uid, article, clause, point, title) against what their uid is.

    ladders(uid, article_uid, article, clause, point, title, is_current). A part that the citation states must be that of the uid, and
    one title must hold the other.
    """
    k = ladders.select("uid", "article_uid", *(F.col(c).alias(f"_{c}") for c in ("article", "clause", "point", "title")), "is_current", F.lit(True).alias("_known"))
    rows = citations.join(k, "uid", "left")
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    wrong = lambda c: F.col(c).isNotNull() & (text(c) != text(f"_{c}"))
    titled = (text("title") != "") & (text("_title") != "") & ~(F.contains(text("_title"), text("title")) | F.contains(text("title"), text("_title")))
    reason = F.when(text("uid") == "", "missing_uid").when(F.col("_known").isNull(), "not_found")
    for c in ("article", "clause", "point"):
        reason = reason.when(wrong(c), f"{c}_mismatch")
    reason = reason.when(titled, "title_mismatch").otherwise("ok")
    return rows.select("cite_id", F.when(F.col("_known"), F.col("article_uid")).alias("article_uid"), F.when(F.col("_known"), F.coalesce("is_current", F.lit(True))).alias("is_current"), (reason == "ok").alias("verified"), reason.alias("reason"))


def verify(citations: DataFrame, ladders: DataFrame, articles: DataFrame, docs: DataFrame) -> DataFrame:
    """citations(cite_id, uid, text, article, clause, point, title): by uid where there is one, else by text."""
    has = F.coalesce(blank_to_null(F.col("uid")).isNotNull(), F.lit(False))
    return verify_uid(citations.where(has), ladders).unionByName(verify_text(citations.where(~has), articles, docs))


def with_verification(citations: DataFrame, verified: DataFrame) -> DataFrame:
    """citations(uid, ...) with verified of verified(segment_uid, article_uid, verified): by the segment's uid, or the article's where it has none."""
    key = F.coalesce(blank_to_null(F.col("segment_uid")), F.col("article_uid"))
    known = verified.select(key.alias("uid"), F.col("verified").alias("_v")).groupBy("uid").agg(F.bool_and("_v").alias("verified"))
    return citations.join(known, "uid", "left")


def all_verified(citations: DataFrame) -> DataFrame:
    """(answer_id, all_verified, any_verified): both false without citations that were checked."""
    return citations.groupBy("answer_id").agg(F.coalesce(F.bool_and(F.coalesce("verified", F.lit(False))), F.lit(False)).alias("all_verified"), F.coalesce(F.bool_or("verified"), F.lit(False)).alias("any_verified"))


def zipped(violations: Column, checks: Column) -> Column:
    """Violations and their checks by position, as far as both go."""
    n = F.least(F.size(violations), F.size(checks))
    return F.zip_with(F.slice(violations, F.lit(1), n), F.slice(checks, F.lit(1), n), lambda v, c: F.struct(v.alias("violation"), c.alias("check")))


def by_title(citations: DataFrame, default: str = "Văn bản pháp luật") -> DataFrame:
    """(answer_id, title, uids): citations of an answer by document title; those without one go under a default."""
    title = F.coalesce(blank_to_null(F.trim("title")), F.lit(default))
    return citations.groupBy("answer_id", title.alias("title")).agg(F.array_sort(F.collect_list("uid")).alias("uids"))


def provision_block(provisions: Column) -> Column:
    """A numbered block of provisions (structs citation, uid, title, validity, text) for a prompt."""
    line = lambda p, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), p["citation"], F.lit("\n   uid: "), p["uid"], F.lit("\n   document: "), p["title"], F.lit("\n   validity_signal: "), p["validity"], F.lit("\n   "), p["text"], F.lit("\n"))
    return F.array_join(F.transform(provisions, line), "")


def amendment_lines(amendments: Column, none: str = "Không có lịch sử sửa đổi.") -> Column:
    """One line for each amendment (structs source, action, date), or a sentence where there are none."""
    line = lambda a: F.concat(F.lit("- "), F.coalesce(a["source"], F.lit("")), F.lit(": "), F.coalesce(a["action"], F.lit("")), F.lit(" ("), F.coalesce(a["date"], F.lit("")), F.lit(")"))
    return F.when(F.size(amendments) > 0, F.array_join(F.transform(amendments, line), "\n")).otherwise(none)


def prompt_context(provisions: DataFrame) -> DataFrame:
    """(answer_id, provisions, effective_text) of provisions(answer_id, rank, uid, text, effective_text): JSON, and the texts apart by blank lines."""
    text = first_of(F.col("effective_text"), F.col("text"))
    rows = provisions.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("rank", "uid", text.alias("text")))).alias("ps"))
    return rows.select("answer_id", F.to_json(F.transform("ps", lambda p: F.struct(p["uid"].alias("uid"), p["text"].alias("text")))).alias("provisions"), F.array_join(F.filter(F.transform("ps", lambda p: p["text"]), lambda t: t.isNotNull()), "\n\n").alias("effective_text"))
