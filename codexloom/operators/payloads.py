"""Rows shaped for readers: clipped texts, targets, provisions with their checks, intents, messages, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.functions.text import collapse
from codexloom.operators.lookup import pick


def clipped(text: Column, n: int, mark: str = "") -> Column:
    """The first n signs of a text with single blanks; the mark stands behind them whatever the length."""
    return F.concat(F.substring(collapse(text), 1, n), F.lit(mark))


def targets(docs: DataFrame) -> DataFrame:
    """(id, so_ky_hieu, title, loai_van_ban, match_method) of documents with an id that isn't empty; missing texts but the number are empty."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return docs.where("doc_id is not null and cast(doc_id as string) <> ''").select(F.col("doc_id").cast("string").alias("id"), "so_ky_hieu", *map(empty, ("title", "loai_van_ban", "match_method")))


def provisions(found: DataFrame, checks: DataFrame) -> DataFrame:
    """(query_id, provisions) of found(query_id, rank, uid, document_title, article, effective_text, text, status, display_citation, article_title).

    Each is struct(document_name, article_number, text, verified, citation) in order of rank. A provision is verified if its status says so or if the last of
    checks(uid, at, verified) of its uid does.
    """
    last = pick(checks.where("uid <> ''"), "uid", F.desc("at")).select("uid", F.coalesce("verified", F.lit(False)).alias("_checked"))
    rows = found.join(last, "uid", "left")
    first = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cs), F.lit(""))
    shaped = F.struct(
        "rank",
        F.coalesce("document_title", F.lit("")).alias("document_name"),
        F.coalesce(F.concat(F.lit("Điều "), F.col("article").cast("string")), F.lit("")).alias("article_number"),
        first("effective_text", "text").alias("text"),
        (F.coalesce(F.col("status") == "verified", F.lit(False)) | F.coalesce("_checked", F.lit(False))).alias("verified"),
        first("display_citation", "article_title", "uid").alias("citation"),
    )
    held = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(shaped)).alias("_held"))
    return held.select("query_id", F.transform("_held", lambda p: F.struct(*(p[c].alias(c) for c in ("document_name", "article_number", "text", "verified", "citation")))).alias("provisions"))


def intents(raw: Column, confidence: Column) -> Column:
    """Intents of an answer (array of struct(type, confidence)): a missing type is SEARCH, a missing confidence the answer's, else 0."""
    return F.transform(raw, lambda i: F.struct(F.coalesce(i["type"], F.lit("SEARCH")).alias("type"), F.coalesce(i["confidence"], confidence, F.lit(0.0)).alias("confidence")))


def within_targets(levels: DataFrame, high: float = 0.80, low: float = 0.05) -> DataFrame:
    """(confidence, n, percent, on_target) for high, medium and low of levels(confidence): at least 80 % high and at most 5 % low; without rows all is on target."""
    names = ["high", "medium", "low"]
    counts = levels.agg(F.count("*").alias("_all"), *(F.count_if(F.col("confidence") == c).alias(c) for c in names))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("_all")), F.lit(0.0))
    on = {"high": (F.col("_all") == 0) | (share("high") >= high), "medium": F.lit(True), "low": share("low") <= low}
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("confidence"), F.col(c).alias("n"), F.round(100 * share(c), 1).alias("percent"), on[c].alias("on_target")) for c in names))))
