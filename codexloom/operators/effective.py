"""Effective text: amendments folded into a base text in order of date, validity, agreement, as-of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.functions.compare import char_similarity, unified_diff
from codexloom.functions.identifiers import literal_map
from codexloom.functions.text import numbered_structure
from codexloom.sources.shared import cut

#: Status words of documents. Fixed values.
STATUS = {"Còn hiệu lực": "con_hieu_luc", "Hết hiệu lực toàn bộ": "het_hieu_luc", "Hết hiệu lực một phần": "het_hieu_luc_mot_phan", "Ngưng hiệu lực": "ngung_hieu_luc"}
#: Spellings of actions. Fixed values.
ACTIONS = {"sửa đổi": "sua_doi", "bổ sung": "bo_sung", "thay thế": "thay_the", "bãi bỏ": "bai_bo", "hết hiệu lực": "het_hieu_luc"}
REPEALED = "[Đã bãi bỏ]"
VOID = ("bai_bo", "het_hieu_luc")


def status(raw: Column) -> Column:
    return F.coalesce(literal_map(STATUS)[F.trim(raw)], F.lit("unknown"))


def action(raw: Column) -> Column:
    a = F.lower(F.trim(raw))
    return F.when(a.isin(*ACTIONS.values()), a).otherwise(F.coalesce(literal_map(ACTIONS)[a], F.lit("sua_doi")))


def date_or_min(raw: Column) -> Column:
    return F.coalesce(F.try_to_date(raw) if hasattr(F, "try_to_date") else raw.try_cast("date"), F.lit("0001-01-01").cast("date"))


def clauses(text: Column) -> Column:
    """Clauses in order as struct(key, pos, text); key 0 is what stands before the first. Numbers may repeat."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=\d{1,9}\.\s)"), lambda p: F.regexp_like(p, F.lit(r"\S")))
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d{1,9})\.\s", 1), F.lit("")), F.lit("0")).cast("int")
    return F.transform(parts, lambda p, i: F.struct(number(p).alias("key"), i.alias("pos"), F.regexp_replace(p, r"^\s+|\s+$", "").alias("text")))


def points(text: Column) -> Column:
    """The lines of a clause cut before each point: what stands before the first, then `a) …` and so on."""
    return F.split(text, r"\n(?=[a-zđ]\)\s)")


def _with_point(text: Column, a: Column) -> Column:
    """A clause's text with one of its points amended; a new point comes last."""
    letter, new = a["diem"], F.coalesce(a["new_text"], F.lit(""))
    written = F.concat(letter, F.lit(") "), F.regexp_replace(new, r"^[a-zđ]\)\s*", ""))
    void = F.concat(letter, F.lit(") " + REPEALED))
    parts = points(text)
    at = F.array_position(F.transform(parts, lambda p: F.regexp_extract(p, r"^([a-zđ])\)\s", 1)), letter)
    value = lambda p: F.when(a["action"].isin(*VOID), void).when(a["action"] == "bo_sung", F.concat(p, F.lit("\n"), new)).otherwise(written)
    changed = F.transform(parts, lambda p, i: F.when(i + 1 == at, value(p)).otherwise(p))
    added = F.concat(parts, F.array(F.when(a["action"].isin(*VOID), void).otherwise(written)))
    return F.array_join(F.when(at > 0, changed).otherwise(added), "\n")


def chains(amendments: DataFrame) -> DataFrame:
    """(target_uid, chain, n, latest): each target's amendments by date, then source. Column diem is optional."""
    diem = F.col("diem") if "diem" in amendments.columns else F.lit(None).cast("string")
    step = F.struct("ngay", "source_uid", action(F.col("action")).alias("action"), "khoan", diem.alias("diem"), "new_text")
    return amendments.groupBy("target_uid").agg(F.array_sort(F.collect_list(step)).alias("chain"), F.count("*").alias("n"), F.max("ngay").alias("latest"))


def transitive_chains(amendments: DataFrame, depth: int = 10) -> DataFrame:
    """(target_uid, source_uid, ngay, depth, is_transitive): amendments of a target and of their sources, by date.

    One equi join a round, up to a depth; a target that amends itself in a circle is met once a source.
    """
    step = amendments.select(F.col("target_uid").alias("_to"), F.col("source_uid").alias("_from"), F.col("ngay").alias("_at")).distinct()
    found = step.select(F.col("_to").alias("target_uid"), F.col("_from").alias("source_uid"), F.col("_at").alias("ngay"), F.lit(1).alias("depth"))
    front = found
    for k in range(2, depth + 1):
        front = front.select("target_uid", F.col("source_uid").alias("_to")).join(step, "_to").select("target_uid", F.col("_from").alias("source_uid"), F.col("_at").alias("ngay"), F.lit(k).alias("depth")).distinct()
        front = cut(front.join(found.select("target_uid", "source_uid"), ["target_uid", "source_uid"], "left_anti").where("target_uid <> source_uid"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.withColumn("is_transitive", F.col("depth") > 1)


def compose(articles: DataFrame, amendments: DataFrame) -> DataFrame:
    """(uid, as_of, text, n_changes) of articles(uid, text): the chain folded over clauses and points, earliest first.

    An amendment of a number that occurs more than once changes the first.
    """
    folded = articles.join(chains(amendments).withColumnRenamed("target_uid", "uid"), "uid", "left")

    def step(m: Column, a: Column) -> Column:
        key, new = F.coalesce(a["khoan"], F.lit(0)).cast("int"), F.coalesce(a["new_text"], F.lit(""))
        number = F.when(key > 0, F.concat(key.cast("string"), F.lit(". "))).otherwise(F.lit(""))
        written = F.concat(number, F.regexp_replace(new, r"^\d+\.\s*", ""))
        void = F.concat(number, F.lit(REPEALED))
        own = F.get(F.filter(m, lambda c: c["key"] == key), F.lit(0))
        plain = lambda old: F.when(a["action"].isin(*VOID), void).when((a["action"] == "bo_sung") & old.isNotNull(), F.concat(old, F.lit("\n"), new)).otherwise(written)
        value = lambda old: F.when(a["diem"].isNotNull(), _with_point(F.coalesce(old, number), a)).otherwise(plain(old))
        changed = F.transform(m, lambda c: F.struct(c["key"].alias("key"), c["pos"].alias("pos"), F.when((c["key"] == key) & (c["pos"] == own["pos"]), value(c["text"])).otherwise(c["text"]).alias("text")))
        return F.when(F.exists(m, lambda c: c["key"] == key), changed).otherwise(F.concat(m, F.array(F.struct(key.alias("key"), F.size(m).alias("pos"), value(F.lit(None).cast("string")).alias("text")))))

    chain = F.coalesce("chain", F.array().cast(folded.schema["chain"].dataType))
    merged = F.aggregate(chain, clauses(F.col("text")), step)
    text = F.array_join(F.transform(F.array_sort(merged), lambda e: e["text"]), "\n")
    return folded.select("uid", F.col("latest").alias("as_of"), F.when(F.col("n").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("n_changes"))


def validity(articles: DataFrame, docs: DataFrame, edges: DataFrame, amendments: DataFrame) -> DataFrame:
    """(uid, is_current, reason) by priority: the document's status, superseded, superseded in part, repealed, current."""
    ended = docs.where(status(F.col("status")).isin("het_hieu_luc", "ngung_hieu_luc")).select("doc_id", F.lit(1).alias("f1")).distinct()
    target = lambda kind, flag: edges.where(F.col("rel_type") == kind).select(F.col("dst").alias("doc_id"), F.lit(1).alias(flag)).distinct()
    repealed = amendments.where(action(F.col("action")) == "bai_bo").select(F.col("target_uid").alias("uid"), F.lit(1).alias("f4")).distinct()
    out = articles.join(ended, "doc_id", "left").join(target("SUPERSEDES", "f2"), "doc_id", "left").join(target("PARTIALLY_SUPERSEDES", "f3"), "doc_id", "left").join(repealed, "uid", "left")
    reason = F.when(F.col("f1") == 1, "doc_het_hieu_luc").when(F.col("f2") == 1, "superseded").when(F.col("f3") == 1, "partially_superseded").when(F.col("f4") == 1, "bai_bo").otherwise("con_hieu_luc")
    return out.select("uid", (reason == "con_hieu_luc").alias("is_current"), reason.alias("reason"))


def structural_match(a: Column, b: Column) -> Column:
    return numbered_structure(a) == numbered_structure(b)


def as_of(versions: DataFrame, moments: DataFrame) -> DataFrame:
    """Each moment(uid, at) with the latest version(uid, as_of, text) not after it, nulls before the first; one equi join and an aggregate."""
    known = versions.select("uid", "as_of", "text")
    found = moments.select("uid", "at").join(known, (moments["uid"] == known["uid"]) & (F.col("as_of") <= F.col("at")), "left").drop(known["uid"])
    return found.groupBy("uid", "at").agg(F.max_by("text", "as_of").alias("text"), F.max("as_of").alias("as_of"))


def current_version(versions: DataFrame) -> DataFrame:
    """Mark the latest version of each article."""
    return versions.withColumn("is_current", F.col("as_of") == F.max("as_of").over(Window.partitionBy("uid")))


def versions(composed: DataFrame) -> DataFrame:
    """compose's rows as versions: version_uid of article and date, n_changes, is_current for the latest of each article.

    A version that is composed again replaces the one of its date.
    """
    one = composed.groupBy("uid", "as_of").agg(F.max_by("text", "n_changes").alias("text"), F.max("n_changes").alias("n_changes"))
    out = one.withColumn("version_uid", F.concat_ws("_", F.lit("eff"), "uid", F.date_format("as_of", "yyyy-MM-dd")))
    return current_version(out)


def version_edges(chained: DataFrame) -> DataFrame:
    """(version_uid, dst, rel_type, place) of chains' rows: COMPOSED_FROM the article, AMENDED_BY each source in order."""
    uid = F.concat_ws("_", F.lit("eff"), "target_uid", F.date_format("latest", "yyyy-MM-dd"))
    base = chained.select(uid.alias("version_uid"), F.col("target_uid").alias("dst"), F.lit("COMPOSED_FROM").alias("rel_type"), F.lit(0).alias("place"))
    steps = chained.select(uid.alias("version_uid"), F.posexplode("chain").alias("at", "step"))
    return base.unionByName(steps.select("version_uid", F.col("step.source_uid").alias("dst"), F.lit("AMENDED_BY").alias("rel_type"), (F.col("at") + 1).alias("place")))


def agreement(composed: DataFrame, consolidated: DataFrame, least: float = 0.9) -> DataFrame:
    """(uid, char_similarity, structural, is_match, diff) of composed(uid, text) against consolidated(uid, text)."""
    rows = composed.select("uid", F.col("text").alias("a")).join(consolidated.select("uid", F.col("text").alias("b")), "uid")
    out = rows.withColumn("char_similarity", char_similarity("a", "b")).withColumn("structural", structural_match(F.col("a"), F.col("b")))
    return out.select("uid", "char_similarity", "structural", (F.col("char_similarity") >= least).alias("is_match"), unified_diff("a", "b").alias("diff"))


def agreement_rate(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, rate): the share of is_match; 0 without rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("is_match").cast("double")), F.lit(0.0)).alias("rate"))


def validity_report(rows: DataFrame) -> DataFrame:
    """(doc_type, current, voided): counts of is_current by type."""
    return rows.groupBy("doc_type").agg(F.count_if(F.col("is_current")).alias("current"), F.count_if(~F.col("is_current")).alias("voided"))


def effective_or_raw(articles: DataFrame, composed: DataFrame) -> DataFrame:
    """articles(uid, text) with the text in force: the current version's where there is one, else their own."""
    now = composed.where("is_current").select("uid", F.col("text").alias("_now"))
    return articles.join(now, "uid", "left").select(*articles.columns, F.coalesce("_now", "text").alias("effective_text"), F.when(F.col("_now").isNotNull(), "composed").otherwise("fallback").alias("effective_status"))
