"""Clause review and question planning as rules over columns: guardrail, rewrite, policy, citations, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.functions.identifiers import any_of, literal_map
from codexloom.functions.text import let

#: Words of contracts that aren't supported, and of those that are. Fixed values.
RENTAL = ["hợp đồng thuê nhà", "thuê nhà", "thuê căn hộ", "căn hộ", "nhà ở", "bên cho thuê", "bên thuê", "giá thuê", "tiền thuê nhà", "đặt cọc thuê", "bất động sản"]
LABOUR = ["hợp đồng lao động", "người lao động", "người sử dụng lao động", "tiền lương", "lương", "phụ cấp", "bảo hiểm xã hội", "bảo hiểm y tế", "bảo hiểm thất nghiệp", "thử việc", "nghỉ việc", "sa thải", "kỷ luật lao động", "thời giờ làm việc", "việc làm"]
#: Families of clauses: trigger words, risk type, keywords, domains; the first that occurs counts. Fixed values.
ISSUES = {
    "penalty_cap": "mức phạt vi phạm hợp đồng",
    "termination": "đơn phương chấm dứt hợp đồng",
    "wage_benefits": "tiền lương và nghĩa vụ bảo hiểm trong hợp đồng lao động",
    "confidentiality": "nghĩa vụ bảo mật thông tin trong hợp đồng",
    "dispute_resolution": "giải quyết tranh chấp hợp đồng",
    "general": "rà soát điều khoản hợp đồng",
}
FAMILIES = [
    (["phạt", "vi phạm", "30%", "8%"], "penalty_cap", ["phạt vi phạm", "mức phạt", "8%", "nghĩa vụ bị vi phạm"], ["Luật Thương mại", "Bộ luật Dân sự"]),
    (["chấm dứt", "đơn phương", "hủy bỏ"], "termination", ["chấm dứt hợp đồng", "đơn phương chấm dứt", "thông báo trước"], ["Bộ luật Dân sự", "Luật Thương mại", "Bộ luật Lao động"]),
    (["lương", "tiền lương", "phụ cấp", "bảo hiểm"], "wage_benefits", ["tiền lương", "phụ cấp", "bảo hiểm xã hội", "người lao động"], ["Bộ luật Lao động", "Luật Bảo hiểm xã hội"]),
    (["bảo mật", "thông tin mật", "bí mật"], "confidentiality", ["bảo mật", "thông tin mật", "bí mật kinh doanh"], ["Bộ luật Dân sự", "Luật Sở hữu trí tuệ"]),
    (["tranh chấp", "tòa án", "trọng tài"], "dispute_resolution", ["giải quyết tranh chấp", "tòa án", "trọng tài", "thẩm quyền"], ["Bộ luật Tố tụng dân sự", "Luật Trọng tài thương mại"]),
]
RESTRICTIVE = ["nghiêm cấm", "không được phép", "bắt buộc", "phải", "tuyệt đối", "không cho phép", "xử lý nghiêm", "tước quyền", "đình chỉ"]
#: Wages: trigger words, and what a plan for them gets in front. Fixed values.
WAGE_WORDS = ["lương", "tiền lương", "trả lương", "chậm lương", "dòng tiền"]
WAGE_ISSUE = "thời hạn trả lương, chậm trả lương, tiền lãi khi trả lương chậm và lương tối thiểu vùng trong hợp đồng lao động"
WAGE_QUERIES = [
    "người sử dụng lao động phải trả lương trực tiếp đầy đủ đúng hạn Bộ luật Lao động",
    "chậm trả lương 60 ngày có phải trả thêm tiền lãi Bộ luật Lao động",
    "trả lương chậm từ 15 ngày trở lên phải đền bù tiền lãi",
    "thời hạn trả lương không được chậm quá 30 ngày",
    "lương tối thiểu vùng khu vực I Hà Nội người lao động",
    "mức lương tối thiểu tháng vùng I Hà Nội hợp đồng lao động",
]
WAGE_KEYWORDS = ["tiền lương", "trả lương đúng hạn", "chậm trả lương", "tiền lãi", "15 ngày", "30 ngày", "60 ngày", "lương tối thiểu vùng", "khu vực I", "Hà Nội"]
WAGE_DOMAINS, WAGE_TITLES = ["Bộ luật Lao động", "Nghị định lương tối thiểu"], ["Bộ luật Lao động", "lương tối thiểu vùng"]
SEVERITY = {"high": 3, "medium": 2, "low": 1}


def guardrail(text: Column) -> Column:
    """rental, unsupported or supported: the deny list is asked first."""
    t = F.lower(text)
    return F.when(any_of(t, RENTAL), "rental").when(any_of(t, LABOUR), "supported").otherwise("unsupported")


def rewrite(text: Column) -> Column:
    """struct(risk_type, keywords, domains) by the first family with a trigger word."""
    t = F.lower(text)
    struct = lambda risk, words, domains: F.struct(F.lit(risk).alias("risk_type"), words.alias("keywords"), domains.alias("domains"))
    lits = lambda xs: F.array(*map(F.lit, xs))
    none = struct("general", F.array().cast("array<string>"), lits(["Bộ luật Dân sự"]))
    return F.coalesce(*(F.when(any_of(t, words), struct(risk, lits(keys), lits(domains))) for words, risk, keys, domains in FAMILIES), none)


def distinct_words(words: Column) -> Column:
    """Stripped, without empty ones, of those equal but for case the first."""
    kept = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    first = lambda ws, lower: F.filter(ws, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)
    return let(kept, lambda ws: let(F.transform(ws, lambda w: F.lower(w)), lambda lower: first(ws, lower)))


def plan(text: Column, kind: Column) -> Column:
    """The retrieval plan of a clause: issue, risk_type, search_queries, keywords, domains, title_hints; wages get their own in front."""
    return let(rewrite(text), lambda r: _plan(text, kind, r))


def _plan(text: Column, kind: Column, r: Column) -> Column:
    issue = literal_map(ISSUES)[r["risk_type"]]
    lits = lambda xs: F.array(*map(F.lit, xs))
    compact = F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, 240)
    queries = F.concat(F.array(issue), r["keywords"], F.array(compact))
    wage = any_of(F.lower(F.concat_ws(" ", kind, text)), WAGE_WORDS)
    front = lambda some, rest: distinct_words(F.when(wage, F.concat(lits(some), rest)).otherwise(rest))
    return F.struct(
        F.when(wage, F.lit(WAGE_ISSUE)).otherwise(issue).alias("issue"),
        F.when(wage, "wage_payment").otherwise(r["risk_type"]).alias("risk_type"),
        front(WAGE_QUERIES, distinct_words(queries)).alias("search_queries"),
        front(WAGE_KEYWORDS, r["keywords"]).alias("keywords"),
        front(WAGE_DOMAINS, r["domains"]).alias("domains"),
        front(WAGE_TITLES, r["domains"]).alias("title_hints"),
    )


def clause_query(kind: Column, text: Column, obligations: Column, amount: Column, deadline: Column) -> Column:
    """The text that a clause is searched by; empty fields are left out."""
    line = lambda word, c: F.concat(F.lit(word), F.nullif(c, F.lit("")))
    return F.concat_ws("\n", F.lit("Rà soát tuân thủ pháp luật lao động cho điều khoản hợp đồng."), F.concat(F.lit("Loại điều khoản: "), F.coalesce(kind, F.lit(""))), F.concat(F.lit("Nội dung điều khoản: "), F.coalesce(text, F.lit(""))), line("Nghĩa vụ: ", F.array_join(obligations, "; ")), line("Số tiền: ", amount), line("Thời hạn: ", deadline))


def policy_summary(classes: DataFrame) -> DataFrame:
    """(class, n) for all three classes, those without rows as well."""
    names = ["non_compliant", "compliant_but_restrictive", "compliant_and_efficient"]
    return classes.agg(*(F.count_if(F.col("class") == n).alias(n) for n in names)).select(F.inline(F.array(*(F.struct(F.lit(n).alias("class"), F.col(n).alias("n")) for n in names))))


def policy_class(clause: Column, provisions: Column, n_violations: Column) -> Column:
    """non_compliant with violations; restrictive if a restrictive word of the clause is missing in a provision; else efficient."""
    c = F.lower(clause)
    stricter = F.exists(F.array(*map(F.lit, RESTRICTIVE)), lambda w: F.contains(c, w) & F.exists(provisions, lambda p: ~F.contains(F.lower(p), w)))
    return F.when(n_violations > 0, "non_compliant").when(stricter, "compliant_but_restrictive").otherwise("compliant_and_efficient")


def risk(df: DataFrame, key: str, severity: str) -> DataFrame:
    """The highest severity of each key."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col(severity)]
    top = F.max(F.coalesce(rank, F.lit(0)))
    names = {v: k for k, v in SEVERITY.items()}
    name = F.coalesce(*(F.when(F.col("top") == v, F.lit(k)) for v, k in names.items()), F.lit("none"))
    return df.groupBy(key).agg(top.alias("top")).select(key, name.alias("risk"))


def verify_citations(citations: DataFrame, provisions: DataFrame) -> DataFrame:
    """citations(cite_id, uid, article, title) with verified and reason against provisions(uid, article, title, is_current)."""
    p = provisions.select("uid", F.col("article").alias("p_article"), F.col("title").alias("p_title"), "is_current", F.lit(True).alias("found"))
    title = lambda a, b: F.contains(F.lower(F.col(a)), F.lower(F.col(b)))
    reason = (
        F.when(F.col("found").isNull(), "not_found")
        .when(F.col("article").isNotNull() & (F.col("article") != F.col("p_article")), "article_mismatch")
        .when(F.col("title").isNotNull() & ~(title("title", "p_title") | title("p_title", "title")), "title_mismatch")
        .when(~F.col("is_current"), "not_current")
        .otherwise("ok")
    )
    return citations.join(p, "uid", "left").select("cite_id", "uid", (reason == "ok").alias("verified"), reason.alias("reason"))


def one_status(df: DataFrame, key: str, column: str) -> DataFrame:
    """A key's status if all its rows agree, else unknown."""
    return df.groupBy(key).agg(F.when(F.count_distinct(column) == 1, F.min(column)).otherwise("unknown").alias("status"))


def json_items(raw: Column, schema: str, wrappers: tuple[str, ...] = ("results", "relationships", "data", "clauses")) -> Column:
    """Items of a model's JSON output: an array, an object that wraps one, or one object; code fences go; else null."""
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    array = F.when(F.startswith(bare, F.lit("[")), F.from_json(bare, f"array<{schema}>"))
    wrapped = [F.from_json(F.get_json_object(bare, f"$.{w}"), f"array<{schema}>") for w in wrappers]
    single = F.when(F.startswith(bare, F.lit("{")), F.array(F.from_json(bare, schema)))
    return F.coalesce(array, *wrapped, single)
