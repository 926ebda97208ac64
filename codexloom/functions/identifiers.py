"""Document numbers, titles and path keys as Column expressions; nothing here runs Python on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Document type to key prefix. Fixed values.
TYPE_PREFIX = {"Luật": "LT", "Bộ luật": "BL", "Nghị định": "ND", "Thông tư": "TT", "Thông tư liên tịch": "TTLT"}
#: Kinds of document numbers, the most specific first. Fixed values.
NUMBER_PATTERNS = [
    ("TTLT", r"(?iuU)(\d{1,3})/(\d{4})/TTLT-([\p{L}\d_-]+)"),
    ("TT", r"(?iuU)(\d{1,3})/(\d{4})/TT-([\p{L}\d_]+)"),
    ("ND", r"(?iuU)(\d{1,3})/(\d{4})/N[ĐD]-CP"),
    ("LT", r"(?iuU)(\d{1,3})/(\d{4})/QH(\d+)"),
    ("UNKNOWN", r"(?iuU)(?:số\s+)?(\d{1,3})/(\d{4})"),
]
NO_NUMBER = "không số"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_number(raw: Column) -> Column:
    """struct(kind, number, year, issuer, is_standard): the first pattern that occurs anywhere decides; number has three digits."""
    null = F.lit(None).cast("string")

    def hit(kind: str, pattern: str) -> Column:
        issuer = F.lit("CP") if kind == "ND" else null if kind == "UNKNOWN" else F.regexp_extract(raw, pattern, 3)
        if kind == "LT":
            issuer = F.concat(F.lit("QH"), F.regexp_extract(raw, pattern, 3))
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lpad(F.regexp_extract(raw, pattern, 1), 3, "0").alias("number"),
            F.regexp_extract(raw, pattern, 2).alias("year"),
            issuer.alias("issuer"),
            F.lit(kind != "UNKNOWN").alias("is_standard"),
        )

    none = F.struct(F.lit("UNKNOWN").alias("kind"), null.alias("number"), null.alias("year"), null.alias("issuer"), F.lit(False).alias("is_standard"))
    cases = [F.when(F.regexp_like(raw, F.lit(p)), hit(k, p)) for k, p in NUMBER_PATTERNS]
    unnumbered = F.lower(F.trim(raw)).contains(NO_NUMBER)
    return F.when(raw.isNull() | unnumbered, none).otherwise(F.coalesce(*cases, none))


def normal_key(raw: Column, doc_type: Column) -> Column:
    """PREFIX-number-year; the document type's prefix before the one that the number tells; null without number or year."""
    n = parse_number(raw)
    prefix = F.coalesce(literal_map(TYPE_PREFIX)[doc_type], n["kind"])
    return F.when(n["number"].isNotNull() & n["year"].isNotNull(), F.concat_ws("-", prefix, n["number"], n["year"]))


def strip_number(raw: Column) -> Column:
    """Upper case, the first number/number/letters or else the first word, without leading zeros in each part."""
    up = F.upper(F.trim(raw))
    full = blank_to_null(F.regexp_extract(up, r"\d+/\d+/[A-ZĐ0-9-]+", 0))
    first = F.element_at(F.split(up, r"(?U)\s+"), 1)
    return F.array_join(F.transform(F.split(F.coalesce(full, first), "/"), lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")), "/")


def hinted_key(raw: Column, hint: Column) -> Column:
    """Key from a number whose kind is told by its own issuer or by a hint in words."""
    up, h = F.upper(raw), F.lower(F.coalesce(hint, F.lit("")))
    number, year = F.regexp_extract(up, r"(\d{1,3})/(\d{4})", 1), F.regexp_extract(up, r"(\d{1,3})/(\d{4})", 2)
    prefix = (
        F.when(up.contains("TTLT") | h.contains("thông tư liên tịch"), "TTLT")
        .when(up.contains("/TT") | h.contains("thông tư"), "TT")
        .when(up.contains("NĐ") | up.contains("ND-CP") | h.contains("nghị định"), "ND")
        .when(up.contains("QH") | h.contains("luật"), "LT")
    )
    return F.when((number != "") & prefix.isNotNull(), F.concat_ws("-", prefix, F.lpad(number, 3, "0"), year))


def normal_title(title: Column) -> Column:
    """Lower case, single blanks, no quotes, no punctuation but slashes and hyphens."""
    t = F.regexp_replace(F.lower(F.trim(title)), r"(?U)\s+", " ")
    t = F.regexp_replace(t, "[\"'“”‘’]", "")
    return F.trim(F.regexp_replace(t, r"[.,;:()\[\]]", ""))


def without_year(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"(?U)\s(19|20)\d{2}$", ""))


def title_aliases(title: Column, doc_type: Column) -> Column:
    """Distinct spellings that a title may be cited by, in order of preference."""
    full, kind = normal_title(title), F.lower(doc_type)
    typed = F.when(F.startswith(full, kind), full).otherwise(F.concat_ws(" ", kind, full))
    bare = F.when(F.startswith(full, kind), F.trim(F.substring(full, F.char_length(kind) + 1, F.lit(1000)))).otherwise(full)
    return F.array_distinct(F.filter(F.array(full, without_year(full), typed, without_year(typed), bare), lambda x: x != ""))


def short_titles(title: Column, doc_type: Column) -> Column:
    """A title with its type in front, and the same without a closing year."""
    t = F.regexp_replace(F.trim(title), r"(?U)\s+", " ")
    full = F.when(F.startswith(F.lower(t), F.lower(doc_type)), t).otherwise(F.concat_ws(" ", doc_type, t))
    return F.array_distinct(F.array(full, F.regexp_replace(full, r"(?iuU)\s+năm\s+\d{4}$", "")))


def _level(c: Column) -> Column:
    """A number or letter of a uid without the word before it; null if it says nothing."""
    c = c.cast("string")
    word = F.substring(c, 1, 1).isin(*"đĐkK\u212a")  # a cheap look first: few parts begin with a word
    c = F.trim(F.when(word, F.regexp_replace(c, r"(?iuU)^(điều|khoản|điểm)\s+", "")).otherwise(c))
    return F.when(~F.lower(c).isin("null", "none", ""), c)


def build_uid(doc: Column, article: Column, clause: Column, point: Column) -> Column:
    """doc_D_dieu_A_khoan_K_diem_P down to the first missing level; words before numbers are dropped."""
    a, k, p = map(_level, (article, clause, point))
    return F.concat_ws(
        "_",
        F.lit("doc"),
        doc.cast("string"),
        F.when(a.isNotNull(), F.concat(F.lit("dieu_"), a)),
        F.when(a.isNotNull() & k.isNotNull(), F.concat(F.lit("khoan_"), k)),
        F.when(a.isNotNull() & k.isNotNull() & p.isNotNull(), F.concat(F.lit("diem_"), p)),
    )


def clause_uid(article_uid: Column, clause: Column) -> Column:
    """The uid of an article's clause; null without a number."""
    return F.concat(article_uid, F.lit("_khoan_"), _level(clause))


def point_uid(clause_uid: Column, point: Column) -> Column:
    """The uid of a clause's point; null without a letter."""
    return F.concat(clause_uid, F.lit("_diem_"), _level(point))


def uid_part(uid: Column, level: str) -> Column:
    """The doc, dieu, khoan or diem part of a uid; null if it has none."""
    return blank_to_null(F.regexp_extract(uid, rf"(?:^|_){level}_([^_]+)", 1))


def clean_optional(c: Column) -> Column:
    """'', none and null as NULL."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "none", "null"), t)


def citation(article: Column, clause: Column, point: Column, title: Column, fallback: Column) -> Column:
    """Điều a khoản k điểm p title; empty parts are skipped, and the fallback stands for nothing at all."""

    def named(word: str, c: Column) -> Column:
        return F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(word + " "), c.cast("string")))

    text = F.concat_ws(" ", named("Điều", article), named("khoản", clause), named("điểm", point), blank_to_null(title))
    return F.coalesce(blank_to_null(text), fallback)


def parse_reference(text: Column) -> Column:
    """struct(article, clause, point, so_ky_hieu, year) of a reference in words; missing parts are null."""

    def first(pattern: str) -> Column:
        return blank_to_null(F.regexp_extract(text, pattern, 1))

    return F.struct(
        first(r"(?iuU)điều\s+(\d+[a-z]?)").alias("article"),
        first(r"(?iuU)khoản\s+(\d+[a-z]?)").alias("clause"),
        first(r"(?iuU)điểm\s+([a-zđ])(?![\p{L}\d])").alias("point"),
        first(r"(?iuU)(\d{1,3}/\d{4}/[A-ZĐ0-9-]+)").alias("so_ky_hieu"),
        first(r"(?:^|[^\d/])((?:19|20)\d{2})(?![\d/])").alias("year"),
    )


def first_of(*columns: Column) -> Column:
    """The first column that isn't null or empty."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))
