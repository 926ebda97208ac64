"""Small text and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside lambdas a captured expression is computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_tags(html: Column, by: str = "") -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", by))


def search_query(c: Column) -> Column:
    """A full-text query without operators, at most 300 characters."""
    return F.substring(collapse(F.regexp_replace(c, r'[+\-&|!(){}\[\]^"~*?:\\/]', " ")), 1, 300)


def tidy_lines(c: Column) -> Column:
    """LF line ends, no blanks at line ends, one blank line at most, stripped."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]", "_"), "^[._]+|[._]+$", "")


def source_format(name: Column, content_type: Column) -> Column:
    n, t = F.lower(name), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(F.endswith(n, F.lit(".pdf")) | t.contains("pdf"), "pdf")
        .when(F.endswith(n, F.lit(".docx")) | t.contains("wordprocessingml"), "docx")
        .when(F.endswith(n, F.lit(".md")) | t.contains("markdown"), "md")
        .otherwise("txt")
    )


def token_estimate(c: Column) -> Column:
    words = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.greatest(words, F.lit(1))).cast("long")


def fallback_title(c: Column, default: str = "Cuộc trò chuyện mới") -> Column:
    return F.coalesce(F.nullif(F.substring(collapse(c), 1, 60), F.lit("")), F.lit(default))


def cache_key(c: Column) -> Column:
    return F.substring(F.md5(F.substring(c, 1, 200)), 1, 16)


def instructed(query: Column, instruction: str) -> Column:
    """Put an instruction in front of a query once."""
    return F.when(F.startswith(query, F.lit("Instruct:")), query).otherwise(F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query))


def numbered_structure(c: Column) -> Column:
    """struct(clauses, points): lines that begin with a number and a dot, and with a letter and a bracket."""
    return F.struct(F.regexp_count(c, F.lit(r"(?:^|\n)\d+\.\s")).alias("clauses"), F.regexp_count(c, F.lit(r"(?:^|\n)[a-zđ]\)\s")).alias("points"))


def squash(score: Column) -> Column:
    """A full-text score on a scale from 0 to 1; the base is the constant 2.71828."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (1 / (1 + F.pow(F.lit(2.71828), -score / 5)) - 0.5)))


def fuzzy_confidence(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.15 * distance)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each {{key}}."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template
