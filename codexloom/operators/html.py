"""HTML clean-up by regular expressions: unwrap, drop, verify, explode to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that go with their content, and elements of which only the tags go. Fixed values.
DROPPED, UNWRAPPED = ("script", "style", "dir"), ("font", "span")
BLOCKS = "p|div|li|h[1-6]"


def clean(html: Column) -> Column:
    """Without scripts, styles and lists of links, without wrappers, without empty paragraphs."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    html = F.regexp_replace(html, rf"(?i)</?(?:{'|'.join(UNWRAPPED)})\b[^>]*>", "")
    html = F.regexp_replace(html, r"(?is)<table[^>]*detailcontent[^>]*>(.*?)</table>", "$1")
    return F.regexp_replace(html, r"(?i)<p\b[^>]*+>(?:\s++|&nbsp;|<br\s*+/?>)*+</p>", "")  # possessive: the engine keeps no way back for each blank


def text_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "&nbsp;", " "), r"[ \t\n\r\f]+", " "))


def kept_ratio(raw: Column, cleaned: Column) -> Column:
    """Share of the text that a clean-up kept; 1 for no text."""
    return F.coalesce(F.try_divide(F.char_length(text_of(cleaned)), F.nullif(F.char_length(text_of(raw)), F.lit(0))), F.lit(1.0))


def cleaned(df: DataFrame, html: str = "html", least: float = 0.9) -> DataFrame:
    """Add clean_html: the cleaned page, or the raw one if too much text or all article marks were lost."""
    c = clean(F.col(html))
    marks = lambda x: F.regexp_count(text_of(x), F.lit(r"(?iuU)điều\s+\d+"))
    out = df.withColumn("_clean", c).withColumn("kept_ratio", kept_ratio(F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script\s*>", ""), r"(?is)<style\b.*?</style\s*>", ""), F.col("_clean")))
    ok = (F.col("kept_ratio") >= least) & ~((marks(F.col(html)) > 0) & (marks(F.col("_clean")) == 0))
    return out.withColumn("is_ok", ok).withColumn("clean_html", F.when(ok, F.col("_clean")).otherwise(F.col(html))).drop("_clean")


def lines(df: DataFrame, html: str = "html") -> DataFrame:
    """One row for each leaf block element with text, in document order: pos, tag, line."""
    pattern = rf"(?is)<({BLOCKS})\b[^>]*+>((?:(?!<(?:{BLOCKS})\b).)*?)</\1\s*>"
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
    out = df.select(*df.columns, F.posexplode(found).alias("pos", "_raw"))
    return out.withColumn("tag", F.lower(F.regexp_extract("_raw", r"^<(\w+)", 1))).withColumn("line", text_of(F.col("_raw"))).where("line <> ''").drop("_raw")
