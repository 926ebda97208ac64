"""Personal data: detection, redaction with a map back, reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.functions.spans import SPAN, numbered, places, replaced, without_overlaps
from codexloom.functions.text import let
from codexloom.sources.tables import spread

#: Families of personal data with the group that holds the value. Fixed values.
FAMILIES = [
    ("cccd", r"(?iuU)(?:CCCD|CMND|Căn\s*cước\s*(?:công\s*dân)?|Chứng\s*nhân\s*dân|Số)\s*(?:số\s*)?[:\-]?\s*(\d{9,12})\b", 1),
    ("mst", r"(?iuU)(?:MST|Mã\s*số\s*thuế|Thuế\s*):\s*[:\-]?\s*(\d{10,13})\b", 1),
    ("phone", r"(?U)(?:\+84|0)(\d{8,10})\b|(\+84[\s\-]?\d{1,3}[\s\-]?\d{3,4}[\s\-]?\d{3,4})\b", 0),
    ("email", r"(?U)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0),
    ("bank_account", r"(?iuU)(?:STK|Số\s*tài\s*khoản|Tài\s*khoản|Ngân\s*hàng|Bank|Account)\s*[:\-]?\s*(\d{10,16})\b", 1),
    ("address", r"(?iuU)(?:đường|phố|ngõ|hẻm|quận|huyện|phường|xã|tỉnh|thành\s*phố|TP\.)\s+[^,.\n]{3,50}", 0),
]


#: Words of which an address holds one, in lower case. Fixed values.
ADDRESS_WORDS = ["đường", "phố", "ngõ", "hẻm", "quận", "huyện", "phường", "xã", "tỉnh", "tp."]


def detect(text: Column) -> Column:
    """Spans of all families without overlaps, sorted by start; null text has none. Blanks are those of Unicode.

    Each family's pattern goes once over the text, and only where a cheaper test leaves it a chance.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    words = F.array(*map(F.lit, ADDRESS_WORDS))

    def families(has: Column) -> Column:
        out = []
        for kind, pattern, group in FAMILIES:
            found = places(text, pattern, kind, group)
            if kind == "address":
                found = F.filter(found, lambda s: F.char_length(F.regexp_replace(s["value"], r"(?U)^\s+|\s+$", "")) > 5)
            test = {"address": has["address"], "email": F.contains(text, F.lit("@")), "phone": has["digits"] | F.contains(text, F.lit("+84"))}.get(kind, has["digits"])
            out.append(F.when(test, found).otherwise(none))
        return F.concat(*out)

    address = let(F.lower(text), lambda low: F.exists(words, lambda w: F.contains(low, w)))
    digits = F.regexp_like(text, F.lit(r"(?U)\d{8}"))  # each family of numbers but phones with blanks needs as many
    return without_overlaps(let(F.struct(digits.alias("digits"), address.alias("address")), families))


def placeholder(span: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), F.upper(span["kind"]), F.lit("_"), span["nth"].cast("string"), F.lit("]"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Add pii (spans), redacted and pii_map; placeholders of a kind are numbered from the right."""
    found = spread(df).withColumn("pii", detect(F.col(text)))  # a column of its own: the steps after it use it several times
    out = found.withColumn("pii", numbered(F.col("pii"), [k for k, *_ in FAMILIES]))
    entries = F.transform(F.reverse(F.col("pii")), lambda s: F.struct(placeholder(s).alias("key"), s["value"].alias("value")))
    return out.withColumn("redacted", replaced(F.col(text), F.col("pii"), placeholder)).withColumn("pii_map", F.map_from_entries(entries))


def restore(redacted: Column, pii_map: Column) -> Column:
    return F.aggregate(F.map_entries(pii_map), redacted, lambda t, e: F.replace(t, e["key"], e["value"]))
