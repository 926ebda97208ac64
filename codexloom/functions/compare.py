"""Texts compared and repaired where no built-in function has the semantics: Arrow batches through the standard library."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexloom.functions.text import let

#: Letters that speak for a repaired text, and signs that speak against it. Fixed values.
LETTERS = "ăâđêôơưĂÂĐÊÔƠƯáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
MARKERS = ("Ã", "Ä", "Å", "Æ", "Ç", "È", "É", "Ê", "Ë", "Ð", "Ñ", "Ò", "Ó", "Ô", "Õ", "Ö", "×", "Ø", "Ù", "Ú", "á»", "áº", "Ä")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of both stripped texts; 1 for two empty ones, 0 for one. Null counts as empty."""

    def one(x: str | None, y: str | None) -> float:
        if not x or not y:
            return float(not x and not y)
        return difflib.SequenceMatcher(None, x.strip(), y.strip()).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """The unified diff of two texts by lines; empty for equal ones. Null counts as empty."""
    lines = lambda t: (t or "").splitlines(keepends=True)
    return pd.Series(["".join(difflib.unified_diff(lines(x), lines(y), fromfile="composed", tofile="hop_nhat", lineterm="")) for x, y in zip(a, b, strict=True)])


#: Characters of cp1252 that Latin-1 has as controls, and those controls.
_CP1252 = {bytes([b]).decode("cp1252", "ignore"): chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")}


def repair_mojibake(text: Column) -> Column:
    """The best of a text and of it read as UTF-8 behind Latin-1 or cp1252; of equals the first.

    Vietnamese letters count 3, marks of bad decoding -2 each, U+FFFD -5. A reading that fails is no candidate.
    """

    gone = lambda c, marks: F.char_length(c) - F.char_length(F.translate(c, marks, ""))
    single = "".join(m for m in MARKERS if len(m) == 1)
    twice = "".join({m for m in single if single.count(m) > 1})  # a mark that is listed twice counts twice
    signs = lambda c: F.regexp_replace(c, F.lit(r"[\x00-\x7F]+"), F.lit(" "))  # noqa: E731  # what counts is never ASCII

    def score(c: Column) -> Column:
        double = F.lit(0.0)
        for m in (m for m in MARKERS if len(m) > 1):
            double = double + (F.char_length(c) - F.char_length(F.replace(c, F.lit(m), F.lit("")))) / len(m)
        return 3 * gone(c, LETTERS) - 2 * (gone(c, single) + gone(c, twice) + double) - 5 * gone(c, "\ufffd")

    def best(t: Column, own: Column) -> Column:
        # cp1252 differs from Latin-1 only for texts that Latin-1 lacks signs of, so there is one other reading at most
        known = "".join(_CP1252)
        windows = F.when(~F.regexp_like(own, F.lit(rf"[\x80-\x9F]|[^\x00-\xFF{known}]")), F.translate(t, known, "".join(_CP1252.values())))
        raw = F.encode(F.when(F.regexp_like(own, F.lit(r"[^\x00-\xFF]")), windows).otherwise(t), "ISO-8859-1")
        other = let(raw.cast("string"), lambda r: F.when(F.is_valid_utf8(r), r))
        return let(other, lambda o: F.when(let(signs(o), score) > let(own, score), o).otherwise(t))

    return let(text, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(let(signs(t), lambda own: best(t, own))))
