r"""Secret scans in DataFrame functions alone: fixed patterns, and a randomness test battery for unknown formats.

Base kinds are leftmost non-overlapping matches: `assign` (a name, a sign and a value of 12 or more), `access`
(AKIA, 18 or more) and `hex` (16 or more). Kind `random` adds tokens that look drawn at random: runs of 16 or
more letters, digits and `+/_-` (with up to two `=` behind) that hold letters and digits and touch no base span.
The encoding of a token is inferred from its characters (hexadecimal, base 32, base 36 of one case, base 64, or
all 66 signs). A run that holds both `+` or `/` and `-` or `_` is tested whole over the 66 signs, and so are its
parts of 16 or more between `-_` and between `+/`, so that a key behind a path is seen; of random spans one
within another the outer is kept. Three tests ask whether its symbols are uniform and independent over that alphabet:

* chi-squared against equal shares (Wilson and Hilferty's normal form),
* Wald and Wolfowitz's runs about the median symbol, two-sided,
* serial correlation of neighbouring symbols, two-sided,

joined by Fisher's method to one p-value, which is uniform for random tokens and near 0 for words and codes that
people make. Short tokens leave the tests little power, so the false-discovery control is done by stratum of
encoding and length: random tokens are twice those with p over one half, and so a share (1 - t) of that many must
pass any threshold t; what passes beyond it is false. Each stratum takes the smallest threshold of GRID whose
estimated share of false discoveries is at most FDR, and none if no threshold has it. The counts that this needs
are taken over all documents; they are at most len(GRID) + 1 rows for each of some thirty strata.

Offsets count code points, end exclusive. Rows: null text is empty and holds no spans; equal texts get equal
spans; other columns pass through `redact`. Memory: a row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.llm.common import Work, refuse

#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Words one of which each `assign` holds, in lower case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The same spans as a pattern and a filter by length: in a run of its class the first match is the longest.
_ACCESS, _HEX = r"AKIA[A-Z0-9]{14,}+", r"[0-9a-f]{16,}+"
_TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Parts of runs in the signs of either kind of base 64.
_PARTS = (r"[A-Za-z0-9+/]{16,}+", r"[A-Za-z0-9_-]{16,}+")
#: Alphabets by encoding, in the order in which they are tried. Fixed values.
ALPHABETS = {
    "hex": ("^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", True),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", False),
    "base36": ("^[0-9a-z]+$|^[0-9A-Z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", True),
    "base64": ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", False),
    "url64": ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", False),
    "mixed66": ("^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", False),
}
#: Lengths from which a stratum reaches to the next.
LENGTHS = (16, 20, 24, 32, 48, 64, 128)
#: Thresholds for p, and the share of false discoveries allowed in a stratum.
GRID, FDR = (0.0001, 0.001, 0.01, 0.05, 0.1, 0.25, 0.5), 0.05

_SPAN = "array<struct<start: bigint, rank: int, end: bigint>>"


def _places(text: Column, matches: Column, kind: str) -> Column:
    """Spans of matches, in order: each begins at its first occurrence after the one before."""
    rank = F.lit(KINDS.index(kind))

    def step(a: Column, m: Column) -> Column:
        at = F.call_function("locate", m, text, a["next"])
        span = F.struct((at - 1).cast("long").alias("start"), rank.alias("rank"), (at - 1 + F.char_length(m)).cast("long").alias("end"))
        return F.struct((at + F.char_length(m)).cast("int").alias("next"), F.concat(a["out"], F.array(span)).alias("out"))

    begin = F.struct(F.lit(1).alias("next"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(matches, begin, step, lambda a: a["out"])


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    lower, found = F.lower(text), F.lit(False)
    for w in words:
        found = found | F.contains(lower, F.lit(w))
    return found


def _assigns(text: Column) -> Column:
    """All matches take their place in the scan; those with a short value are then left out."""
    matches = _all(text, ASSIGN)
    spans = F.zip_with(_places(text, matches, "assign"), matches, lambda s, m: F.struct(s.alias("s"), (F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 12).alias("long")))
    return F.transform(F.filter(spans, lambda x: x["long"]), lambda x: x["s"])


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, sorted by start and kind."""
    none = F.array().cast(_SPAN)
    assign = F.when(_has_any(text, NAMES), _assigns(text)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _places(text, _all(text, _ACCESS), "access")).otherwise(none)
    return F.sort_array(F.concat(assign, access, _places(text, _all(text, _HEX), "hex")))


def _upper_tail(z: Column) -> Column:
    """Of the standard normal distribution, to 2e-4."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def with_p_value(tokens: DataFrame) -> DataFrame:
    """Add p, Fisher's joint p-value of the three tests, to rows with `symbols` (numbers from 1 to k) and k.

    Each step's columns are used several times by the next, so Spark keeps the steps apart and computes each once.
    """
    sym, n, k = F.col("symbols"), F.col("m"), F.col("k")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    size = F.greatest(F.size("symbols"), F.lit(2)).cast("double")
    t = tokens.withColumns({"m": size, "middle": F.get(F.sort_array(sym), (F.size(sym) / 2).cast("int")), "mean": total(sym) / size})
    t = t.withColumns(
        {
            "squares": total(F.transform(F.array_distinct(sym), lambda c: F.pow(F.size(F.filter(sym, lambda x: x == c)).cast("double"), F.lit(2.0)))),
            "high": F.transform(sym, lambda x: (x >= F.col("middle")).cast("double")),
            "off": F.transform(sym, lambda x: x - F.col("mean")),
        }
    )
    ahead = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    behind = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    t = t.withColumns(
        {
            "above": total(F.col("high")),
            "runs": 1 + total(F.zip_with(ahead("high"), behind("high"), lambda x, y: F.abs(x - y))),
            "variance": F.greatest(total(F.transform("off", lambda x: x * x)) / n, F.lit(1e-9)),
            "lagged": total(F.zip_with(ahead("off"), behind("off"), lambda x, y: x * y)) / n,
            "spread": 2 / (9 * (k - 1)),
        }
    )
    t = t.withColumn("both", 2 * F.col("above") * (n - F.col("above")))
    t = t.withColumns(
        {
            "z_uniform": (F.cbrt((F.col("squares") * k / n - n) / (k - 1)) - (1 - F.col("spread"))) / F.sqrt("spread"),
            "z_runs": F.abs(F.col("runs") - 1 - F.col("both") / n) / F.sqrt(F.greatest(F.col("both") * (F.col("both") - n) / (n * n * (n - 1)), F.lit(1e-9))),
            "z_serial": F.abs(F.col("lagged") / F.col("variance") + 1 / n) * F.sqrt(n),
        }
    )
    log = lambda p: F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))
    t = t.withColumn("x", -2 * (log(_upper_tail(F.col("z_uniform"))) + log(2 * _upper_tail(F.col("z_runs"))) + log(2 * _upper_tail(F.col("z_serial")))))
    return t.select(*tokens.columns, (F.exp(-F.col("x") / 2) * (1 + F.col("x") / 2 + F.col("x") * F.col("x") / 8)).alias("p"))


def _numbers(token: Column, alphabet: str) -> Column:
    """The place of each character in an alphabet, from 1; 0 for others."""
    return F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, F.lit(alphabet)))


def candidates(docs: DataFrame) -> DataFrame:
    """Token candidates that touch no base span: row, start, end, stratum, p. docs: row, text, base."""
    text = F.col("text")
    found = docs.where(F.regexp_like("text", F.lit(_TOKEN))).select("row", "base", _all(text, _TOKEN).alias("tokens"), "text")
    spans = found.select("row", "base", F.explode(F.arrays_zip(_places(text, F.col("tokens"), "random").alias("span"), F.col("tokens").alias("token"))).alias("t"))
    spans = spans.select("row", "base", "t.span", F.rtrim(F.col("t.token"), F.lit("=")).alias("token"))
    token, size = F.col("token"), F.char_length("token").cast("long")
    whole = F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))
    parts = [F.transform(_places(token, _all(token, p), "random"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for p in _PARTS]
    cut = spans.withColumn("cut", F.explode(F.when(F.regexp_like(token, F.lit("[+/]")) & F.regexp_like(token, F.lit("[_-]")), F.concat(F.array(whole), *parts)).otherwise(F.array(whole))))
    start = F.col("span.start")
    place = F.struct((start + F.col("cut.start")).alias("start"), F.when(F.col("cut.end") == size, F.col("span.end")).otherwise(start + F.col("cut.end")).alias("end"))
    spans = cut.select("row", "base", place.alias("span"), F.substring(token, (F.col("cut.start") + 1).cast("int"), (F.col("cut.end") - F.col("cut.start")).cast("int")).alias("token"))
    spans = spans.where(F.regexp_like("token", F.lit("[0-9]")) & F.regexp_like("token", F.lit("[A-Za-z]")))
    free = spans.where(~F.exists("base", lambda b: (b["start"] < F.col("span.end")) & (F.col("span.start") < b["end"])))
    kind = F.lit(None).cast("string")
    for name in reversed(ALPHABETS):
        kind = F.when(F.regexp_like("token", F.lit(ALPHABETS[name][0])), F.lit(name)).otherwise(kind)
    known = free.select("row", "span", "token", kind.alias("encoding"), F.char_length("token").alias("n")).where("encoding is not null and n >= 2")
    symbols, k = F.array().cast("array<int>"), F.lit(2)
    for name, (_, alphabet, fold) in ALPHABETS.items():
        own = F.col("encoding") == name
        symbols = F.when(own, _numbers(F.lower("token") if fold else F.col("token"), alphabet)).otherwise(symbols)
        k = F.when(own, len(alphabet)).otherwise(k)
    stratum = F.lit(0)
    for i, least in enumerate(LENGTHS):
        stratum = F.when(F.col("n") >= least, F.lit(i)).otherwise(stratum)
    numbered = known.select("row", F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.concat_ws(":", "encoding", stratum.cast("string")).alias("stratum"), F.filter(symbols, lambda x: x > 0).alias("symbols"), k.alias("k"))
    return with_p_value(numbered).drop("symbols", "k")


def thresholds(tokens: DataFrame) -> dict[str, float]:
    """For each stratum the smallest threshold whose share of false discoveries is allowed; from counts over all tokens."""
    grid = sorted(GRID)
    step = F.lit(0)
    for i, t in enumerate(grid, 1):
        step = F.when(F.col("p") > t, F.lit(i)).otherwise(step)
    counts: dict[str, list[int]] = {}
    for r in tokens.groupBy("stratum", step.alias("step")).agg(F.count("*").alias("n")).collect():  # len(GRID) + 1 rows a stratum
        counts.setdefault(r.stratum, [0] * (len(grid) + 1))[r.step] = r.n
    out = {}
    for stratum, n in counts.items():
        random = 2 * sum(n[len(grid) :])
        for i, t in enumerate(grid, 1):
            passed = sum(n[i:])
            if passed and max(0.0, passed - random * (1 - t)) <= FDR * passed:
                out[stratum] = t
                break
    return out


def spans(docs: DataFrame, work: Work) -> DataFrame:
    """docs with `_base` (spans of the base kinds) and `_spans` (those and random tokens); docs has text, and none of these names."""
    refuse(docs, "_base", "_spans", "_row", "_more")
    found = docs.withColumn("_base", base_spans(F.coalesce("text", F.lit(""))))
    return _with_random(found, work)


def _with_random(found: DataFrame, work: Work) -> DataFrame:
    """Add `_spans`. Only rows with candidates are joined back, by the row's own text hash."""
    key = F.sha2(F.col("text"), 256)
    holders = found.where(F.regexp_like("text", F.lit(_TOKEN))).select(key.alias("row"), "text", F.col("_base").alias("base")).dropDuplicates(["row"])
    tokens = work.table(candidates(holders), "tokens")
    limits = thresholds(tokens)
    if not limits:
        return found.withColumn("_spans", F.col("_base"))
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("stratum")]
    outer = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    passed = tokens.where(F.col("p") > limit).withColumn("_before", F.max("end").over(outer))
    kept = passed.where("_before is null or end > _before").groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("rank"), "end")).alias("_more"))
    joined = found.withColumn("_row", F.when(F.regexp_like("text", F.lit(_TOKEN)), key)).join(kept.withColumnRenamed("row", "_row"), "_row", "left")
    return joined.withColumn("_spans", F.sort_array(F.concat("_base", F.coalesce("_more", F.array().cast(_SPAN))))).drop("_row", "_more")


def joined(column: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, work: Work) -> DataFrame:
    """The columns of the query."""
    found = docs.select("doc_id", "text", base_spans(F.coalesce("text", F.lit(""))).alias("_base"))
    out = _with_random(found, work).select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return out.select("doc_id", *map(count, range(3)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, work: Work, mark: str = "[secret]") -> DataFrame:
    """Replace each span by a mark; overlapping spans are replaced together. Null text stays null.

    All other columns pass through, whatever their names: they travel as one struct beside the working columns.
    """
    found = spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), "text"), work)

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(s["start"], a["at"])
        piece = F.when(s["start"] >= a["at"], F.concat(F.substring("text", (a["at"] + 1).cast("int"), (start - a["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.aggregate("_spans", begin, step, lambda a: F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), F.lit(2147483647))))
    clean = found.withColumn("text", F.when(F.size("_spans") > 0, text).otherwise(F.col("text")))
    return clean.select(*(F.col("text") if c == "text" else F.col(f"_all.`{c}`").alias(c) for c in docs.columns))
