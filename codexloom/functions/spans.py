"""Places of regular-expression matches, and folds over sorted spans; JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexloom.functions.text import let

SPAN = "array<struct<start: int, end: int, kind: string, value: string>>"


#: Signs that are no characters: marks around matches, and what stands for them where a text holds them itself.
MARK, STAND_IN = "\uffff", "\ufffe"


def places(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Matches in order as struct(start, end, kind, value); offsets in characters, end exclusive.

    One pass of the pattern puts marks around its matches; the pieces between marks tell where each match stands. With a
    group, the span is the group's, which must end the match.
    """
    every = 3 if group else 2  # pieces for each match: the text before it, the match, its group
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)
    marked = F.regexp_replace(clean, F.lit(pattern), F.lit(f"{MARK}$0{MARK}" + (f"${group}{MARK}" if group else "")))
    none = F.array().cast(SPAN)

    def spans(x: Column) -> Column:
        pieces = x["pieces"]

        def step(a: Column, i: Column) -> Column:
            end = (a["at"] + F.char_length(F.get(pieces, i)) + F.char_length(F.get(pieces, i + 1))).cast("int")
            found = F.get(pieces, i + every - 1)
            start = (end - F.char_length(found)).cast("int")
            value = F.when(x["held"], F.substring(text, start + 1, end - start)).otherwise(found)
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value")))).alias("out"))

        firsts = F.sequence(F.lit(0), F.size(pieces) - 2, F.lit(every))
        return F.when(F.size(pieces) > 1, F.aggregate(firsts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])).otherwise(none)

    return let(F.struct(F.split(marked, MARK).alias("pieces"), F.contains(text, F.lit(MARK)).alias("held")), spans)


def without_overlaps(spans: Column) -> Column:
    """Left to right, of two spans that overlap the longer one stays (the first of equals)."""
    size = lambda s: s["end"] - s["start"]
    order = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(size(y) - size(x))

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        return F.when((F.size(a) == 0) | (s["start"] >= last["end"]), F.concat(a, F.array(s))).when(size(s) > size(last), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(s))).otherwise(a)

    def folded(all_: Column) -> Column:
        return F.when(F.size(all_) > 1, F.aggregate(F.array_sort(all_, order), F.array().cast(SPAN), lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(step(a, s)))).otherwise(all_)

    return let(spans, folded)


def outside(spans: Column, occupied: Column) -> Column:
    """Spans that lie inside none of the occupied ones."""
    return F.filter(spans, lambda s: ~F.exists(occupied, lambda o: (s["start"] >= o["start"]) & (s["end"] <= o["end"])))


def numbered(spans: Column, kinds: list[str]) -> Column:
    """Spans in order with `nth`: the place among those of its kind, counted from the right."""

    def of(kind: str) -> Column:
        own = F.filter(spans, lambda s: s["kind"] == kind)
        return F.transform(F.reverse(own), lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), (i + 1).alias("nth")))

    return F.array_sort(F.concat(*map(of, kinds)))


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each span replaced by mark(span); spans are sorted and don't overlap."""
    before = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), mark(s)))
    tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.lit(2147483647))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
