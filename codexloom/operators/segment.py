"""Hierarchical segmentation of document lines: Phần, Chương, Mục, Điều, Khoản, Điểm.

Which line opens what depends on the lines before it: quotations hide headings, and a heading inside one would open
nothing. The rules are a state machine of a few small values. Columns tell what each line looks like; a document's lines then
pass the machine in order, in Arrow batches, and the text of open nodes alone is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexloom.functions.identifiers import any_of
from codexloom.sources.shared import dealt

#: Beginnings of preamble lines, and marks of the closing block. Fixed values.
PREAMBLE = ["Căn cứ", "Theo đề nghị", "Xét đề nghị", "Thực hiện", "Quốc hội nước", "Chính phủ nước"]
CLOSING = ["Nơi nhận:", "TM. CHÍNH PHỦ", "TM. BỘ", "KT.", "CHỦ TỊCH", "BỘ TRƯỞNG", "TỔNG CỤC TRƯỞNG"]
#: Patterns of structural lines; quotation marks, and those that begin a quoted line. Fixed values.
PART = r"(?iuU)^Phần\s+(?:thứ\s+\w+|[IVX]+)"
CHAPTER = r"(?iuU)^Chương\s+([IVXLCDM]+)\s*[.:]?\s*(.*)$"
SECTION = r"(?iuU)^Mục\s+(\d+)[.:]?\s*(.*)$"
ARTICLE = r"(?iuU)^[ĐÐð][iíìĩị]ều\s+(?:thứ\s+)?(\d+[a-z]*)[.\s:]\s*(.*)$"
CLAUSE = r"(?iuU)^(\d+[a-z]*)\.\s+(.+)$"
POINT = r"(?U)^([a-zđ]|[ivxlcdm]+)\)\s+(.+)$"
MARKS, OPENING = '["“”«»]', '^["“«]'


def is_preamble(line: Column) -> Column:
    return reduce(Column.__or__, (F.startswith(line, F.lit(m)) for m in PREAMBLE))


def is_closing(line: Column) -> Column:
    return any_of(line, CLOSING)


def _candidate(line: Column, law: Column) -> Column:
    """The number of what a line would open if the state allowed it; a line that looks like several is the first. A cheap look at the
    first letter, or for a sign that the pattern needs, goes before each pattern."""
    first = F.substring(line, 1, 1)
    return (
        F.when(law & first.isin("P", "p") & F.regexp_like(line, F.lit(PART)), _PART)
        .when(first.isin("C", "c") & F.regexp_like(line, F.lit(CHAPTER)), _CHAPTER)
        .when(first.isin("M", "m") & F.regexp_like(line, F.lit(SECTION)), _SECTION)
        .when(first.isin("Đ", "đ", "Ð", "ð") & F.regexp_like(line, F.lit(ARTICLE)), _ARTICLE)
        .when(F.contains(line, F.lit(".")) & F.regexp_like(line, F.lit(CLAUSE)), _CLAUSE)
        .when(F.contains(line, F.lit(")")) & F.regexp_like(line, F.lit(POINT)), _POINT)
        .otherwise(0)
    )


#: Kinds of lines by number, and the marks beside them in a line's code.
KINDS = ["text", "part", "chapter", "section", "article", "clause", "point"]
_PART, _CHAPTER, _SECTION, _ARTICLE, _CLAUSE, _POINT = range(1, 7)
ODD, STARTS, CLOSES = 8, 16, 32


class _Fold:
    """The state machine over lines in order: which line opens a node, and to which node the others belong. It holds what is open alone."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.chapter = self.node = None
        self.begin(None)

    def begin(self, doc) -> None:
        self.flush(chapter=True)
        self.doc, self.i, self.number = doc, -1, 0
        self.done = self.quoted = self.some = self.part = False
        self.section = self.a = self.k = None

    def flush(self, chapter: bool) -> None:
        """What can get no more lines goes out; a chapter goes on after its sections."""
        if self.node is not None and self.node is not self.chapter:
            self.out.append((*self.node[:-1], "\n".join(self.node[-1])))
        if chapter and self.chapter is not None:
            self.out.append((*self.chapter[:-1], "\n".join(self.chapter[-1])))
            self.chapter = None
        self.node = None

    def line(self, code: int, line: str, number: str | None) -> None:
        self.i += 1
        if self.done or (code & CLOSES and self.some):
            self.done = True
            return
        kind, odd, starts = code & 7, bool(code & ODD), code & STARTS
        if self.quoted or starts or (kind == _CLAUSE and self.a is None) or (kind == _POINT and self.k is None):
            kind = 0
        if self.quoted:
            self.quoted = not odd
        elif starts:
            self.quoted = odd
        else:
            self.quoted = odd and kind == 0 and (self.part or self.chapter is not None or self.a is not None)
        if kind:
            self.open(kind, line, number)
        elif self.node is not None:
            self.node[-1].append(line)

    def open(self, kind: int, line: str, number: str | None) -> None:
        self.flush(chapter=kind in (_PART, _CHAPTER))
        if kind <= _SECTION:
            self.a = self.k = None
            if kind == _SECTION:  # its own line belongs to no node, later ones to the chapter
                self.section, self.node = line, self.chapter
                return
            self.section = None
            if kind == _PART:  # takes lines, but is no node
                self.part = True
                return
            self.number += 1
        elif kind == _ARTICLE:
            self.a, self.k, self.some = number, None, True
        elif kind == _CLAUSE:
            self.k = number
        roman, n = (number, self.number) if kind == _CHAPTER else self.chapter[4:6] if self.chapter is not None else (None, None)
        self.node = [self.doc, self.i, KINDS[kind], line, roman, n, self.section, self.a, self.k, [line]]
        if kind == _CHAPTER:
            self.chapter = self.node


_NODE = "seq long, kind string, line string, roman string, chapter int, section string, a string, k string, text string"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of lines(doc_id, code, line, number) that come by document and position, as the fold closes them."""
    fold, last, first, schema = _Fold(), None, True, None
    types = [pa.int64(), *[pa.string()] * 3, pa.int32(), *[pa.string()] * 4]
    names = [x.split()[0] for x in _NODE.split(", ")]

    def taken() -> pa.RecordBatch:
        columns = list(zip(*fold.out, strict=True)) or [()] * (len(types) + 1)
        fold.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [schema, *types], strict=True)], names=["doc_id", *names])

    for batch in batches:
        schema = batch.column("doc_id").type
        for doc, code, line, number in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "code", "line", "number")), strict=True):
            if first or doc != last:
                fold.begin(doc)
                last, first = doc, False
            fold.line(code, line, number)
        yield taken()
    if not first:
        fold.begin(None)
        yield taken()


def segments(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, level, idx, uid, parent_uid, path, title, section, text) of lines(doc_id, pos, line[, kind]).

    Levels are chapter, article, clause and point. `kind` is the document's type: only laws have parts. A Khoản
    needs an open Điều and a Điểm an open Khoản; a Phần, Chương or Mục closes the Điều, a Điều the Khoản. Other lines
    continue the deepest open node, a Phần's or a Mục's own line none. Inside a quotation nothing opens. The first
    closing line after a Điều ends the document.
    """
    law = F.contains(F.lower(F.coalesce("kind", F.lit(""))), F.lit("luật")) if "kind" in lines.columns else F.lit(False)
    line = F.trim("line")
    rows = lines.withColumn("_law", law).withColumn("line", line).where((line != "") & ~is_preamble(line))
    rows = rows.select("doc_id", "pos", "line", _candidate(F.col("line"), F.col("_law")).alias("_kind"))
    kind, text = F.col("_kind"), F.col("line")
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    quotes = F.char_length(text) - F.char_length(F.translate(text, MARKS[1:-1], ""))
    code = kind + flag(quotes % 2 == 1, ODD) + flag((quotes > 0) & F.regexp_like(text, F.lit(OPENING)), STARTS) + flag(is_closing(text), CLOSES)
    number = F.when(kind == _CHAPTER, F.regexp_extract(text, CHAPTER, 1)).when(kind == _ARTICLE, F.regexp_extract(text, ARTICLE, 1)).when(kind == _CLAUSE, F.regexp_extract(text, CLAUSE, 1))
    # a document's lines follow each other in one task, which holds the open nodes alone
    ordered = dealt(rows.select("doc_id", "pos", code.alias("code"), "line", number.alias("number")), "doc_id").sortWithinPartitions("doc_id", "pos", "line")
    schema = T.StructType([lines.schema["doc_id"], *T.StructType.fromDDL(_NODE).fields])
    nodes = ordered.select("doc_id", "code", "line", "number").mapInArrow(_nodes, schema)
    doc, null, level = F.col("doc_id"), F.lit(None).cast("string"), F.col("kind")
    point = F.regexp_extract("line", POINT, 1)
    chapter_uid = F.when(F.col("chapter").isNotNull(), F.concat_ws("_", F.lit("doc"), doc.cast("string"), F.lit("chương"), F.col("chapter").cast("string")))
    # numbers and letters as the patterns give them need none of build_uid's cleaning
    uid = lambda *parts: F.concat_ws("_", F.lit("doc"), doc.cast("string"), *(F.concat(F.lit(f"{w}_"), c) for w, c in zip(("dieu", "khoan", "diem"), parts, strict=False)))
    article, clause = uid(F.col("a")), uid(F.col("a"), F.col("k"))
    path = F.concat(F.when(F.col("roman") != "", F.concat(F.lit("Chương "), "roman", F.lit(" / "))).otherwise(F.lit("")), F.lit("Điều "), "a")
    to_clause = F.concat(path, F.lit(" / Khoản "), "k")

    def by_level(chapter_: Column, article_: Column, clause_: Column, point_: Column) -> Column:
        return F.when(level == "chapter", chapter_).when(level == "article", article_).when(level == "clause", clause_).otherwise(point_)

    return nodes.select(
        "doc_id",
        "seq",
        level.alias("level"),
        by_level(F.col("chapter").cast("string"), F.col("a"), F.col("k"), point).alias("idx"),
        by_level(chapter_uid, article, clause, uid(F.col("a"), F.col("k"), point)).alias("uid"),
        by_level(null, chapter_uid, article, clause).alias("parent_uid"),
        by_level(null, path, to_clause, F.concat(to_clause, F.lit(" / Điểm "), point)).alias("path"),
        by_level(F.regexp_extract("line", CHAPTER, 2), F.regexp_extract("line", ARTICLE, 2), null, null).alias("title"),
        F.when(level == "article", F.col("section")).alias("section"),
        "text",
    )


def parsed(lines: DataFrame, most: int = 200_000) -> DataFrame:
    """(doc_id, segments, articles, parse_error): a row for each document; what can't be parsed says why and fails nothing else.

    A document whose lines have no position, share one, have no text at all or are more than `most` isn't segmented; nor does it reach
    the fold. One without any segment says so.
    """
    null = F.lit(None).cast("string")
    error = (
        F.when(F.count("*") > most, F.lit(f"more than {most} lines"))
        .when(F.count_if(F.col("pos").isNull()) > 0, F.lit("a line has no position"))
        .when(F.count("pos") > F.count_distinct("pos"), F.lit("lines share a position"))
        .when(F.count_if(F.trim("line") != "") == 0, F.lit("no text"))
        .otherwise(null)
    )
    docs = lines.groupBy("doc_id").agg(error.alias("_error"))
    good = lines.join(docs.where("_error is null").select("doc_id"), "doc_id", "left_semi")
    found = segments(good).groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_if(F.col("level") == "article").alias("articles"))
    out = docs.join(found, "doc_id", "left")
    nothing = F.when(F.col("segments").isNull(), F.lit("no segment"))
    return out.select("doc_id", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("_error", nothing).alias("parse_error"))


def confidence(parsed: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, confidence): weighted share of expected articles, of articles with clauses, of kept parents."""
    n = lambda level: F.count_if(F.col("level") == level)
    with_clauses = F.count_distinct(F.when(F.col("level") == "clause", F.col("parent_uid")))
    lost = F.count_if(F.col("level").isin("clause", "point") & F.col("parent_uid").isNull())
    facts = parsed.groupBy("doc_id").agg(n("article").alias("articles"), n("chapter").alias("chapters"), with_clauses.alias("with_clauses"), F.count_if(F.col("level").isin("clause", "point")).alias("children"), lost.alias("lost"))
    facts = facts.join(expected, "doc_id", "left") if expected is not None else facts.withColumn("expected", F.lit(None).cast("long"))
    ratio = F.when(F.coalesce("expected", F.lit(0)) == 0, 0.8).otherwise(F.least(F.try_divide("articles", "expected"), F.lit(1.0)))
    clauses = F.least(F.coalesce(F.try_divide("with_clauses", "articles"), F.lit(0.0)) / 0.25, F.lit(1.0))
    kept = F.when(F.col("children") == 0, 1.0).otherwise(1 - F.try_divide("lost", "children"))
    score = F.when((F.col("articles") == 0) & (F.col("chapters") == 0), 0.0).otherwise(ratio * 0.50 + clauses * 0.20 + F.lit(0.15) + kept * 0.15)
    out = facts.select("doc_id", score.alias("score"))
    return out.withColumn("confidence", F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.6, "medium").otherwise("low"))


