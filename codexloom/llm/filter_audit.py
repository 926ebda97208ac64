"""Filter interaction audit: what each of five filters removes, in every order, and what it shares with the others.

One pass over the texts gives each document a mask of the filters it fails by itself (A: few words, B: few distinct words,
C: many capitals, D: signs of markup) and what the search for copies needs. The audit counts documents by part and
mask once (32 masks, with the labels' counts), so the 120 orders are sums over masks and never touch documents again.

Copies (filter E) by partition refinement: documents are split by length in code points, then by the hash of one block of
the text after another (each block is BLOCK_GROWTH times as long as the one before, so their number grows with the
logarithm of the longest text); classes of one document are dropped in each round, classes whose texts have ended are
finished. All blocks are hashed in the first pass, so the rounds read a few numbers of a document. The texts of finished
classes are then compared whole: one aggregation by class and text that combines copies before it shuffles, so a
text with a third of all rows stays small. Where a class has one text, its documents with an id above the smallest fail E
through the class; where texts collide in a class, through the text itself.

Rows: null text is empty (its copies are copies); null part (lang) is the empty string; a null doc_id neither fails E nor makes
others fail it; rows of one doc_id are not copies of each other; repeated rows count each; of repeated labels of a
document any 1 counts, labels other than 1 and missing ones count as 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.llm.common import Work, with_ids

#: The filters in the order of their mask bits, and all orders of them.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Code points of a text's first block, and how many times longer each next block is.
BLOCK, BLOCK_GROWTH = 256, 4
#: White space between words.
BLANKS = "[\\x20\\x09-\\x0D]+"


def places() -> list[tuple[int, int]]:
    """(begin, length) in code points of all blocks that a string can have."""
    out, begin, length = [], 0, BLOCK
    while begin < 1 << 31:
        out.append((begin, min(length, (1 << 31) - 1)))
        begin, length = begin + length, length * BLOCK_GROWTH
    return out


def described(docs: DataFrame, part: str = "lang", hashed=F.xxhash64) -> DataFrame:
    """doc_id, part, fails (mask of A to D), length, blocks (hashes of the text's blocks, one at least), class (of length and blocks), text."""
    texts = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = texts.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    n = split.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("n_distinct"), F.char_length("text").cast("long").alias("length"))
    tests = (F.col("n") < 200, F.col("n_distinct") * 100 < F.col("n") * 50, F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.col("length") * 3, F.col("text").rlike("[#$%&*|]"))
    mask = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))
    begins = F.filter(F.array(*(F.struct(F.lit(b).cast("long").alias("begin"), F.lit(k).alias("size")) for b, k in places())), lambda x: x.begin < F.greatest(F.col("length"), F.lit(1)))
    blocks = F.transform(begins, lambda x: hashed(F.substring(F.col("text"), (x.begin + 1).cast("int"), x.size)))
    out = n.select("doc_id", "part", mask.alias("fails"), "length", blocks.alias("blocks"), "text")
    return out.withColumn("class", F.aggregate("blocks", first_class(), next_class))


def first_class() -> Column:
    return F.xxhash64("length")


def next_class(before: Column, block: Column) -> Column:
    return F.xxhash64(before, block)


def refined(known: DataFrame, work: Work) -> DataFrame:
    """(class): the finished classes of documents that share their length and every block's hash with another; known: length, blocks."""
    alive = known.select(first_class().alias("class"), "blocks")
    finished = work.table(alive.select("class").limit(0), "finished")
    while True:
        many = work.table(alive.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "classes")
        if many.isEmpty():
            return finished
        kept = with_ids(work.spark, alive, many, on="class")
        ended = kept.where("size(blocks) = 0").select("class").distinct()
        finished = finished.unionAll(work.table(ended, "ended"))
        going = kept.where("size(blocks) > 0").select(next_class(F.col("class"), F.element_at("blocks", 1)).alias("class"), F.expr("slice(blocks, 2, size(blocks) - 1)").alias("blocks"))
        alive = work.table(going, "alive")


def masks(docs: DataFrame, work: Work, part: str = "lang", hashed=F.xxhash64) -> DataFrame:
    """doc_id, part, mask (bits of FILTERS that the document fails)."""
    found = described(docs, part, hashed)
    known = work.table(found.drop("text"), "known")
    classes = refined(known, work)
    copies = with_ids(work.spark, found.select("doc_id", "class", "text"), classes, on="class")
    texts = copies.groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    firsts = work.table(texts.groupBy("class").agg(F.count("*").alias("texts"), F.min("first").alias("first")), "firsts")
    one, met = firsts.where("texts = 1").select("class", "first"), firsts.where("texts > 1").select("class")
    fails_e = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mask = F.col("fails") + F.when(fails_e, 1 << FILTERS.index("E")).otherwise(0)
    if met.isEmpty():
        return with_ids(work.spark, known, one, "left", "class").select("doc_id", "part", mask.alias("mask"))
    apart = with_ids(work.spark, found, met, on="class").join(texts.where("first is not null"), ["class", "text"], "left")
    rest = with_ids(work.spark, with_ids(work.spark, known, met, "left_anti", "class"), one, "left", "class")
    return rest.select("doc_id", "part", mask.alias("mask")).unionAll(apart.select("doc_id", "part", mask.alias("mask")))


def audit(docs: DataFrame, labels: DataFrame, work: Work, part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step; see the counts below."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c) for c in ("quality", "toxic")))
    rows = masks(docs, work, part).join(marks, "doc_id", "left")
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("quality", "toxic")))
    held = work.table(counted, "counted").groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("held"))  # 32 masks at most
    orders = held.select("part", "held", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = orders.select("part", "held", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda at: sum((F.when(at == F.instr("filter_order", f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    before = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("own", bit(F.col("step"))).withColumn("before", before)

    def total(test, what: str = "n", weight=lambda x: F.lit(1)) -> Column:
        some = F.filter("held", lambda x: test(x.mask))
        return F.aggregate(some, F.lit(0).cast("long"), lambda s, x: s + x[what] * weight(x.mask))

    own, before = F.col("own"), F.col("before")
    failing = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: failing(m) & (m.bitwiseAND(before) == 0)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: failing(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(here, "quality").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        # of the orders, each filter that a document fails comes first among those in an equal share
        total(failing, weight=lambda m: (F.lit(len(ORDERS)) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


#: The same in DuckDB's SQL: all orders by a join of letters, copies by a window over texts, shapley summed over the orders.
SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS quality, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic,
    len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > smallest, false) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, sum(quality) AS quality, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
o AS (SELECT concat(x1.s, x2.s, x3.s, x4.s, x5.s) AS filter_order FROM x x1, x x2, x x3, x x4, x x5
  WHERE len(list_distinct([x1.s, x2.s, x3.s, x4.s, x5.s])) = 5),
p AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT m.part, p.filter_order, p.step, p.own,
    length(translate(m.failed, p.before, '')) < length(m.failed) AS gone, contains(m.failed, p.own) AS fails, m.failed, m.n, m.quality, m.toxic
  FROM m, p),
g AS (SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN NOT gone AND fails THEN quality ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""
