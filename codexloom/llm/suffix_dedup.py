"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts earlier.

Earlier means in a smaller doc_id, or in the same document at a smaller start. Suffixes are sorted by the
difference-cover method (sort sampled triples, recurse on their names, merge the remaining suffixes, compare
adjacent prefixes). To spread it, suffixes that can be equal over LENGTH bytes are brought together first:

1. Copies of a text, all but the first, are covered whole (or not at all, if shorter) and take no further part.
2. Anchors. Each LENGTH-byte window has an anchor value: the smallest hash of its GRAM-byte strings. Equal windows
   have equal values. Windows that follow each other with one value make a run. Values are counted over all
   documents; a run whose value occurs once holds nothing that repeats. A bitmap, sized by the number of repeated values
   and at most FEW * EACH bits, tells the rest (a false hit only costs a row); more values are joined to the documents.
3. Contexts. A run with its bytes is a context. Of equal contexts all but the first are covered whole; finding
   the first is an aggregation that combines before the shuffle, so a passage in a third of all documents is
   one row from each task.
4. Suffix arrays. The different contexts of one value meet in one task and are sorted in blocks of BLOCK bytes;
   of windows with equal prefixes all but the earliest are covered. A value with more than MANY different
   contexts, or more than BLOCK bytes of them, is not gathered: its contexts are cut by finer values, the anchor with the
   bytes on one side of it, and go through 3 and 4 again. What still has many is hashed and aggregated window by window.
5. Covered windows, as ranges by document, are joined to the texts.

Rows: null text is empty; a null doc_id comes before all others; repeated rows (same doc_id and text) are one
document and get the same result; different texts under one doc_id are ordered by their hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexloom.llm.common import Work, column_bytes, groups, per_batch, with_ids

#: Bytes of a repeated string, and of the strings whose hashes are anchors.
LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
HALF = WINDOW // 2
#: Bytes hashed at a time, bytes sorted at a time, contexts of a value that meet in a task.
SLICE, BLOCK, MANY = 1 << 19, 1 << 19, 2048
SEGMENT = 1 << 17
#: Symbols of a suffix array; repeated values up to which a bitmap tells them, and bits for each.
MOST, FEW, EACH = 1 << 20, 1 << 24, 8
#: Contexts that a task remembers so as to send their bytes once.
SENT = 200_000
NO_ID = -(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(77)) * _M1
    h ^= h >> np.uint64(32)
    size = 1
    while size < GRAM:
        h = h[:-size] * _M2 + h[size:] * _M1
        h ^= h >> np.uint64(31)
        size *= 2
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, first window, windows, whether the value's place moves) of each run of windows with one anchor value."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        h = gram_hashes(np.frombuffer(data, np.uint8, min(SLICE + LENGTH - 1, len(data) - at), at))
        low = sliding_min(h, WINDOW)
        start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        count = np.diff(np.append(start, len(low)))
        value = low[start]
        span = np.arange(WINDOW)
        first = start + (h[start[:, None] + span] == value[:, None]).argmax(1)
        end = start + count - 1
        last = end + (h[end[:, None] + span] == value[:, None]).argmax(1)
        out.append((value, start + at, count, first != last))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """Suffix array of positive integers up to top, by a difference cover modulo 3; for at most MOST of them, whose triples of names fit 64 bits."""
    n = len(s)
    if n > MOST:
        raise ValueError("too many symbols for one suffix array")
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    base = top + 1
    t = np.concatenate((s, np.zeros(4, np.int64)))
    # sorted triples at the sampled places; a place behind the end keeps both classes apart when their number needs it
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    key = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    name = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    if name[-1] < len(sample):
        names = np.empty(len(sample), np.int64)
        names[order] = name
        order = suffix_array(names, int(name[-1]))
    sampled = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    # the rest by first symbol and the rank behind it
    wide = n + 4
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * wide + rank[rest + 1], kind="stable")]
    # merge: how many sampled suffixes of either class are smaller than each of the rest
    a, b = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    less = np.searchsorted(t[a] * wide + rank[a + 1], t[rest] * wide + rank[rest + 1])
    less += np.searchsorted((t[b] * base + t[b + 1]) * wide + rank[b + 2], (t[rest] * base + t[rest + 1]) * wide + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = less + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = sampled
    return out


def later_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For contexts in order of place: the windows of each (offsets) that also begin earlier, by adjacent prefixes of the suffix array."""
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    joined[(starts + sizes)] = 257  # separators
    window = np.zeros(len(joined), bool)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        window[a : a + n - LENGTH + 1] = True
    order = suffix_array(joined, 257)
    order = order[window[order]]
    packed = np.zeros(len(joined) + 8, np.uint64)
    raw = np.concatenate((joined - 1, np.zeros(16, np.int64))).astype(np.uint64)
    for i in range(8):
        packed |= (raw[i : i + len(packed)] & np.uint64(255)) << np.uint64(8 * i)
    same = np.ones(len(order) - 1, bool)
    for i in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        left = np.flatnonzero(same)
        same[left] = packed[order[left] + i] == packed[order[left + 1] + i]
    group = np.concatenate(([0], np.cumsum(~same)))
    heads = np.concatenate(([0], np.flatnonzero(~same) + 1))
    covered = np.sort(order[order != np.minimum.reduceat(order, heads)[group]])
    cut = np.searchsorted(covered, np.append(starts, len(joined)))
    return [covered[cut[i] : cut[i + 1]] - starts[i] for i in range(len(contexts))]


def ranges(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Sorted offsets as (first, last) of unbroken ranges."""
    if not len(offsets):
        return []
    breaks = np.flatnonzero(np.diff(offsets) > 1)
    return list(zip(offsets[np.concatenate(([0], breaks + 1))].tolist(), offsets[np.append(breaks, len(offsets) - 1)].tolist(), strict=True))


def _bitmap(work: Work, values: DataFrame, size: int) -> bytes:
    """size bits with those of the values set; built by segments, of which each is bounded."""
    place = F.col("value").bitwiseAND(F.lit(size - 1))
    bits = values.select(F.shiftright(place, SEGMENT.bit_length() - 1).cast("int").alias("segment"), place.bitwiseAND(F.lit(SEGMENT - 1)).cast("int").alias("bit")).distinct()

    def build(batches):
        for g in groups(batches, ["segment"]):
            own = np.zeros(SEGMENT, np.uint8)
            own[g.column("bit").to_numpy()] = 1
            yield pa.RecordBatch.from_pydict({"segment": [g.column("segment")[0].as_py()], "bits": [np.packbits(own, bitorder="little").tobytes()]}, schema=pa.schema([("segment", pa.int32()), ("bits", pa.binary())]))

    parts = max(1, int(work.spark.conf.get("spark.sql.shuffle.partitions")))
    out = bytearray(size // 8)
    for r in bits.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(build, "segment int, bits binary").toLocalIterator():  # size / SEGMENT rows at most
        out[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = r.bits
    return bytes(out)


OCCURRENCE = pa.schema([("value", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("moves", pa.bool_()), ("context", pa.binary())])
COVERED = "doc long, tie long, first long, last long"


def _covered(pieces: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = zip(*pieces, strict=True) if pieces else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "tie", "first", "last"])


def covered_windows(work: Work, docs: DataFrame) -> DataFrame:
    """(doc, tie, first, last): ranges of starts of LENGTH-byte strings that also start earlier. docs: doc, tie, text of first copies."""
    spark = work.spark
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def values(batches):
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text in column_bytes(batch.column("text")):
                value, _, _, moves = runs(text)
                found += [value, value[moves]]  # a value that moves occurs twice
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["value"])

        yield from per_batch(one)(batches)

    repeated = docs.select("text").mapInArrow(values, "value long").groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    repeated = work.table(repeated, "repeated")
    n = repeated.count()
    size = max(SEGMENT, 1 << (n * EACH).bit_length())
    bitmap = spark.sparkContext.broadcast(_bitmap(work, repeated, size)) if n <= FEW else None  # at most FEW * EACH / 4 bytes
    if bitmap is None:
        docs = _with_hits(docs, repeated)

    def occurrences(batches):
        seen = np.frombuffer(bitmap.value, np.uint8) if bitmap else None
        sent: set[bytes] = set()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            known = batch.column("hits").to_pylist() if seen is None else [None] * batch.num_rows
            for doc, tie, text, hits in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), column_bytes(batch.column("text")), known, strict=True):
                value, start, count, moves = runs(text)
                place = value & np.uint64(size - 1)
                hit = np.isin(value.view(np.int64), hits or []) if seen is None else (seen[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                for v, p, n, m in zip(value[hit].view(np.int64).tolist(), start[hit].tolist(), count[hit].tolist(), moves[hit].tolist(), strict=True):
                    context = text[p : p + n + LENGTH - 1]
                    key = xxhash.xxh3_128_digest(context)
                    new = key not in sent
                    if new:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(key)
                    rows.append((v, int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), doc, tie, p, n, m, context if new else None))
            columns = zip(*rows, strict=True) if rows else [()] * len(OCCURRENCE)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OCCURRENCE.types, strict=True)], schema=OCCURRENCE)

        yield from per_batch(one)(batches)

    found = docs.mapInArrow(occurrences, "value long, k1 long, k2 long, doc long, tie long, p long, n long, moves boolean, context binary")
    return _resolve(work, work.table(found, "occurrences"))


def _resolve(work: Work, found: DataFrame, finer: bool = False) -> DataFrame:
    """(doc, tie, first, last) of occurrences: copies of contexts, then windows of different contexts of one value."""
    spark = work.spark
    parts, level = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "-finer" if finer else ""
    firsts = found.groupBy("value", "k1", "k2").agg(F.min(F.struct("doc", "tie", "p")).alias("f"), F.max("n").alias("n"), F.max("moves").alias("moves"))
    firsts = work.table(firsts.select("value", "k1", "k2", "f.doc", "f.tie", "f.p", "n", "moves"), f"firsts{level}")
    # all occurrences of a context but the first are covered whole
    copies = found.select("value", "k1", "k2", "doc", "tie", "p", "n").join(firsts.select("value", "k1", "k2", F.col("doc").alias("d0"), F.col("tie").alias("t0"), F.col("p").alias("p0")), ["value", "k1", "k2"])
    copies = copies.where("doc <> d0 or tie <> t0 or p <> p0").select("doc", "tie", F.col("p").alias("first"), (F.col("p") + F.col("n") - 1).alias("last"))
    # values with several contexts, or with windows that may repeat inside one
    facts = firsts.groupBy("value").agg(F.count("*").alias("m"), F.sum(F.col("n") + LENGTH).alias("size"), F.max("moves").alias("any"))
    many = (F.col("m") > MANY) | (F.col("size") > BLOCK)
    open_values = work.table(facts.where("m > 1 or any").select("value", many.alias("many")), f"open{level}")
    bodies = found.where("context is not null").select("value", "k1", "k2", "context")
    null = F.lit(None).cast("long")
    rows = firsts.select("value", "k1", "k2", "doc", "tie", "p", F.lit(None).cast("binary").alias("context")).unionByName(bodies.select("value", "k1", "k2", null.alias("doc"), null.alias("tie"), null.alias("p"), "context"))
    rows = with_ids(spark, rows, open_values, "inner", "value")

    def sort(batches):
        held, size = [], 0

        def flush():
            held.sort()
            out = []
            for (doc, tie, p, _), offsets in zip(held, later_windows([c for *_, c in held]), strict=True):
                out += [(doc, tie, p + a, p + b) for a, b in ranges(offsets)]
            return _covered(out)

        for g in groups(batches, ["value"]):
            own: dict[tuple[int, int], list] = {}
            for k1, k2, doc, tie, p, context in zip(*(g.column(c).to_pylist() for c in ("k1", "k2", "doc", "tie", "p", "context")), strict=True):
                entry = own.setdefault((k1, k2), [None, None])
                if context is not None:
                    entry[1] = context
                else:
                    entry[0] = (doc, tie, p)
            more = sum(len(context) + 1 for _, context in own.values())
            if held and size + more > BLOCK:
                yield flush()
                held, size = [], 0
            held += [(*place, context) for place, context in own.values()]
            size += more
        if held:
            yield flush()

    few = rows.where("not many").drop("many").repartition(parts, "value").sortWithinPartitions("value").mapInArrow(sort, COVERED)
    many = open_values.where("many").select("value")
    body = bodies.join(many, "value", "left_semi").dropDuplicates(["value", "k1", "k2"])
    placed = firsts.join(body, ["value", "k1", "k2"]).select("value", "doc", "tie", "p", "context")
    rest = _by_window(placed) if finer else _resolve(work, work.table(_finer(placed), "finer"), True)
    return copies.unionByName(few).unionByName(rest)


def _finer(placed: DataFrame) -> DataFrame:
    """Occurrences of finer values in contexts of a value that has many.

    A window's anchor stands at one of WINDOW places in it, so the window holds either HALF bytes before the anchor or as many
    behind it. Those with the anchor are the finer value: equal windows have equal ones, and what only stands beside a passage
    that many documents share falls away as a value that occurs once. Windows with one anchor and side make a run.
    """

    def run(batches):
        sent: set[bytes] = set()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for value, doc, tie, p, context in zip(*(batch.column(c).to_pylist() for c in ("value", "doc", "tie", "p", "context")), strict=True):
                grams = gram_hashes(np.frombuffer(context, np.uint8))
                at = np.flatnonzero(grams.view(np.int64) == value)
                window = np.arange(len(context) - LENGTH + 1)
                anchor = at[np.searchsorted(at, window)]
                side = anchor - window >= HALF
                start = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (side[1:] != side[:-1]))))
                for i, n in zip(start.tolist(), np.diff(np.append(start, len(window))).tolist(), strict=True):
                    j = int(anchor[i])
                    own = context[j - HALF : j + GRAM] if side[i] else context[j : j + GRAM + HALF]
                    new = xxhash.xxh3_64_intdigest(own + (b"<" if side[i] else b">"))
                    piece = context[i : i + n + LENGTH - 1]
                    key = xxhash.xxh3_128_digest(piece)
                    first = key not in sent
                    if first:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(key)
                    rows.append((new - (1 << 63), int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), doc, tie, p + i, n, False, piece if first else None))
            columns = zip(*rows, strict=True) if rows else [()] * len(OCCURRENCE)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OCCURRENCE.types, strict=True)], schema=OCCURRENCE)

        yield from per_batch(one)(batches)

    return placed.mapInArrow(run, "value long, k1 long, k2 long, doc long, tie long, p long, n long, moves boolean, context binary")




def _with_hits(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with the repeated values of each text, by a join: for more values than a bitmap may hold."""

    def run(batches):
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), column_bytes(batch.column("text")), strict=True):
                rows += [(doc, tie, v) for v in np.unique(runs(text)[0]).view(np.int64).tolist()]
            columns = zip(*rows, strict=True) if rows else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "tie", "value"])

        yield from per_batch(one)(batches)

    own = docs.mapInArrow(run, "doc long, tie long, value long").join(repeated, "value", "left_semi")
    return docs.join(own.groupBy("doc", "tie").agg(F.collect_list("value").alias("hits")), ["doc", "tie"])


def _by_window(placed: DataFrame) -> DataFrame:
    """Values with many contexts: each window is a row with its hash; all but the first of equal ones are covered."""

    def explode(batches):
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, tie, p, context in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "p", "context")), strict=True):
                for i in range(len(context) - LENGTH + 1):
                    rows.append((xxhash.xxh3_128_digest(context[i : i + LENGTH]), doc, tie, p + i))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["window", "doc", "tie", "p"])

        yield from per_batch(one)(batches)

    windows = placed.mapInArrow(explode, "window binary, doc long, tie long, p long")
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "tie", "p")).alias("f"), F.count("*").alias("m")).where("m > 1")
    later = windows.join(first, "window").where("f <> struct(doc, tie, p)")
    return later.select("doc", "tie", F.col("p").alias("first"), F.col("p").alias("last"))


def spans_of(covered: list[dict] | None, n: int, copy: bool) -> list[tuple[int, int]]:
    """Maximal removed byte ranges (start, end) of a text of n bytes."""
    if copy:
        return [(0, n)] if n >= LENGTH else []
    out: list[list[int]] = []
    for r in sorted((x["first"], x["last"]) for x in covered or ()):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1] + LENGTH)
        else:
            out.append([r[0], r[1] + LENGTH])
    return [(a, b) for a, b in out]


def marked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with `_covered` (ranges of window starts) and `_copy` (whether an earlier document has the same text)."""
    work = Work(spark, "suffix")
    keyed = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_tie", F.xxhash64("text"))
    keys = work.table(keyed.select("_doc", "_tie", F.xxhash64(F.lit(1), "text").alias("_more")), "keys")
    first = keys.groupBy("_tie", "_more").agg(F.min("_doc").alias("_first"), F.count("*").alias("_m")).where("_m > 1")
    copies = work.table(keys.join(first, ["_tie", "_more"]).where("_doc <> _first").select("_doc", "_tie").distinct(), "copies")
    base = with_ids(spark, keyed.select("_doc", "_tie", "text"), copies, "left_anti", ["_doc", "_tie"])
    base = base.where(F.octet_length("text") >= LENGTH).select(F.col("_doc").alias("doc"), F.col("_tie").alias("tie"), "text")
    covered = work.table(covered_windows(work, base), "covered")
    work.drop("occurrences", "firsts", "open", "repeated", "finer", "firsts-finer", "open-finer")
    by_doc = covered.distinct().groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list(F.struct("first", "last")).alias("_covered"))
    marks = by_doc.withColumn("_copy", F.lit(False)).unionByName(copies.select("_doc", "_tie", F.lit(None).cast(by_doc.schema["_covered"].dataType).alias("_covered"), F.lit(True).alias("_copy")))
    return keyed.join(marks, ["_doc", "_tie"], "left").withColumn("_copy", F.coalesce("_copy", F.lit(False))).select(*docs.columns, "_covered", "_copy")


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, covered, copy in zip(batch.column("doc_id").to_pylist(), column_bytes(batch.column("text")), batch.column("_covered").to_pylist(), batch.column("_copy").to_pylist(), strict=True):
            spans = spans_of(covered, len(text), copy)
            rows.append((doc, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return marked(spark, docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(per_batch(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def remove(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with the covered bytes taken out of text; bytes of characters cut in two go as well. Null text stays null.

    All other columns pass through, whatever their names: they travel as one struct beside the working columns.
    """
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, covered, copy, null in zip(column_bytes(batch.column("text")), batch.column("_covered").to_pylist(), batch.column("_copy").to_pylist(), batch.column("text").is_null().to_pylist(), strict=True):
            spans = spans_of(covered, len(text), copy)
            texts.append(None if null else _kept(text, spans).decode("utf-8", "ignore") if spans else text.decode())
        return pa.RecordBatch.from_arrays([batch.column("_all"), pa.array(texts, pa.string())], ["_all", "_text"])

    others = [c for c in names if c != "text"]  # the text itself needs no second copy
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_all"), "doc_id", "text")
    found = marked(spark, held)
    clean = found.mapInArrow(per_batch(run), T.StructType([held.schema["_all"], T.StructField("_text", T.StringType())]))
    return clean.select(*(F.col("_text").alias(c) if c == "text" else F.col(f"_all.`{c}`").alias(c) for c in names))
