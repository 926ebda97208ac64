"""Spelling variants: words one edit apart, by two-dimensional range reporting, and the commoner form of each.

1. Words. Each task counts the letter runs of its texts (with the marks of `altered`) in a table that it hands on when it is
   full; one aggregation adds the counts. Counting is by word, so common words cost one row a task.
2. Blocks. A word of q letters meets words of q and q + 1 letters. An edit position lies in [0, q // 2) or in [q // 2, q], and
   words that differ there alone share what is before and behind these positions: a block is (q, a, b, shared letters).
   A block of more than BLOCK words is cut at the middle of its positions, again and again, each half with more shared
   letters; at one position a block has no more words than the alphabet allows. So any number of words that begin or end alike
   is spread, and every pair of words one edit apart is in exactly one block with its edit.
3. Range reporting. In a block the words, without what they share, are sorted forwards, and by their reversed letters. For each
   edit position the words with the same letters before it are an interval of the forward order, and those with the same
   letters behind it one of the reverse order. A wavelet matrix over the words in forward order, holding places in the
   reverse order, reports those in both: replaced letters from the words of q letters, inserted ones from those of q + 1. Intervals of
   all words and positions go down the matrix together, a level at a time.
4. Forms. A word's form is its near word of largest n, if that n is twice its own or more; n at least doubles along forms, so
   there are no cycles, and roots are found by pointer doubling in a number of joins that is the logarithm of the logarithm of the largest n.

Rows: null or empty text has no words; repeated rows count each; a null doc_id counts as an empty one in marks; ties between forms go to the
smallest word in code-point order; an empty table gives no rows; other columns are not read. Memory: a table of CACHED words, or one batch
of blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.llm.common import Work, column_bytes, with_ids

#: Letters of words, fewest letters and fewest occurrences of a word, and the share of runs (one in ALTER) that `altered` marks.
LETTERS, SHORTEST, FEWEST, ALTER = "[A-Za-zÀ-ÿ]+", 5, 3, 97
#: Words in a task's table of counts, words in a block, letters of the windows of a batch, intervals that go down together.
CACHED, BLOCK, CELLS, QUERIES = 400_000, 32_768, 1 << 20, 1 << 18


def altered(run: str, mark: int) -> str:
    """The run without one letter where its mark says so."""
    if mark % ALTER:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with marks by doc_id; at least SHORTEST letters and FEWEST occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = re.compile(LETTERS).findall, {}
        full = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch.column("text")), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(found(text.lower().decode())).items():  # of bytes: A-Z alone
                    mark = zlib.crc32(word.encode(), start)
                    if not mark % ALTER:
                        word = altered(word, mark)
                    if len(word) >= SHORTEST:
                        total[word] = total.get(word, 0) + n
                if len(total) >= CACHED:
                    yield full()
                    total.clear()
        if total:
            yield full()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


class Wavelet:
    """A wavelet matrix over a permutation: which values in [low, high) stand at places in [first, stop)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place, by level; their number last
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            values = np.concatenate((values[~one], values[one]))

    def report(self, first: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values found; the intervals are arrays, one entry a query."""
        query = np.flatnonzero((first < stop) & (low < high))
        first, stop, head = first[query], stop[query], np.zeros(len(query), np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = self.bits - 1 - level
            to = zeros[first], zeros[stop]
            sides = []
            for side, (i, j) in enumerate((to, (first - to[0] + zeros[-1], stop - to[1] + zeros[-1]))):
                value = (head << 1) | side
                kept = np.flatnonzero((i < j) & (value << bit < high[query]) & ((value + 1) << bit > low[query]))
                sides.append((query[kept], i[kept], j[kept], value[kept]))
            query, first, stop, head = (np.concatenate(x) for x in zip(*sides, strict=True))
        return query, head


def _order(windows: list[str], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by block and letters, and for each the letters it shares with the one before (-1: another block)."""
    keyed = [f"{b:08x}{w}" for b, w in zip(block.tolist(), windows, strict=True)]
    order = np.array(sorted(range(len(keyed)), key=keyed.__getitem__), np.int64)
    width = max(1, max(map(len, windows)))
    letters = np.array(windows, f"<U{width}").view(np.uint32).reshape(len(windows), width)[order]
    same = letters[1:] == letters[:-1]
    shared = np.where(same.all(1), width, same.argmin(1))
    shared[block[order][1:] != block[order][:-1]] = -1
    return order, np.concatenate(([-1], shared))


def _intervals(shared: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in an order the first and the stop of the places that share so many letters with it."""
    begins = shared < letters
    starts = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    return starts[run], np.append(starts[1:], len(shared))[run]


def edits(windows: list[str], block: np.ndarray, longer: np.ndarray, positions: int, end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, near, position, inserted) of all words one edit apart in the same block.

    windows: what the words of a block don't share, of `positions` letters, or one more where longer. Replaced letters are
    reported from both words; inserted ones from the shorter word, at each position where the letter can be, the last one only with `end`.
    """
    forward, f_shared = _order(windows, block)
    backward, b_shared = _order([w[::-1] for w in windows], block)
    n = len(windows)
    f_place, b_place = np.empty(n, np.int64), np.empty(n, np.int64)
    f_place[forward], b_place[backward] = np.arange(n), np.arange(n)
    asks = np.flatnonzero(~longer)
    out = []
    for inserted in (False, True):
        target = longer if inserted else ~longer
        f_rank, b_rank = (np.concatenate(([0], np.cumsum(target[order]))) for order in (forward, backward))
        back = backward[target[backward]]  # words by their place among the targets, in reverse order
        if not len(back) or not len(asks):
            continue
        targets = forward[target[forward]]
        tree = Wavelet(b_rank[b_place[targets]])
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(held=held, tree=tree, back=back, inserted=inserted):
            if held:
                ask, at, *bounds = (np.concatenate(x) for x in zip(*held, strict=True))
                query, value = tree.report(*bounds)
                word, near = ask[query], back[value]
                other = word != near
                out.append((word[other], near[other], at[query][other], np.full(other.sum(), inserted)))
                held.clear()

        for at in range(positions + (inserted and end)):
            behind = positions - at - (not inserted)
            first, stop = (f_rank[x[f_place[asks]]] for x in _intervals(f_shared, at))
            low, high = (b_rank[x[b_place[asks]]] for x in _intervals(b_shared, behind))
            some = np.flatnonzero((stop - first > (not inserted)) & (high - low > (not inserted)))  # more than the word itself
            held.append((asks[some], np.full(len(some), at), first[some], stop[some], low[some], high[some]))
            size += len(some)
            if size >= QUERIES:
                flush()
                size = 0
        flush()
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _members(rows: DataFrame, cuts) -> DataFrame:
    """rows (word, n, q) in blocks: q, a, b, key, word, n. cuts: (a, b) columns of each row."""
    length = F.char_length("word")
    ways = F.explode(F.array(*(F.struct(F.col("q") if isinstance(q, str) else q, a.cast("int").alias("a"), b.cast("int").alias("b")) for q, a, b in cuts)))
    rows = rows.select("word", "n", ways.alias("way")).select("word", "n", "way.*")
    behind = F.col("q") - F.col("b")
    key = F.xxhash64("q", "a", "b", F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), length - behind + 1, behind))
    return rows.select("q", "a", "b", key.alias("key"), "word", "n")


def blocks(words: DataFrame, work: Work, block: int = BLOCK) -> DataFrame:
    """q, a, b, key, word, n: every word in the blocks where it may be edited, no block larger than `block` if it can be cut."""
    length, half = F.char_length("word"), lambda q: F.floor(q / 2)
    cuts = [(q.cast("int").alias("q"), a, b) for q in (length, length - 1) for a, b in ((F.lit(0), half(q)), (half(q), q))]
    members = work.table(_members(words, cuts), "members")
    done = members.limit(0)
    while True:
        sizes = members.groupBy("q", "a", "b", "key").agg(F.count("*").alias("m")).where((F.col("m") > block) & (F.col("b") - F.col("a") > 1))
        large = work.table(sizes.drop("m"), "large")
        if large.isEmpty():
            return done.unionAll(members)
        on = ["q", "a", "b", "key"]
        done = done.unionAll(work.table(with_ids(work.spark, members, large, "left_anti", on), "kept"))
        middle = F.floor((F.col("a") + F.col("b")) / 2)
        members = work.table(_members(with_ids(work.spark, members, large, on=on), [("q", F.col("a"), middle), ("q", middle, F.col("b"))]), "members")


def near(words: DataFrame, work: Work, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): all pairs of words one edit apart, each in both directions, once. words: word, n."""
    on = ["positions", "end", "q", "a", "b", "key"]
    rows = blocks(words, work, block).withColumns({"positions": F.col("b") - F.col("a"), "end": F.col("b") == F.col("q")})

    def batch(table: pa.Table) -> pa.RecordBatch:
        q, a, b, key, word, n = (table.column(c).to_pylist() for c in ("q", "a", "b", "key", "word", "n"))
        owners = list(zip(q, a, b, key, strict=True))
        block = np.cumsum([i > 0 and x != owners[i - 1] for i, x in enumerate(owners)])
        longer = np.array([len(w) > k for w, k in zip(word, q, strict=True)])
        windows = [w[i : len(w) - k + j] for w, i, j, k in zip(word, a, b, q, strict=True)]
        left, right, at, inserted = edits(windows, block, longer, b[0] - a[0], b[0] == q[0])
        pairs: list[tuple[int, int]] = []
        for i, j, k, new in zip(left.tolist(), right.tolist(), at.tolist(), inserted.tolist(), strict=True):
            if not new:
                pairs.append((i, j))
            else:  # of a run of equal letters the first is the new one
                k += a[i]
                if not k or word[i][k - 1] != word[j][k]:
                    pairs += [(i, j), (j, i)]
        return pa.RecordBatch.from_arrays([pa.array([word[i] for i, _ in pairs], pa.string()), pa.array([word[j] for _, j in pairs], pa.string()), pa.array([n[j] for _, j in pairs], pa.int64())], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches(batches, on):
            yield batch(table)

    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "q", "a", "b", "key").sortWithinPartitions(*on).mapInArrow(run, "word string, near string, near_n long")


def _batches(batches: Iterator[pa.RecordBatch], on: list[str]) -> Iterator[pa.Table]:
    """Whole blocks of equal positions and end from sorted rows, up to CELLS letters of windows (a block at least); blocks of one row are left out."""
    held: list[pa.RecordBatch] = []  # whole blocks
    open_: list[pa.RecordBatch] = []  # of the last block
    rows = 0
    kind = last = None

    def close() -> None:
        nonlocal rows
        if sum(x.num_rows for x in open_) > 1:
            held.extend(open_)
            rows += sum(x.num_rows for x in open_)
        open_.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in on]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:], strict=False):
            key = tuple(x[i].item() for x in columns)
            if key != last:
                close()
                if rows and (key[:2] != kind or rows * (key[0] + 1) >= CELLS):
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                kind, last = key[:2], key
            open_.append(batch.slice(i, j - i))
    close()
    if held:
        yield pa.Table.from_batches(held)


def roots(forms: DataFrame, work: Work) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by pointer doubling. A word has one form at most, and there are no cycles."""
    spark, k = work.spark, 0
    up = work.table(forms.select("word", F.col("form").alias("root")), "up0")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = with_ids(spark, up, above, "left", "root")
        found = work.table(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"up{k + 1}")
        up, k = found.select("word", "root"), k + 1
        if found.where("moved").isEmpty():
            return up


def variants(words: DataFrame, work: Work, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words with counts (word, n)."""
    words = work.table(words.select("word", "n"), "words")
    best = near(words, work, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    good = F.col("form_n") >= 2 * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    formed = work.table(formed, "formed")
    found = roots(formed.where("form is not null"), work)
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, work: Work) -> DataFrame:
    """The words of documents with their variants."""
    return variants(counted(docs), work)
