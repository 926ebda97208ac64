"""Sum-of-squares packing: documents into as few sequences of a fixed length as can be, only long ones cut.

First pass: each task encodes its documents and writes ids, with the checksum of each piece. A document longer than a
sequence is cut into whole sequences behind its first, shorter piece; whole pieces are sequences of their own. The short
pieces, at most one a document, are dealt by hash into groups of GROUP rows, and each group is packed in a task of its own:
longest first, each piece goes to that open sequence among those with room for it after which the sum over all gaps of
(open sequences of that gap) squared is smallest (ties: the smallest gap), and a new sequence is begun only where none has room. A
group wastes about one sequence; the number of groups follows the number of pieces, so no task grows with the table. Only lengths
and checksums travel; `sequences` joins ids to their places where they are wanted.

Rows: null text is empty and holds only the end id; repeated rows are documents of their own; a null doc_id is kept; an
empty table gives no rows; other columns are not read. Pieces of equal length are placed in the order of their written
place. Sequence ids are unique, not dense; offsets in a sequence are gapless from 0. Memory: one slice of texts, or
one group's lengths.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.llm.common import Work, column_texts, per_batch
from codexloom.llm.vocab import vocabulary

#: Short pieces in a group, about.
GROUP = 8192

RECORD = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part int, row long"


def encode(docs: DataFrame, tokenizer: str, end_id: int, work: Work, window: int = 2048, kind: str = "blank") -> DataFrame:
    """Written ids: doc_id, part and row (their place), whole (whole pieces of the part before it), n (ids with the end id), crcs (of each piece), width, ids (binary, `width` bytes each)."""

    def run(batches):
        from pyspark import TaskContext

        part, row, before = TaskContext.get().partitionId(), 0, 0
        words = vocabulary(tokenizer, kind)
        width = words.dtype.itemsize
        end = np.array([end_id], words.dtype).tobytes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row, before
            ids = [x + end for x in words.encode(column_texts(batch.column("text")))]
            n, crcs = [], []
            for x in ids:
                own = np.frombuffer(x, words.dtype).astype("<u4")
                cuts = cut(len(own), window)
                n.append(len(own))
                crcs.append([zlib.crc32(own[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
            rows = pa.array(range(row, row + len(ids)), pa.int64())
            whole = before + np.cumsum([0, *(x // window for x in n)])
            row, before = row + len(ids), int(whole[-1])
            columns = [batch.column("doc_id"), pa.array([part] * len(ids), pa.int32()), rows, pa.array(whole[:-1]), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "row", "whole", "n", "crcs", "width", "ids"])

        yield from per_batch(one)(batches)

    return work.table(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, row long, whole long, n long, crcs array<long>, width int, ids binary"), "ids")


def cut(n: int, window: int) -> list[int]:
    """Bounds of the pieces of n ids: the first piece takes what whole windows leave."""
    return [0, *range(n % window or window, n + 1, window)]


def place(lengths: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length by the sum of squares, longest first; lengths are below the window."""
    count = np.zeros(window, np.int64)  # open sequences by gap; full ones aren't counted
    waiting: list[list[int]] = [[] for _ in range(window)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    begun = 0
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    for i in order.tolist():
        size = lengths[i]
        own = count[size:]
        # (count[g] - 1)**2 + (count[g - size] + 1)**2 less the squares before; a filled sequence leaves the sum
        change = np.where(own > 0, 2 * (count[: window - size] - own + 1), 1 << 60)
        if own[0]:
            change[0] = 1 - 2 * own[0]
        gap = size + int(change.argmin())
        if count[gap] and gap >= size:
            s = waiting[gap].pop()
            count[gap] -= 1
        else:
            s, gap = begun, window
            begun += 1
        sequence[i], offset[i] = s, window - gap
        if gap > size:
            waiting[gap - size].append(s)
            count[gap - size] += 1
    return sequence, offset


def pack(ids: DataFrame, window: int = 2048, group: int = GROUP) -> DataFrame:
    """One record a piece of a table of `encode`: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part, row."""
    rest = F.col("n") % window
    known = ids.select("doc_id", "part", "row", "whole", "n", "crcs")
    short = known.where(rest > 0).select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), rest.alias("length"), F.element_at("crcs", 1).alias("ids_crc32"), "part", "row"
    )
    groups = max(1, -(-short.count() // group))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("row", "ascending")])
        sequence, offset = place(table.column("length").to_pylist(), window)
        number = ((table.column("group")[0].as_py() << 32) + sequence) * 2
        found = table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        return found.select(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part", "row"])

    dealt = short.withColumn("group", F.pmod(F.xxhash64("part", "row"), F.lit(groups)).cast("long")).repartition(groups, "group")
    packed = dealt.groupBy("group").applyInArrow(run, RECORD)
    # whole pieces: the k-th of a part, counted over its documents
    later = F.when(F.col("rest") > 0, F.col("piece") - 1).otherwise(F.col("piece"))
    whole = known.where(F.col("n") >= window).select("doc_id", "part", "row", "whole", rest.alias("rest"), F.posexplode("crcs").alias("piece", "ids_crc32"))
    whole = whole.where("piece > 0 or rest = 0").select(
        "doc_id",
        "piece",
        (F.col("rest") + later * window).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        ((F.shiftleft(F.col("part").cast("long"), 36) + F.col("whole") + later) * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "part",
        "row",
    )
    return packed.unionByName(whole)


def sequences(ids: DataFrame, records: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array<int>), and pieces (array of doc_id, piece, offset, length) in their order."""
    own = records.select("part", "row", "doc_id", "piece", "start", "length", "sequence_id", "offset").join(ids.select("part", "row", "width", "ids"), ["part", "row"])

    def take(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, lengths, widths, data = (batch.column(c).to_pylist() for c in ("start", "length", "width", "ids"))
        found = [np.frombuffer(x, f"<u{w}", n, s * w).astype(np.int32) for s, n, w, x in zip(starts, lengths, widths, data, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sequence_id", "offset", "doc_id", "piece", "length")), pa.array(found, pa.list_(pa.int32()))], ["sequence_id", "offset", "doc_id", "piece", "length", "ids"])

    pieces = own.mapInArrow(per_batch(take), "sequence_id long, offset long, doc_id long, piece int, length long, ids array<int>")
    gathered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("_held"))
    return gathered.select(
        "sequence_id", F.flatten(F.col("_held.ids")).alias("ids"), F.transform("_held", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.offset.alias("offset"), x.length.alias("length"))).alias("pieces")
    )
