"""Concatenate and cut: documents' ids in a row, cut into windows of a fixed length.

First pass: each task encodes its documents and writes ids, each with its start inside the part; a part's
total is one row. The prefix sum of the totals gives each part its global base. Second pass: a document's
global start is base + local start, and the windows it crosses follow by division; each piece is a boundary
record. Nothing is sorted or gathered, so a source or document of any share stays spread as it was read.

Rows: null text is empty and holds only the end id; every id lies in exactly one piece; only the last
sequence is short; repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
A sequence is its pieces' ids in the order of their offsets. Memory: one slice of texts or ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.llm.common import Work, column_texts, per_batch, with_base, with_ids
from codexloom.llm.vocab import vocabulary


def encoded(docs: DataFrame, tokenizer: str, end_id: int, kind: str, work: Work) -> DataFrame:
    """Written ids: doc_id, part, local (ids of the part before it), n (ids with the end id), ids (binary, `width` bytes each)."""

    def run(batches):
        from pyspark import TaskContext

        part, local = TaskContext.get().partitionId(), 0
        words = vocabulary(tokenizer, kind)
        end = np.array([end_id], words.dtype).tobytes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal local
            ids = [x + end for x in words.encode(column_texts(batch.column("text")))]
            n = np.array([len(x) // words.dtype.itemsize for x in ids], np.int64)
            starts = local + np.concatenate(([0], np.cumsum(n)[:-1]))
            local += int(n.sum())
            k = len(ids)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * k, pa.int32()), pa.array(starts), pa.array(n), pa.array([words.dtype.itemsize] * k, pa.int32()), pa.array(ids, pa.binary())],
                ["doc_id", "part", "local", "n", "width", "ids"],
            )

        yield from per_batch(one)(batches)

    return work.table(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, local long, n long, width int, ids binary"), "ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int, work: Work, window: int = 4096, kind: str = "word") -> DataFrame:
    """Boundary records: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids (array<int>)."""
    ids = encoded(docs, tokenizer, end_id, kind, work)
    bases = with_base(ids.groupBy("part").agg(F.sum("n").alias("n")), "part", "n", "base").select("part", "base")
    placed = with_ids(work.spark, ids, work.table(bases, "bases"), "inner", "part")  # one row for each part file
    numbers = PIECE.names[:-1]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        pieces: list[np.ndarray] = []
        for doc, base, local, n, width, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "local", "n", "width", "ids")), strict=True):
            own = np.frombuffer(data, f"<u{width}").astype("<u4")
            at, start = base + local, 0
            while start < n:
                length = min(n - start, window - (at + start) % window)
                piece = own[start : start + length]
                out.append((doc, start, length, zlib.crc32(piece.tobytes()), n, (at + start) // window, (at + start) % window))
                pieces.append(piece)
                start += length
        columns = list(zip(*out, strict=True)) or [()] * len(numbers)
        ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
        flat = np.concatenate(pieces).view(np.int32) if pieces else np.zeros(0, np.int32)
        held = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), held], PIECE.names)

    return placed.mapInArrow(per_batch(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))])
