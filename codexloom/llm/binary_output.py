"""Token ids as flat unsigned integer files with 64-bit document offsets.

`write` sorts documents by id into ranges, and each range becomes one shard of three files in the shared
folder: token ids (two bytes each where the vocabulary allows, else four), document ids, and offsets. A first pass writes ids
and counts; where a shard begins among all ids is a prefix sum over the shards' totals, one row a shard; a second pass
writes the global 64-bit offsets, one more than documents. `read` memory-maps the files, or reads them by ranges where the
file system isn't mounted. A task writes under a name of its own attempt, and only names that its rows carry count, so a lost
executor or a second attempt leaves no half-written shard in the result.

Rows: null text is empty and gives only the end id; rows of a repeated doc_id follow each other; a null
doc_id comes first; an empty table gives no shards; other columns are not read. Memory: one slice of texts, then one
slice of a shard's offsets and the ids of its documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.llm.common import Work, column_texts, per_batch, with_base
from codexloom.llm.vocab import vocabulary

#: Stands for a null doc_id in the int64 file.
NO_ID = -(1 << 63)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


class Flat:
    """A flat file as slices of an array: memory-mapped where the file system is mounted, else read by ranges."""

    def __init__(self, uri: str, dtype: str | np.dtype):
        self.fs, self.path = file_system(uri)
        self.dtype = np.dtype(dtype)
        self.n = self.fs.get_file_info(self.path).size // self.dtype.itemsize
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.map = np.memmap(self.path, self.dtype, "r") if local and self.n else None
        self.file = None if local else self.fs.open_input_file(self.path)

    def __getitem__(self, part: slice) -> np.ndarray:
        start, stop, _ = part.indices(self.n)
        if self.file is None:
            return self.map[start:stop] if self.map is not None else np.zeros(0, self.dtype)
        k = self.dtype.itemsize
        self.file.seek(start * k)
        return np.frombuffer(self.file.read(max(stop - start, 0) * k), self.dtype)


def write(docs: DataFrame, tokenizer: str, end_id: int, work: Work, kind: str = "blank") -> DataFrame:
    """Write shards; returns one row a shard: shard, name, n_docs, n_tokens, base, width, offsets. name is a URI prefix, offsets a URI."""
    folder = f"{work.path}/ids"
    work._fs.mkdirs(work.spark._jvm.org.apache.hadoop.fs.Path(folder))

    def shard(batches):
        task = TaskContext.get()
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        words = vocabulary(tokenizer, kind)
        end = np.array([end_id], words.dtype).tobytes()
        fs, path = file_system(name)
        n_docs = at = 0
        with fs.open_output_stream(path + ".tokens") as tokens, fs.open_output_stream(path + ".docs") as ids, fs.open_output_stream(path + ".ends") as offsets:

            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                nonlocal n_docs, at
                found = words.encode(column_texts(batch.column("text")))
                ends = at + np.cumsum([len(x) // words.dtype.itemsize + 1 for x in found], dtype="<i8")
                for x in found:
                    tokens.write(x)
                    tokens.write(end)
                offsets.write(ends.tobytes())
                ids.write(np.array([NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()], "<i8").tobytes())
                n_docs, at = n_docs + len(found), int(ends[-1])
                return batch

            for _ in per_batch(one)(batches):
                pass
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "n_docs": [n_docs], "n_tokens": [at], "width": [words.dtype.itemsize]}, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    shards = ranges.mapInArrow(shard, "shard int, name string, n_docs long, n_tokens long, width int").checkpoint()
    return work.table(with_base(shards, "shard", "n_tokens", "base").repartition(parts, "shard").mapInArrow(_with_offsets, SHARD), "shards")


SHARD = "shard int, name string, n_docs long, n_tokens long, width int, base long, offsets string"


def _with_offsets(batches):
    """Second pass: each shard's offsets among all ids, base first."""
    attempt = TaskContext.get().taskAttemptId()
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            ends, r["offsets"] = Flat(r["name"] + ".ends", "<i8"), f"{r['name']}-{attempt}.offsets"
            fs, path = file_system(r["offsets"])
            with fs.open_output_stream(path) as out:
                out.write(np.array([r["base"]], "<i8").tobytes())
                for i in range(0, ends.n, 1 << 16):
                    out.write((ends[i : i + (1 << 16)] + r["base"]).astype("<i8").tobytes())
        names = ["shard", "name", "n_docs", "n_tokens", "width", "base", "offsets"]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)], names)


def read(shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def one(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, docs, offsets = Flat(r["name"] + ".tokens", f"<u{r['width']}"), Flat(r["name"] + ".docs", "<i8"), Flat(r["offsets"], "<i8")
                for i in range(0, docs.n, 4096):
                    part, own = np.array(offsets[i : i + 4097]), np.array(docs[i : i + 4096])
                    at = (part - r["base"]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(part[:-1]), pa.array(np.diff(part)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.repartition(max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.col("shard"))
    return spread.mapInArrow(one, "doc_id long, start long, n_tokens long, ids_crc32 long")
