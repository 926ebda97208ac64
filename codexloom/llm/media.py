"""Media columns: ISO base media containers as binary columns, described by their own boxes.

`store` wraps a payload as the samples of one track of unsigned 8-bit mono PCM ("raw "); `describe` walks the
nested boxes of any such container, decodes the sample tables (sizes, chunk map, chunk offsets, times, sync
samples) and returns codec, duration, width, height and the byte ranges of keyframes, without touching the
payload; `payload` then reads the stored bytes at those ranges.

Rows: null text is an empty text; equal texts give equal containers; a column that is null or no container, and a track whose
tables lie (more samples than bytes, chunks that aren't there), gives nulls in each described field; boxes nested deeper
than DEPTH are not opened. Repeated rows are described each; an empty table gives no rows; other columns pass through,
and a table that has one of the new columns' names is refused. Memory: one slice of rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codexloom.llm.common import added, column_bytes, per_batch, refuse

#: Payloads are padded with blanks to a positive multiple of this; it is also the length of a sample.
UNIT, FRAME = 192, 192
#: Samples in a second.
RATE = 8000
#: Samples in a chunk; each chunk starts with a sync sample.
CHUNK = 64
#: Boxes in boxes that are opened.
DEPTH = 16
#: Boxes that hold boxes, with the bytes before their first child. Fixed values of the format.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data
    return struct.pack(">I4s", len(data) + 8, kind) + data


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(payload: bytes) -> bytes:
    """A container with the payload as samples of FRAME bytes, CHUNK samples to a chunk."""
    n = len(payload) // FRAME
    if len(payload) != n * FRAME:
        raise ValueError("the payload isn't a whole number of samples")
    chunks, last = -(-n // CHUNK), n - (n - 1) // CHUNK * CHUNK if n else 0
    ticks = n * FRAME
    runs = [(1, CHUNK, 1)] if chunks > 1 or last == CHUNK else []
    if last and last != CHUNK:
        runs.append((chunks, last, 1))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = [first + i * CHUNK * FRAME for i in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, FRAME)),
            full(b"stss", struct.pack(f">I{chunks}I", chunks, *(1 + i * CHUNK for i in range(chunks)))),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    mark = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = len(head) + len(moov(0)) + mark
    if first + len(payload) >= 1 << 32:
        first = len(head) + len(moov(1 << 32)) + mark
    return head + moov(first) + box(b"mdat", payload)


def walk(data: bytes | memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of each box's body, parents before children; stops at a box that doesn't fit."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                return
            (size,), body = struct.unpack_from(">Q", data, body), at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            return
        yield (*path, kind), body, at + size
        if kind in NESTED and len(path) < DEPTH:
            yield from walk(data, body + NESTED[kind], at + size, (*path, kind))
        at += size


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    """Decode the sample tables of one track."""

    def words(kind: bytes, skip: int = 4, letter: str = "I") -> tuple[int, ...]:
        start, end = boxes.get(kind, (0, 0))
        n = (end - start - skip) // struct.calcsize(letter)
        return struct.unpack_from(f">{n}{letter}", data, start + skip) if n > 0 else ()

    start, _ = boxes[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, start + 20) if data[start] == 1 else struct.unpack_from(">II", data, start + 12)
    entry = boxes[b"stsd"][0] + 8
    codec = bytes(data[entry + 4 : entry + 8]).decode("latin-1")
    fixed, n, *sizes = words(b"stsz")
    if n * fixed > len(data) or not fixed and n > len(sizes):
        raise ValueError("more samples than the file holds")
    sizes = sizes[:n] if not fixed else [fixed] * n
    offsets = words(b"co64", 8, "Q") if b"co64" in boxes else words(b"stco", 8)
    runs = words(b"stsc", 8)
    per_chunk: list[int] = []
    for i in range(0, len(runs) - 2, 3):
        until = runs[i + 3] - 1 if i + 3 < len(runs) else len(offsets)
        if not len(per_chunk) <= until <= len(offsets):
            raise ValueError("a run of chunks that aren't there")
        per_chunk += [runs[i + 1]] * (until - len(per_chunk))
    where, k = [], 0
    for offset, count in zip(offsets, per_chunk, strict=False):
        for _ in range(count):
            if k >= n:
                break
            where.append((offset, sizes[k]))
            offset += sizes[k]
            k += 1
    if any(offset + size > len(data) for offset, size in where):
        raise ValueError("samples beyond the file's end")
    keys = words(b"stss", 8) if b"stss" in boxes else range(1, len(where) + 1)
    start, end = boxes.get(b"tkhd", (0, 0))
    width, height = (x >> 16 for x in struct.unpack_from(">II", data, end - 8)) if end - start >= 84 else (0, 0)
    times = words(b"stts", 8)
    return {
        "codec": codec,
        "timescale": scale,
        "duration": duration,
        "width": width,
        "height": height,
        "ticks": sum(a * b for a, b in zip(times[::2], times[1::2], strict=False)),
        "samples": where,
        "keyframes": [(where[i - 1][0], sum(s for _, s in where[i - 1 : j - 1])) for i, j in zip(keys, [*keys[1:], len(where) + 1], strict=True) if 0 < i <= len(where)],
    }


def tracks(data: bytes) -> list[dict]:
    """Sample tables of all tracks; an incomplete track is left out."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif found and path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (start, end))
    out = []
    for boxes in found:
        try:
            out.append(_track(data, boxes))
        except (KeyError, struct.error, ValueError, IndexError):
            continue
    return out


def payload(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples, in order, read at the places that its tables give; neighbours in one read."""
    out, start, end = [], None, 0
    for offset, size in track["samples"]:
        if offset != end or start is None:
            if start is not None:
                out.append(data[start:end])
            start = offset
        end = offset + size
    if start is not None:
        out.append(data[start:end])
    return b"".join(out)


def store_text(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add the binary container of each text's padded UTF-8."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(media, pa.array([store(padded(x)) for x in column_bytes(batch.column(text))], pa.large_binary()).cast(pa.binary()))

    refuse(docs, media)
    return docs.mapInArrow(per_batch(run), added(docs.schema, f"{media} binary"))


FIELDS = ["codec", "timescale", "duration", "width", "height", "n_samples", "keyframes"]
_RANGE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_KINDS = [pa.string(), *[pa.int64()] * 5, _RANGE]
_DDL = "codec string, timescale long, duration long, width long, height long, n_samples long, keyframes array<struct<start: long, length: long>>"


def _fields(track: dict | None) -> tuple:
    if track is None:
        return (None,) * len(FIELDS)
    return (*(track[c] for c in FIELDS[:5]), len(track["samples"]), [{"start": a, "length": b} for a, b in track["keyframes"]])


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """Add codec, timescale, duration, width, height, n_samples and keyframe byte ranges of the first track, from boxes alone."""
    refuse(df, *FIELDS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_fields((tracks(data) or [None])[0] if data else None) for data in batch.column(media).to_pylist()]
        for name, kind, values in zip(FIELDS, _KINDS, zip(*rows, strict=True), strict=True):
            batch = batch.append_column(name, pa.array(values, kind))
        return batch

    return df.mapInArrow(per_batch(run), added(df.schema, _DDL))


def digests(df: DataFrame) -> DataFrame:
    """Per stored text, read back from its container: the columns of the query, then what `describe` gives."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            t = tracks(data)[0]
            back = payload(data, t)
            ranges = ",".join(f"{a}+{b}" for a, b in t["keyframes"])
            feature = f"codec={t['codec'].strip()};seconds={t['duration'] / t['timescale']:.6f};samples={len(t['samples'])};keyframes={len(t['keyframes'])};ranges={hashlib.md5(ranges.encode()).hexdigest()}"
            rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, *_fields(t)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*kinds, *_KINDS], strict=True)], [*names, *FIELDS])

    return df.mapInArrow(per_batch(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + _DDL)
