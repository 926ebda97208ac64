"""Byte-level BPE by monoid tree reduction, and its inverse.

The encodings of strings form a monoid: `join` takes two valid encodings and gives that of the
concatenation. `encode` halves a string, encodes the halves the same way and joins them; only the tokens
next to the seam may change. The join re-encodes a window around the seam and lets it grow until the tokens
outside are proven stable: a token sequence is what the merges make of its bytes exactly if each pair of
neighbours is what the merges make of that pair's bytes (the merges inside any two neighbours run in the same
order alone as in the whole, so a first merge across a border would also occur in the pair alone). Pairs away
from the seam held before; so only the two pairs at the window's edges need a look.

Rows: null text counts as empty and gives no ids; equal texts give equal rows; other columns pass through.
Memory: one slice of rows, and tables of at most CACHED known strings.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codexloom.llm.common import added, column_texts, per_batch, refuse

#: Bytes up to which a string is merged directly; bytes up to which halves are remembered; how many strings a table remembers.
LEAF, KEPT, CACHED = 4, 7, 400_000
#: Above all ranks.
NONE = 1 << 40
#: White space after a blank, where a text can't be cut before that blank.
_RUN = regex.compile(r" (?:\s|$)")
_PLAIN_RUNS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")


def cuttable(text: str) -> bool:
    """Whether each blank of the text starts a match of the pattern: none is followed by white space or the end."""
    if text.isascii():
        return not (text.endswith(" ") or any(x in text for x in _PLAIN_RUNS))
    return _RUN.search(text) is None


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, cached: int = CACHED):
        self.ranks, self.leaf, self.cached = ranks, leaf, cached
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._halves: dict[bytes, list[int]] = {}
        self._windows: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The merges themselves: the lowest rank first, the leftmost of equals; for short strings."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            low = [rank(x + y, NONE) for x, y in zip(parts, parts[1:], strict=False)]
            best = min(low)
            if best == NONE:
                break
            at = low.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def window(self, data: bytes) -> list[int]:
        """The encoding of a short window around a seam, remembered."""
        known = self._windows.get(data)
        if known is None:
            if len(self._windows) >= self.cached:
                self._windows.clear()
            known = self._windows[data] = self.merge(data)
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when they stand side by side."""
        both = self.window(self.tokens[left] + self.tokens[right])
        return len(both) == 2 and both[0] == left and both[1] == right

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded strings."""
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        tokens = self.tokens
        i = j = 1
        while True:
            seam = b"".join([tokens[t] for t in a[-i:]] + [tokens[t] for t in b[:j]])
            if len(seam) <= 64:
                inner = self.window(seam)
            elif i == len(a) and j == len(b):
                inner = self.merge(seam)
            else:  # a seam that stays restless over a long window: the window is reduced as a tree of its own
                inner = self.encode(seam, off=max(1, len(seam) // 3))
            left = i == len(a) or self.stable(a[-i - 1], inner[0])
            right = j == len(b) or self.stable(inner[-1], b[j])
            if left and right:
                return a[: len(a) - i] + inner + b[j:]
            if not left:
                i = min(len(a), i + 1 if i < 4 else 2 * i)
            if not right:
                j = min(len(b), j + 1 if j < 4 else 2 * j)

    def encode(self, data: bytes, off: int = 0) -> list[int]:
        """Encode halves recursively and join them; short strings are remembered."""
        if len(data) <= self.leaf:
            return self.window(data)
        known = self._halves.get(data)
        if known is None:
            half = off or len(data) // 2
            known = self.join(self.encode(data[:half]), self.encode(data[half:]))
            if len(data) <= KEPT:
                if len(self._halves) >= self.cached:
                    self._halves.clear()
                self._halves[data] = known
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        """One match of the pattern; a match that is itself a token is that token."""
        ids = self._pieces.get(text)
        if ids is None:
            if len(self._pieces) >= self.cached:
                self._pieces.clear()
            data = text.encode()
            rank = self.ranks.get(data)
            ids = self._pieces[text] = (rank,) if rank is not None else tuple(self.encode(data))
        return ids

    def _spaced(self, text: str) -> tuple[int, ...]:
        """Ids of a blank and a text without blanks."""
        if len(self._chunks) >= self.cached:
            self._chunks.clear()
        found = self.split(" " + text)
        ids = self._chunks[text] = self.piece(found[0]) if len(found) == 1 else tuple(chain.from_iterable(map(self.piece, found)))
        return ids

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text: matches are encoded separately, so their encodings join by concatenation."""
        if not text:
            return []
        if not cuttable(text):
            return list(chain.from_iterable(map(self.piece, self.split(text))))
        parts = text.split(" ")
        first = [self.piece(x) for x in self.split(parts[0])]
        del parts[0]
        found = list(map(self._chunks.get, parts))
        if None in found:
            found = [self._spaced(p) if ids is None else ids for p, ids in zip(parts, found, strict=True)]
        return list(chain.from_iterable(chain(first, found)))

    def decode(self, ids: list[int], leaf: int = 8192) -> bytes:
        """Concatenate token bytes in leaves, then neighbours up the tree."""
        level = [b"".join(map(self.tokens.__getitem__, ids[i : i + leaf])) for i in range(0, len(ids), leaf)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]


@lru_cache(maxsize=4)
def tree_bpe(path: str, pattern: str) -> TreeBPE:
    """One encoder for each Python worker, read from the vocabulary file that every node has."""
    return TreeBPE(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add an array<int> column of token ids; a table that has a column of that name is refused."""
    refuse(docs, ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tree_bpe(path, pattern)
        found = pa.array([bpe.ids(x) for x in column_texts(batch.column(text))], pa.list_(pa.int32()))
        return batch.append_column(ids, found)

    return docs.mapInArrow(per_batch(run), added(docs.schema, f"{ids} array<int>"))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add a binary column of the bytes of token ids; null ids count as none. A table that has a column of that name is refused."""
    refuse(docs, out)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tree_bpe(path, pattern)
        return batch.append_column(out, pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary()))

    return docs.mapInArrow(per_batch(run), added(docs.schema, f"{out} binary"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of encoding and decoding each text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tree_bpe(path, pattern)
        n, ids_sha, back_sha = [], [], []
        for text in column_texts(batch.column("text")):
            ids = bpe.ids(text)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
            back_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(per_batch(run), schema)
