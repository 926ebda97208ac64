"""Token ids by the tokenizers library, with known strings remembered between texts.

Both vocabularies split a text into matches that are encoded separately, and no match reaches across a blank
that starts a word. So a text can be cut there, and each distinct part is encoded by the library once for as
long as a worker remembers it; the ids are those of the whole text (tests compare them). New parts go to the library
many in one string: where a part begins among its ids is told by the blank before it, or by a mark between parts. New
parts of a byte-level vocabulary go to a faster encoder of the same merges, where `ranked` proves that it gives the library's ids.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import compress

import numpy as np

from codexloom.llm.bpe import cuttable

#: Parts in a table of a worker; the table has a predecessor. Parts in one call of the library.
CACHED, CALL = 400_000, 8192
#: Matches of the library's byte-level splitter. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked(path: str, tokenizer):
    """An encoder that merges by the rank of what a pair makes, if it gives the ids of the library's byte-level model; else None.

    The library merges the pair that stands first in its list of merges; this one the pair whose union has the smallest id. Let the
    ids of unions follow the list, one merge for each, and let the library give each token's own text that token alone. Then
    both do the same: before a pair x y becomes t, no merge below t's rank is left in its bytes and none has crossed their
    bounds, so they stand as they do for the text of t alone, as the two tokens that the list joins to t.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], whole["pre_tokenizer"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in whole["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary.get(a + b) for a, b in merges]
    by_rank = (
        split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": split.get("trim_offsets"), "use_regex": True}
        and whole["normalizer"] is None
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and None not in order
        and all(x < y for x, y in zip(order, order[1:], strict=False))
        and set(vocabulary) == set(sign) | {a + b for a, b in merges}
        and all(vocabulary[c] < order[0] for c in sign)
        and all([x.id for x in tokenizer.model.tokenize(t)] == [i] for t, i in vocabulary.items())
    )
    if not by_rank:
        return None
    ranks = {bytes(sign[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Vocabulary:
    """Ids for one tokenizer file. kind: "blank" keeps blanks in front of words, "word" drops white space."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.blank = kind == "blank"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        if self.blank:  # tokens that begin with the byte of a blank
            self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        else:  # tokens that are a whole match of one sign: marks that may stand between parts, where blanks leave no trace
            self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
            names = ((i, (self.tokenizer.id_to_token(i) or "").removesuffix("</w>")) for i in np.flatnonzero(self.ends).tolist())
            self.marks = [(i, c) for i, c in names if len(c) == 1 and not c.isalnum() and not c.isspace()]
        self.fast = ranked(path, self.tokenizer) if self.blank else None
        self._parts: dict[str, bytes] = {}
        self._old_parts: dict[str, bytes] = {}  # known before the table was full: asked before the library

    def _library(self, texts: list[str]) -> list[bytes]:
        if self.fast:
            return [np.array(self.fast.encode_ordinary(t), self.dtype).tobytes() for t in texts]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _cut(self, text: str, n: int, marks: int | None) -> list[bytes] | None:
        """Ids of a text in n pieces: between marks, or before tokens of a blank, or behind ends of matches; None if they aren't n."""
        found = self.fast.encode_ordinary(text) if self.fast else self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(found, self.dtype)
        if marks is not None:
            at = np.flatnonzero(ids == marks)
            starts, stops = np.concatenate(([0], at + 1)), np.append(at, len(ids))
        elif self.blank:
            starts = np.flatnonzero(self.begins[ids])
            stops = np.append(starts[1:], len(ids))
        else:
            stops = np.flatnonzero(self.ends[ids]) + 1
            starts = np.concatenate(([0], stops[:-1]))
        if len(starts) != n or starts[0] != 0:
            return None
        data, k = ids.tobytes(), self.dtype.itemsize
        return [data[i:j] for i, j in zip((starts * k).tolist(), (stops * k).tolist(), strict=True)]

    def _together(self, parts: list[str]) -> list[bytes]:
        """Ids of each of many parts by one call of the library; one by one if they can't be told apart."""
        if self.blank:
            return self._cut(" " + " ".join(parts), len(parts), None) or self._library([" " + p for p in parts])
        if all(map(str.isalpha, parts)):  # one match each
            found = self._cut("\n".join(parts), len(parts), None)
        else:
            whole = "".join(parts)
            mark = next(((i, c) for i, c in self.marks if c not in whole), None)
            found = self._cut(f" {mark[1]} ".join(parts), len(parts), mark[0]) if mark else None
        return found or self._library(parts)

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that aren't known."""
        known, old = self._parts, self._old_parts
        if old:
            found = list(map(old.get, parts))
            known.update([(p, x) for p, x in zip(parts, found, strict=True) if x is not None])
            parts = list(compress(parts, [x is None for x in found]))
        kinds = [parts] if self.blank else [[p for p in parts if p.isalpha()], [p for p in parts if not p.isalpha()]]
        for some in kinds:
            for i in range(0, len(some), CALL):
                few = some[i : i + CALL]
                known.update(zip(few, self._together(few), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of self.dtype."""
        if len(self._parts) > CACHED:
            self._old_parts, self._parts = self._parts, {}
        self._parts[""] = b""
        get, missing = self._parts.get, set()
        cut, found, holes = [], [], []
        for t in texts:
            parts = t.split(" ") if not self.blank or cuttable(t) else None
            if self.blank and parts:
                del parts[0]
            ids = list(map(get, parts or ()))
            hole = ()
            if None in ids:
                hole = [i for i, x in enumerate(ids) if x is None]
                missing.update([parts[i] for i in hole])
            cut.append(parts)
            found.append(ids)
            holes.append(hole)
        missing.discard("")
        if missing:
            self._learn(list(missing))
        for parts, ids, hole in zip(cut, found, holes, strict=True):
            for i in hole:
                ids[i] = get(parts[i])
        out = list(map(b"".join, found))
        if not self.blank:
            return out
        heads = [t if ps is None else t.split(" ", 1)[0] for t, ps in zip(texts, cut, strict=True)]
        first = dict(zip(own := list(dict.fromkeys(heads)), self._library(own), strict=True))
        return [first[h] + x for h, x in zip(heads, out, strict=True)]


@lru_cache(maxsize=4)
def vocabulary(path: str, kind: str) -> Vocabulary:
    return Vocabulary(path, kind)
