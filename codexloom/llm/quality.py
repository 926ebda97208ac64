"""Compression classifier: how much better a text compresses with a dictionary of good text than of bad.

`fit` trains one zstandard dictionary from pieces of texts labelled good and one from those labelled bad, and
calibrates the normalised difference of compressed sizes on other labelled rows by logistic regression.
`score` compresses each whole text, piece by piece, with both dictionaries.

The fit reads a bounded sample: at most SAMPLE rows of each label for the dictionaries and as many for the
calibration, chosen by a hash of doc_id, so the model does not grow with the table; every document is scored. Each of these
texts is cut whole into pieces of PIECE bytes, and all of them go into its label's dictionary, which one task a
label trains; the calibration compresses whole texts, too.
Held-out rows (crc32 of doc_id as text, mod 5, is 0) are never learnt from; the other remainders 1 to 3 make
dictionaries, 4 calibrates. Only texts are inputs of a score.

Rows: null or empty text has difference 0 and gets that score; equal texts get equal scores; rows without a
label or with a label other than 0 and 1 are not learnt from; with too few labels the score is the share of
label 1 seen (0.5 with none); rows of one doc_id with different texts are texts of that label each. Memory: two
dictionaries and one slice of rows; in a training task the sampled rows of one label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.llm.common import added, column_bytes, per_batch, refuse

#: Labelled rows of each label for the dictionaries, and of both for the calibration; the bound on the fit.
SAMPLE = 2000
#: Bytes compressed at a time, bytes of a dictionary, and the level.
PIECE, DICTIONARY, LEVEL = 512, 65_536, 3
#: Scores from here on predict label 1.
THRESHOLD = 0.3


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    bias: float = 0.0
    _compress: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_compress": []}

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """(bytes with the bad dictionary - bytes with the good one) / bytes, over the pieces of each text."""
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        if not self._compress:
            for raw in (self.good, self.bad):
                kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                known = zstandard.ZstdCompressionDict(raw, dict_type=kind)
                known.precompute_compress(level=LEVEL)
                self._compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
        good, bad = self._compress
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            out[i] = sum(len(bad(p)) - len(good(p)) for p in pieces(text)) / max(len(text), 1)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * self.differences(texts), -35, 35)))


def pieces(text: bytes) -> list[bytes]:
    return [text[j : j + PIECE] for j in range(0, len(text), PIECE)]


def dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary; of few pieces, their own bytes."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, parts)) // 8)), parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's steps, with a light ridge on the standardised slope."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w, ridge = np.zeros(2), np.diag([0.05, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows that aren't held out, at most 2 * sample for dictionaries and 2 * sample for calibration."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct().withColumn("fold", fold()).where("fold <> 0")
    picked = [known.where(f"quality = {q} and fold {f}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for f in ("< 4", "= 4") for q in (0, 1)]
    if sample > 50_000:
        raise ValueError("the sample is joined by broadcast; keep it bounded")
    rows = picked[0].unionAll(picked[1]).unionAll(picked[2]).unionAll(picked[3])
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    learnt = texts.where("fold < 4").select("quality", "doc_id", "text").groupBy("quality").applyInArrow(_dictionary, "quality int, dictionary binary")
    trained = {r.quality: bytes(r.dictionary) for r in learnt.collect()}  # two rows at most
    good, bad = trained.get(1, b""), trained.get(0, b"")
    # as many calibration rows of either label as the bound allows bend their share: the weights of the counts undo it
    share = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    prior = (share.get(1, 0) + 0.5) / (total + 1)
    model = Model(good, bad, 0.0, float(np.log(prior / (1 - prior))))
    if not good or not bad:
        return model
    held = _differences(texts.where("fold = 4").orderBy("doc_id", "text").select("quality", "text"), model).collect()
    y = np.array([r.quality for r in held], float)
    if 0 < y.sum() < len(y):
        model.slope, bias = _logistic(np.array([r.difference for r in held]), y)
        seen = y.mean()
        model.bias = bias + float(np.log(prior / (1 - prior)) - np.log(seen / (1 - seen)))
    return model


def _dictionary(table: pa.Table) -> pa.Table:
    """All pieces of the sampled rows of one label, in the order of doc_id and text, as one dictionary."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    parts = [p for text in column_bytes(table.column("text")) for p in pieces(text)]
    return pa.table({"quality": table.column("quality").slice(0, 1).cast(pa.int32()), "dictionary": pa.array([dictionary(parts) if parts else b""], pa.binary())})


def _differences(df: DataFrame, model: Model) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(model.differences(column_bytes(batch.column("text"))))], ["quality", "difference"])

    return df.mapInArrow(per_batch(run), "quality int, difference double")


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each whole text, 0 to 1; higher: label 1 is likelier. A table that has a column of that name is refused."""
    refuse(docs, out)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(out, pa.array(model.scores(column_bytes(batch.column(text))), pa.float64()))

    return docs.mapInArrow(per_batch(run), added(docs.schema, f"{out} double"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
