"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is scaled to length 1 and rotated at random. Its code is the signs of the rotated values. Stored once beside
it are the correction factor f, the inner product of the rotated vector with its own code, and the rotated vector
in 16 steps a value with the length of the rounding error. For a second vector with rounded values q, <code, q> / f
is an unbiased estimate of their inner product. For a pair whose true value is at least t its spread is
sqrt((1 - t^2) * (1 - f^2) / f^2 / (d - 1)), and the rounding adds error / f / sqrt(d). A pair whose estimate, from
either side, lies BOUND spreads or more under t is settled. The rest are recomputed exactly in double precision, and
only exact values make links.

1. Sketches: code, factor and rounded values are written once for each different vector, with its bucket keys.
2. Candidates: slices of the codes of several rotations are keys of as many tables; vectors that agree in a key meet
   in that bucket. A pair with cosine c agrees in one sign with probability 1 - acos(c)/pi, so slice width (from the
   row count) and number of tables follow from RECALL.
3. Estimates: buckets hold sketches only. A bucket of more than TILE vectors becomes tiles of TILE x TILE that
   different tasks take, so no bucket is gathered whole. A tile returns the vectors that have an open pair.
4. Exact values: only those vectors are fetched, into the tiles where a pair of theirs is open. A pair that meets in several
   tiles is counted in the first table where its keys agree. Links are counted inside tiles: pairs are never rows.

Equal vectors are one row with a multiplicity before all this. Vectors of different lengths never link; each length
has its own tables.

Rows: null and empty vectors, vectors with null or non-finite values and zero vectors link with nothing; equal vectors
link with each other; vec_id should be unique, repeated rows count each; a null vec_id is its own row without
links and counts for nobody. Columns other than vec_id and embedding are not read. Memory: two sides of a tile.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm.common import Work, connected_components, groups, with_ids

#: Vectors on a side of a tile; spreads under the threshold from which on an estimate settles a pair.
TILE, BOUND = 1024, 5.0
#: Share of linked pairs at the threshold itself that meet in a bucket, at least (of nearer pairs, more).
RECALL = 0.995
#: Vectors in a bucket that slices are made wide enough for, on average.
LOAD = 64
#: Bits of a bucket key that hold the slice; the table's number is above.
SLICE = 40
SEED = 20_240_501


@lru_cache(maxsize=16)
def rotations(d: int, count: int) -> np.ndarray:
    """count random orthogonal d x d matrices; the same for every task."""
    rng = np.random.default_rng(SEED + d)
    out = np.empty((count, d, d))
    for i in range(count):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        out[i] = q * np.sign(np.diag(r))
    return out


def plan(n: int, d: int, threshold: float) -> tuple[int, int, int]:
    """Bits of a slice, tables, rotations for n vectors of length d."""
    width = max(1, min(SLICE, d, math.ceil(math.log2(max(n, 2) / LOAD))))
    agree = min((1 - math.acos(threshold) / math.pi) ** width, 1 - 1e-12)
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))
    return width, tables, math.ceil(tables / (d // width))


def bucket_keys(rotated: np.ndarray, width: int, tables: int) -> np.ndarray:
    """Keys (n, tables) of rotated vectors (n, rotations, d): each rotation gives d // width slices of signs."""
    n, _, d = rotated.shape
    fit = d // width
    bits = (rotated > 0).astype(np.int64)[:, :, : fit * width].reshape(n, -1, width)
    return (bits @ (1 << np.arange(width, dtype=np.int64)))[:, :tables] | np.arange(tables, dtype=np.int64) << SLICE


def sketches(turned: np.ndarray) -> list[bytes]:
    """Code, 16-step values, lowest value, step, factor and rounding error of rotated unit vectors (n, d)."""
    n, d = turned.shape
    code = turned > 0
    factor = np.abs(turned).sum(1) / math.sqrt(d)
    low, high = turned.min(1, keepdims=True), turned.max(1, keepdims=True)
    step = np.maximum((high - low) / 15, 1e-12)
    steps = np.rint((turned - low) / step).astype(np.uint8)
    error = np.linalg.norm(turned - (low + steps * step), axis=1)
    even = np.pad(steps, ((0, 0), (0, d % 2)))
    facts = np.concatenate([low, step, factor[:, None], error[:, None]], 1).astype("<f4")
    whole = np.concatenate([np.packbits(code, axis=1), even[:, ::2] | even[:, 1::2] << 4, facts.view(np.uint8).reshape(n, 16)], 1)
    return [row.tobytes() for row in whole]


def read_sketches(data: list[bytes], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs as +-1/sqrt(d), rounded values, factor, error) of sketches."""
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    a = -(-d // 8)
    packed = raw[:, a : a + -(-d // 2)]
    steps = np.stack([packed & 15, packed >> 4], 2).reshape(len(data), -1)[:, :d]
    low, step, factor, error = np.ascontiguousarray(raw[:, -16:]).view("<f4").T
    signs = np.unpackbits(raw[:, :a], axis=1, count=d).astype(np.float32) * 2 - 1
    return signs / np.float32(math.sqrt(d)), low[:, None] + steps.astype(np.float32) * step[:, None], factor, error


def open_pairs(left: tuple, right: tuple, d: int, threshold: float) -> np.ndarray:
    """Whether the exact value of each pair is needed: no estimate settles it."""

    def side(a: tuple, b: tuple) -> np.ndarray:
        signs, _, factor, _ = a
        _, values, _, error = b
        factor = np.maximum(factor, 1e-6)[:, None]
        spread = np.sqrt((1 - threshold**2) * np.maximum(1 - factor**2, 0) / max(d - 1, 1) + error[None, :] ** 2 / d) / factor
        return (signs @ values.T) / factor >= threshold - BOUND * spread - 1e-5

    return side(left, right) & side(right, left).T


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array<double>) where it can link, else null; k1 and k2, hashes that name it."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    found = vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(~bad & ~zero, F.lit(False)), v).alias("vector"))
    return found.select("*", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest value first, so that squares stay in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketched(distinct: DataFrame, threshold: float) -> DataFrame:
    """node, d, n, keys (array<long>), sketch of rows (node, d, n, vector)."""

    def run(batches):
        for batch in batches:
            d_of, n_of = batch.column("d").to_numpy(), batch.column("n").to_numpy()
            for d in np.unique(d_of).tolist():
                own = np.flatnonzero(d_of == d)
                some = batch.take(pa.array(own))
                for at in range(0, len(own), max(1, (1 << 20) // d)):
                    part = some.slice(at, max(1, (1 << 20) // d))
                    n = int(n_of[own[0]])
                    width, tables, count = plan(n, d, threshold)
                    x = unit(np.asarray(part.column("vector").flatten()).reshape(-1, d))
                    rotated = (x @ rotations(d, count).reshape(-1, d).T).reshape(len(x), count, d)
                    keys = bucket_keys(rotated, width, tables)
                    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("d"), part.column("n"), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), pa.array(sketches(rotated[:, 0]), pa.binary())], ["node", "d", "n", "keys", "sketch"])

    return distinct.select("node", "d", "n", "vector").mapInArrow(run, "node long, d int, n long, keys array<long>, sketch binary")


TILE_KEY = ["d", "slot", "one", "two"]
OPEN = pa.schema([("d", pa.int32()), ("slot", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("side", pa.int32()), ("node", pa.int64())])
LINK = pa.schema([("node", pa.int64()), ("partners", pa.int64()), ("other", pa.int64())])


def _estimate(threshold: float):
    """Of each tile the vectors with an open pair; pairs that agree in an earlier table of the stored code wait there."""

    def run(batches):
        for tile in groups(batches, TILE_KEY):
            if tile.num_rows < 2:
                continue
            d, slot, n = tile.column("d")[0].as_py(), tile.column("slot")[0].as_py(), tile.column("n")[0].as_py()
            side, nodes = tile.column("side").to_numpy(), tile.column("node").to_numpy()
            data = tile.column("sketch").to_pylist()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            same = not len(right)
            right = left if same else right
            a, b = read_sketches([data[i] for i in left], d), read_sketches([data[i] for i in right], d)
            near = open_pairs(a, b, d, threshold)
            if same:
                near &= np.triu(np.ones(near.shape, bool), 1)
            i, j = np.nonzero(near)
            width, tables, _ = plan(n, d, threshold)
            known = min(tables, d // width, slot >> SLICE)  # earlier tables whose keys the sketch holds
            if len(i) and known:
                ka, kb = (bucket_keys(x[0][:, None, :], width, d // width) for x in (a, b))
                first = (ka[i, :known] != kb[j, :known]).all(1)
                i, j = i[first], j[first]
            if not len(i):
                continue
            rows = np.union1d(left[i], right[j])
            k = len(rows)
            columns = [np.full(k, tile.column(c)[0].as_py()) for c in TILE_KEY] + [side[rows], nodes[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OPEN.types, strict=True)], schema=OPEN)

    return run


def tile_links(nodes: np.ndarray, weight: np.ndarray, side: np.ndarray, x: np.ndarray, keys: np.ndarray, slot: int, threshold: float) -> tuple[list, list]:
    """Exact links of one tile: per node the weight of its partners, and node pairs that span the tile's components."""
    length = unit(x)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(right)
    right = left if same else right
    near = length[left] @ length[right].T >= threshold - 1e-9
    if same:
        near &= np.triu(np.ones(near.shape, bool), 1)
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    table = slot >> SLICE
    if table and len(i):  # a pair belongs to the first table where it meets
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= keys[i, t] != keys[j, t]
        i, j = i[first], j[first]
    a, b = x[i], x[j]
    with np.errstate(all="ignore"):
        cosine = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    odd = ~np.isfinite(cosine) | (cosine == 0)  # squares out of range
    cosine[odd] = (length[i[odd]] * length[j[odd]]).sum(1)
    linked = cosine >= threshold
    i, j = i[linked], j[linked]
    partners = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
    some = np.flatnonzero(partners)
    label = np.arange(len(nodes))
    while True:  # label propagation inside the tile
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    counts = list(zip(nodes[some].tolist(), partners[some].astype(np.int64).tolist(), strict=True))
    return counts, [(int(nodes[k]), int(nodes[label[k]])) for k in some if label[k] != k]


def _exact(threshold: float):
    def run(batches):
        for tile in groups(batches, TILE_KEY):
            if tile.num_rows < 2:
                continue
            d = tile.column("d")[0].as_py()
            x = np.asarray(tile.column("vector").combine_chunks().flatten()).reshape(-1, d)
            keys = np.asarray(tile.column("keys").combine_chunks().flatten()).reshape(len(x), -1)
            partners, spans = tile_links(tile.column("node").to_numpy(), tile.column("weight").to_numpy(), tile.column("side").to_numpy(), x, keys, tile.column("slot")[0].as_py(), threshold)
            if partners:
                nodes, counts = zip(*partners, strict=True)
                k = len(spans)
                yield pa.RecordBatch.from_arrays([pa.array([*nodes, *(s[0] for s in spans)], pa.int64()), pa.array([*counts, *[0] * k], pa.int64()), pa.array([*[None] * len(nodes), *(s[1] for s in spans)], pa.int64())], schema=LINK)

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    work = Work(spark, "embeddings")
    rows = clean(vectors)
    distinct = rows.where("vector is not null and vec_id is not null").groupBy("k1", "k2", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    distinct = work.table(distinct.withColumn("d", F.size("vector")), "distinct")
    lengths = work.table(distinct.groupBy("d").agg(F.count("*").alias("n")), "lengths")
    stored = work.table(sketched(with_ids(spark, distinct, lengths, "inner", "d"), threshold), "sketches")
    slots = stored.select("d", F.explode("keys").alias("slot"), "node", "n", "sketch")
    big = slots.groupBy("d", "slot").agg(F.count("*").alias("m")).where(F.col("m") > TILE)
    big = work.table(big.select("d", "slot", F.ceil(F.col("m") / TILE).cast("int").alias("strips")), "big")
    strips = F.coalesce("strips", F.lit(1))
    placed = with_ids(spark, slots, big, "left", ["d", "slot"])
    placed = placed.withColumn("strips", strips).withColumn("strip", F.pmod(F.xxhash64("node"), F.col("strips")).cast("int"))
    # a row goes to each tile of its strip: (strip, other) for other >= strip as the left side, (other, strip) as the right
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    tiled = tiled.select("d", "slot", F.least("strip", "other").alias("one"), F.greatest("strip", "other").alias("two"), F.when(F.col("strip") > F.col("other"), 1).otherwise(0).alias("side"), "node", "n", "sketch")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *TILE_KEY).sortWithinPartitions(*TILE_KEY)

    opened = work.table(dealt(tiled).mapInArrow(_estimate(threshold), "d int, slot long, one int, two int, side int, node long"), "open")
    full = opened.join(distinct.select("node", "weight", "vector"), "node").join(stored.select("node", "keys"), "node")
    found = work.table(dealt(full).mapInArrow(_exact(threshold), "node long, partners long, other long"), "links")
    links = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    components = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = distinct.join(links, "node", "left").join(components.withColumnRenamed("id", "node"), "node", "left")
    nodes = nodes.select("k1", "k2", (F.coalesce("partners", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.where("vec_id is not null").select("vec_id", "k1", "k2").join(nodes, ["k1", "k2"], "left").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("vec_id is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
