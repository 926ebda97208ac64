"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document is the set of its n-word shingles, as sorted 64-bit hashes. Two sets link when their Jaccard
similarity is at least num/den; the join returns components of links, and loses no link between different sets.

1. Bands. Sizes are cut into bands. For two linked sets whose smaller one is in a band, the symmetric
   difference is at most D = (1 - t) / t * (largest size of the band). Cutting the hash range into K > D parts
   leaves at least K - D parts in which the sets agree. So each set has one key for each part that isn't empty
   (band, part, sum of the part's hashes), and linked sets share a key, or agree in empty parts alone. The latter
   needs K - D empty parts in both; such sets have their (1 - t) * size + 1 smallest hashes as keys too, one of
   which linked sets share. A set near the lower border of its band also has keys in the band below.
2. Frequent keys. A set may leave out as many keys as its agreeing parts exceed one: K - D - 1 less its empty
   parts. Of keys that more than HOT sets share, each set leaves out the most frequent ones; in one order for all, so
   that linked sets still share a key. Passages that many documents share thus bring no pairs. Of less frequent
   keys with the same sets one is kept.
3. Stars. Each set meets the smallest set of its keys with which it shares most, in tiles of that set and up to
   TILE others. Components of the links found settle most copies.
4. Tiles. Keys whose sets are still in different components are cut by size and hash into strips; pairs of
   strips that can reach the threshold are tiles. These hold sizes and bitmaps, no hashes: bits set in x and not
   in y are at least as many elements of x outside y, so bit counts bound each pair's overlap from above.
   Strips of the key's largest component don't meet each other.
5. Pairs that pass are intersected exactly: of each tile first the best pairs that would join its components, fewer than it
   has sets; then, in new tiles of the keys that had any, all pairs whose components still differ: sets that are open together in many tiles are
   gathered first and meet once. From tiles come spanning pairs or sets, never all pairs, so rows grow with the sets. Only
   here and in stars do hashes travel.

Exact copies of a set are one representative (the smallest doc_id) before step 1.

Rows: null or empty text (or without words) is the empty set, linked with nothing; fewer words than n are one
shingle; rows of one doc_id are one node; a null doc_id is its own row without links. Of tables with more columns
only doc_id and text are read; `keep_first` passes the others through. Memory: a tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexloom.llm.common import Work, added, column_bytes, connected_components, groups, per_batch, with_ids

#: Sets in a strip, sum of their sizes in a tile of hashes, sets that share a frequent key, ratio of a band's borders.
TILE, ELEMENTS, HOT, WIDTH = 256, 1 << 20, 32, 1.5
#: Low bits of a key that hold its band.
BAND = 63
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct hashes of a text's n-word shingles; remembers hashes of words."""

    def __init__(self, n: int, cached: int = 500_000):
        self.n, self.cached = n, cached
        self._words: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z, and the blanks 9 to 13 and 32
        if not words:
            return np.zeros(0, np.uint64)
        known = list(map(self._words.get, words))
        if None in known:
            if len(self._words) > self.cached:
                self._words.clear()
            for w in set(words):
                if w not in self._words:
                    self._words[w] = xxhash.xxh3_64_intdigest(w)
            known = list(map(self._words.__getitem__, words))
        h = np.array(known, np.uint64)
        n = min(self.n, len(h))
        total = np.full(len(h) - n + 1, np.uint64(len(words) if n < self.n else self.n), np.uint64)
        for i in range(n):
            total = total * _M1 + h[i : len(h) - n + 1 + i]
        return np.unique(_mix(total))


class Bands:
    """Keys of a set for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def band(self, size: int) -> int:
        return int(math.log(size + 0.5) / math.log(WIDTH))

    def parts(self, band: int) -> tuple[int, int]:
        """(K, K - D) of a band."""
        most = math.ceil(WIDTH ** (band + 1) - 0.5)  # sizes of the band are below
        d = (self.den - self.num) * most // self.num
        k = d + 2 + d * 3 // 20
        return (k, k - d) if d else (0, 0)

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, int, list[int]]:
        """Keys, the lowest band, and for each band from there how many keys may be left out."""
        size = len(hashes)
        if not size:
            return np.zeros(0, np.int64), 0, []
        own, out, slack = self.band(size), [], []
        least = self.band(max(1, -(-self.num * size // self.den)))  # of the smallest partner
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_mix(hashes), dtype=np.uint64)))
        for band in range(least, own + 1):
            k, spare = self.parts(band)
            if not k:
                slack.append(0)
                continue
            edges = (np.arange(k + 1, dtype=object) * ((1 << 64) - 1) // k).astype(np.uint64)
            at = np.searchsorted(hashes, edges)
            at[0], at[-1] = 0, size
            full = np.flatnonzero(at[1:] != at[:-1])
            key = _mix(sums[at[full + 1]] - sums[at[full]] + _mix(full.astype(np.uint64) * _M2 + np.uint64(band)))
            empty = k - len(full)
            if empty >= spare:
                first = hashes[: (self.den - self.num) * size // self.den + 1]
                key = np.concatenate((key, _mix(first + _mix(np.array([band + 1000], np.uint64)))))
            slack.append(max(0, spare - 1 - empty))
            out.append(key & ~np.uint64(BAND) | np.uint64(band & BAND))
        return (np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)), least, slack


def features(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, set_key (binary, null for the empty set), keys (array<long>), least and slack of the bands."""
    names = ["doc_id", "n_shingles", "set_key", "keys", "least", "slack"]

    def run(batches):
        make, bands = Shingler(n), Bands(num, den)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, sets_, keys, leasts, slacks = [], [], [], [], []
            for text in column_bytes(batch.column("text")):
                h = make(text)
                key, least, slack = bands.keys(h)
                sizes.append(len(h))
                sets_.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                keys.append(key)
                leasts.append(least)
                slacks.append(slack)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets_, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(leasts, pa.int32()), pa.array(slacks, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names)

        yield from per_batch(one)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, keys array<long>, least int, slack array<int>")


def bits_of(size: int) -> int:
    """Bits of the bitmap of a set: two for each element at least, a power of two."""
    return min(1 << 16, max(64, 1 << (2 * size - 1).bit_length()))


def sets(docs: DataFrame, n: int) -> DataFrame:
    """id, size, bits (the bitmap), hashes (sorted shingle hashes) of rows (id, text), as bytes."""
    names = ["id", "size", "bits", "hashes"]

    def run(batches):
        make = Shingler(n)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [make(t) for t in column_bytes(batch.column("text"))]
            bits = [_bitmaps([h], bits_of(len(h)))[0].tobytes() for h in found]
            columns = [batch.column("id"), pa.array([len(h) for h in found], pa.int64()), pa.array(bits, pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        yield from per_batch(one)(batches)

    return docs.select("id", "text").mapInArrow(run, "id long, size long, bits binary, hashes binary")


def _bitmaps(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(hashes), bits // 8), np.uint8)
    for row, h in zip(out, hashes, strict=True):
        b = np.unique(h & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(row, b >> 3, (1 << (b & 7)).astype(np.uint8))
    return out.view(np.uint64)


def tile_links(ids: list[int], labels: list[int], hashes: list[np.ndarray], sides: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components inside a tile; between the two sides if both occur. Equal labels are one component."""
    n = len(ids)
    if n < 2:
        return []
    sizes = np.array([len(h) for h in hashes], np.int64)
    bits = min(1 << 16, max(64, 1 << int(2 * sizes.max()).bit_length()))
    maps = _bitmaps(hashes, bits)
    first: dict[int, int] = {}
    root = [first.setdefault(c, i) for i, c in enumerate(labels)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = np.argsort(sizes, kind="stable")
    sides_of = np.array(sides)
    two = len(set(sides)) == 2
    own = np.array(labels)
    links = []
    for at in range(n - 1):
        i = order[at]
        # larger sets that could still reach the threshold
        end = np.searchsorted(sizes[order], sizes[i] * den // num, "right")
        later = order[at + 1 : end]
        later = later[own[later] != own[i]]
        if two:
            later = later[sides_of[later] != sides_of[i]]
        if not len(later):
            continue
        missing_here = np.bitwise_count(maps[i] & ~maps[later]).sum(1, dtype=np.int64)
        missing_there = np.bitwise_count(maps[later] & ~maps[i]).sum(1, dtype=np.int64)
        most = np.minimum(sizes[i] - missing_here, sizes[later] - missing_there)
        passed = later[den * most >= num * (sizes[i] + sizes[later] - most)]
        for j in passed:
            a, b = find(i), find(j)
            if a == b:
                continue
            common = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
            if den * common >= num * (sizes[i] + sizes[j] - common):
                root[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
OPEN = pa.schema([("key", pa.int64()), ("tile", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("c", pa.int64())])


def _folded(bits: bytes, words: int) -> np.ndarray:
    """A bitmap halved until it has so many 64-bit words."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def passing(tile: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile (places in it) in different components whose overlap, bounded by bit counts, may reach the threshold; best bounds first."""
    own, sizes, sides = (tile.column(c).to_numpy() for c in ("c", "size", "side"))
    data = tile.column("bits").to_pylist()
    words = min(map(len, data)) // 8
    order = np.argsort(sizes, kind="stable")
    own, sizes, sides = own[order], sizes[order], sides[order]
    maps = np.stack([_folded(data[i], words) for i in order])
    two = len(np.unique(sides)) == 2
    out = []
    for i in range(len(own) - 1):
        end = np.searchsorted(sizes, sizes[i] * den // num, "right")
        later = np.arange(i + 1, max(end, i + 1))
        later = later[own[later] != own[i]]
        if two:
            later = later[sides[later] != sides[i]]
        if not len(later):
            continue
        here = np.bitwise_count(maps[i] & ~maps[later]).sum(1, dtype=np.int64)
        there = np.bitwise_count(maps[later] & ~maps[i]).sum(1, dtype=np.int64)
        most = np.minimum(sizes[i] - here, sizes[later] - there)
        union = sizes[i] + sizes[later] - most
        ok = den * most >= num * union
        if ok.any():
            out.append((np.full(ok.sum(), i), later[ok], most[ok] / union[ok]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none
    a, b, bound = map(np.concatenate, zip(*out, strict=True))
    best = np.argsort(-bound, kind="stable")
    return order[a[best]], order[b[best]]


LIVE = pa.schema([("key", pa.int64()), *LINKS])


def forest(tile: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Of pairs in an order as many as join components of the tile: fewer than it has sets."""
    ids, own = tile.column("id").to_numpy(), tile.column("c").to_numpy()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(int(own[i])), find(int(own[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((int(ids[i]), int(ids[j])))
    return pa.RecordBatch.from_arrays([pa.repeat(tile.column("key")[0], len(links)), pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], schema=LIVE)


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _exact(pairs: DataFrame, facts: DataFrame, num: int, den: int, stars: bool) -> DataFrame:
    """(a, b): links among pairs (hub, id), that span their components. facts: id, size, hashes.

    A tile is a hub with some of its ids, as many as TILE and ELEMENTS allow; in stars those meet each other as well.
    """
    sized = pairs.join(facts.select("id", "size"), "id").distinct()
    chunks = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / ELEMENTS)).cast("int")
    hubs = sized.groupBy("hub").agg(chunks.alias("chunks"))
    members = sized.join(hubs, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "id")
    centres = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("hub").alias("id"))
    rows = members.unionByName(centres).join(facts.select("id", "hashes"), "id")

    def run(batches):
        for tile in groups(batches, ["hub", "chunk"]):
            ids = tile.column("id").to_pylist()
            sides = [0] * len(ids) if stars else tile.column("side").to_pylist()
            found = tile_links(ids, ids, [np.frombuffer(x, np.uint64) for x in tile.column("hashes").to_pylist()], sides, num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=LINKS)

    return rows.repartition(_parts(rows), "hub", "chunk").sortWithinPartitions("hub", "chunk").mapInArrow(run, "a long, b long")


def _candidates(found: DataFrame, work: Work) -> DataFrame:
    """(key, id, w): sets that share keys; w says for how many keys with the same sets a key stands."""
    spark, own = work.spark, found.where("set_key is not null and doc_id is not null")
    firsts = own.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).where("m > 1")
    copies = own.select("doc_id", "set_key").join(firsts, "set_key").where("doc_id <> first").select("doc_id", "set_key").distinct()
    reps = with_ids(spark, own, work.table(copies, "copies"), "left_anti", ["doc_id", "set_key"])
    keyed = reps.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    h = F.xxhash64("id")
    repeated = keyed.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 34)).alias("s"), F.min("id").alias("low")).where("m > 1")
    repeated = work.table(repeated, "repeated")
    plain = repeated.where(F.col("m") <= HOT).groupBy("m", "x", "s", "low").agg(F.min("key").alias("key"), F.count("*").alias("w"))
    chosen = plain.select("key", "m", "w").unionByName(repeated.where(F.col("m") > HOT).select("key", "m", F.lit(1).cast("long").alias("w")))
    chosen = work.table(chosen, "chosen")
    work.drop("repeated")
    rows = work.table(with_ids(spark, keyed, chosen, "inner", "key"), "shared")
    hot = rows.where(F.col("m") > HOT).join(reps.select(F.col("doc_id").alias("id"), "least", "slack"), "id")
    band = F.col("key").bitwiseAND(F.lit(BAND))
    order = Window.partitionBy("id", "band").orderBy(F.desc("m"), F.desc("key"))
    hot = hot.withColumn("band", band).withColumn("rank", F.row_number().over(order)).where(F.col("rank") > F.get("slack", (F.col("band") - F.col("least")).cast("int")))
    rows = work.table(rows.where(F.col("m") <= HOT).select("key", "id", "w").unionByName(hot.select("key", "id", "w")), "rows")
    work.drop("copies", "chosen", "shared")
    return rows


def _tiles(rows: DataFrame, facts: DataFrame, num: int, den: int, work: Work, name: str) -> DataFrame:
    """(key, tile, side, id, c, size, bits): keys whose sets are in different components, cut into tiles. rows: key, id, c; facts: id, size, bits."""
    per = rows.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("bulk"), F.count("*").alias("k"))
    light = rows.join(per.where("k > 1").select("key", "bulk"), "key").join(facts.select("id", "size"), "id").distinct()
    bucket = F.floor(F.log(F.col("size")) / math.log(den / num) + 1e-9).cast("int")
    light = work.table(light.select("key", "id", "c", (F.col("c") == F.col("bulk")).alias("big"), bucket.alias("bucket")), f"light{name}")
    strips = light.groupBy("key", "big", "bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n"))
    strips = work.table(strips, f"strips{name}")
    each = strips.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.struct("big", "bucket", "sub").alias("one"))
    pairs = each.join(each.withColumnRenamed("one", "two"), "key").where("one <= two and not (one.big and two.big) and abs(one.bucket - two.bucket) <= 1")
    pairs = work.table(pairs, f"pairs{name}")
    placed = light.join(strips, ["key", "big", "bucket"]).select("key", "id", "c", F.struct("big", "bucket", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("sub")).alias("own"))
    tile = F.xxhash64("one", "two").alias("tile")
    ways = pairs.select("key", tile, F.col("one").alias("own"), F.lit(0).alias("side")).unionByName(pairs.where("one <> two").select("key", tile, F.col("two").alias("own"), F.lit(1).alias("side")))
    return placed.join(ways, ["key", "own"]).join(facts.select("id", "size", "bits"), "id").select("key", "tile", "side", "id", "c", "size", "bits")


def _dealt(tiles: DataFrame) -> DataFrame:
    return tiles.repartition(_parts(tiles), "key", "tile").sortWithinPartitions("key", "tile")


def _forests(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """(key, hub, id): of each tile the best passing pairs that would join its components; fewer rows than the tile has.

    A key with passing pairs is in the result, as the first of a tile's pairs always joins two components.
    """

    def run(batches):
        for tile in groups(batches, ["key", "tile"]):
            if tile.num_rows > 1:
                a, b = passing(tile, num, den)
                if len(a):
                    yield forest(tile, a, b)

    return _dealt(tiles).mapInArrow(run, "key long, a long, b long").select("key", F.col("a").alias("hub"), F.col("b").alias("id"))


def _open(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """(key, tile, side, id, c): of each tile the sets that have a passing pair."""

    def run(batches):
        for tile in groups(batches, ["key", "tile"]):
            if tile.num_rows > 1:
                a, b = passing(tile, num, den)
                if len(a):
                    yield from tile.take(pa.array(np.union1d(a, b))).select(OPEN.names).cast(OPEN).combine_chunks().to_batches()

    return _dealt(tiles).mapInArrow(run, "key long, tile long, side int, id long, c long")


def _gathered(opened: DataFrame, facts: DataFrame, work: Work) -> DataFrame:
    """The opened rows in fewer tiles. Near sets share many keys, so each of them is open in many tiles, mostly with the same others.

    Sets that are open together, directly or through others, are one group; its sets are cut into strips of TILE sets and ELEMENTS hashes,
    and strips meet each other. A group that would take more rows so than it has keeps its tiles.
    """
    hubs = opened.groupBy("key", "tile").agg(F.min("id").alias("hub"))
    edges = opened.join(hubs, ["key", "tile"]).where("id <> hub").select("id", "hub").distinct()
    named = work.table(connected_components(edges, "id", "hub"), "groups")
    rows = opened.join(named, "id")
    own = rows.groupBy("id", "c", "component").agg(F.count("*").alias("rows")).join(facts.select("id", "size"), "id")
    strips = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / ELEMENTS)).cast("int")
    per = own.groupBy("component").agg(strips.alias("n"), F.sum("rows").alias("rows"), F.count("*").alias("m"))
    few = work.table(per.where(F.col("m") * F.col("n") <= F.col("rows")).select("component", "n"), "few")
    strip = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    met = own.join(few, "component").select("component", "n", "id", "c", strip.alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tile = F.least("i", "j").cast("long") * F.col("n") + F.greatest("i", "j")
    cut = met.select(F.col("component").alias("key"), tile.alias("tile"), (F.col("i") > F.col("j")).cast("int").alias("side"), "id", "c")
    kept = with_ids(work.spark, rows, few.select("component"), "left_anti", "component").select("key", "tile", "side", "id", "c")
    return work.table(cut.unionByName(kept), "gathered")


def _exact_tiles(opened: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links of opened rows that join components, each pair of a tile intersected exactly unless it is joined already."""
    rows = opened.join(facts.select("id", "hashes"), "id")

    def run(batches):
        for tile in groups(batches, ["key", "tile"]):
            sides = tile.column("side").to_pylist()
            found = tile_links(tile.column("id").to_pylist(), tile.column("c").to_pylist(), [np.frombuffer(x, np.uint64) for x in tile.column("hashes").to_pylist()], sides, num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=LINKS)

    return _dealt(rows).mapInArrow(run, "a long, b long")


def _named(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """rows with their component's newer name in a column, where it has one."""
    new = names.select(F.col("id").alias(column), F.col("component").alias("_new"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def components(docs: DataFrame, found: DataFrame, n: int, num: int, den: int, work: Work) -> DataFrame:
    """(id, component) of representatives that are linked. found: the table "features" of `work`, which goes as soon as candidates are written."""
    spark = work.spark
    rows = _candidates(found, work)
    work.drop("features")
    ids = rows.select("id").distinct()
    texts = with_ids(spark, docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null"), work.table(ids, "ids"), "left_semi", "id")
    facts = work.table(sets(texts, n), "sets")
    shared = rows.join(rows.groupBy("key").agg(F.min("id").alias("hub")), "key").where("hub <> id").groupBy("id", "hub").agg(F.sum("w").alias("w"))
    stars = shared.groupBy("id").agg(F.max_by("hub", F.struct("w", -F.col("hub"))).alias("hub")).select("hub", "id")
    linked = work.table(_exact(stars, facts, num, den, True), "links1")
    labels = work.table(connected_components(linked), "labels1")
    named = rows.select("key", "id").withColumn("c", F.col("id"))
    for k in (2, 3):  # the best pairs between components, then all that are left
        tiles = _tiles(_named(named, labels, "c"), facts, num, den, work, str(k))
        if k == 2:
            forests = work.table(_forests(tiles, num, den), "forests")
            linked = work.table(_exact(work.table(forests.select("hub", "id").distinct(), "best"), facts, num, den, False), "links2")
            # components only grow: a key whose tiles had no passing pair has none later
            named = with_ids(spark, named, work.table(forests.select("key").distinct(), "live"), on="key")
        else:
            opened = work.table(_open(tiles, num, den), "open")
            linked = work.table(_exact_tiles(_gathered(opened, facts, work), facts, num, den), "links3")
        work.drop(f"light{k}", f"strips{k}", f"pairs{k}")
        if linked.isEmpty():
            continue
        edges = _named(_named(linked, labels, "a"), labels, "b")
        merged = work.table(connected_components(edges), f"merged{k}")
        both = _named(labels, merged, "component").unionByName(merged.join(labels, "id", "left_anti"))
        labels = work.table(both.distinct(), f"labels{k}")
    return labels


def join(spark: SparkSession, docs: DataFrame, n: int, num: int, den: int, work: Work | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; component_id is the smallest doc_id reachable by links."""
    work = work or Work(spark, "ngrams")
    whole = work.table(features(docs, n, num, den), "features")
    found = work.table(whole.select("doc_id", "n_shingles", "set_key"), "facts")
    names = components(docs, whole, n, num, den, work)
    reps = found.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    light = found.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left")
    out = _named(light.withColumn("c", F.coalesce("rep", "doc_id")), names, "c")
    # rows of one doc_id with different texts are one node
    several = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("m")).where("m > 1 and a <> b")
    several = work.table(several.select("doc_id", "a", "b"), "several")
    if not several.isEmpty():
        ends = out.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("c").alias("b"))
        out = _named(out, connected_components(ends), "c")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near-duplicates: of each component the row of its smallest doc_id stays; other columns pass through."""
    work, inner = Work(spark, "keep"), Work(spark, "ngrams")
    joined = work.table(join(spark, docs, n, num, den, inner), "joined")
    inner.drop()
    gone = joined.where("doc_id <> component_id").select("doc_id").distinct()
    return with_ids(spark, docs, gone, "left_anti")
