"""Shared pieces: the folder that all executors see, written tables, tiles, prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a table of keys may be broadcast after counting it; beyond it the join shuffles.
BROADCAST_ROWS = 250_000
#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; in local mode alone, where none is set, a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    root = root or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codexloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Work:
    """A folder of its own under the shared one, for tables and files that live as long as the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/codexloom-{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)
        self._names: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back: lineage ends here, and a lost executor costs no earlier work.

        The write's own shuffle files go when it ends, so the disk holds one step's shuffles at a time.
        """
        path, conf = f"{self.path}/{name}", self.spark.conf
        if name in self._names:  # a second table of that name in one folder
            path += f"-{len(self._names)}"
        self._names.append(name)
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without names, the whole folder."""
        for path in [f"{self.path}/{n}" for n in names] or [self.path]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def with_ids(spark: SparkSession, df: DataFrame, ids: DataFrame, how: str = "left_semi", on: str = "doc_id") -> DataFrame:
    """Join df with a table of ids: broadcast only if a count shows that it is small, else by shuffle."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), on, how)


def refuse(df: DataFrame, *names: str) -> None:
    """An operator's new columns must not be there already."""
    if taken := [n for n in names if n.lower() in map(str.lower, df.columns)]:
        raise ValueError(f"the table has columns of these names already: {taken}")


def fresh(df: DataFrame, name: str) -> str:
    """A working column's name that the table doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def added(schema: T.StructType, *fields: str) -> T.StructType:
    """A copy of the schema with more fields, each "name type"."""
    return T.StructType(list(schema.fields) + [f for x in fields for f in T.StructType.fromDDL(x).fields])


def column_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def column_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512, size: int = 8 << 20):
    """For mapInArrow: f on slices of at most `rows` rows and, where a row allows it, `size` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(rows, batch.num_rows - at)
                while n > 1 and batch.slice(at, n).get_total_buffer_size() > 0 and _bytes(batch, at, n) > size:
                    n //= 2
                yield f(batch.slice(at, n))
                at += n

    return run


def _bytes(batch: pa.RecordBatch, at: int, n: int) -> int:
    return batch.slice(at, n).nbytes


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches sorted by them; holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        starts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
        for i, j in zip(starts, [*starts[1:], len(key)], strict=True):
            if held and key[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key[i]
    if held:
        yield pa.Table.from_batches(held)


def with_base(df: DataFrame, part: str, amount: str, base: str) -> DataFrame:
    """Add the sum of `amount` over all smaller `part` values: a prefix sum over one total per written part.

    The totals are one row per part file, so the single ordered window sees thousands of rows, not data.
    """
    from pyspark.sql import Window

    totals = df.groupBy(part).agg(F.sum(amount).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(totals.select(part, before.cast("long").alias(base)), part)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in an edge; component is the smallest id reachable.

    Alternating large-star and small-star rounds: each round is two joins on one key, the number of
    rounds is logarithmic in the number of ids, and no id gathers its neighbours in one task's memory.
    """
    work = Work(edges.sparkSession, "components")
    e = work.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "round0")
    seen, k = None, 0
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = work.table(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), f"round{k + 1}")
        work.drop(f"round{k}")
        k += 1
        sign = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == seen:
            break
        seen = sign
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
