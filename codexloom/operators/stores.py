"""Reads and writes of application stores as set operations: tenants, deletions, conversations, limits, one-time codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.operators.search import top_k

#: One-time codes: wrong tries before a lock, minutes of the lock and of validity. Fixed values.
TRIES, LOCK, VALID = 5, 15, 10


def live(rows: DataFrame, user: Column | str | int | None = None) -> DataFrame:
    """Rows(deleted_at, user_id, ...) that aren't deleted, of one user where one is given."""
    kept = rows.where("deleted_at is null")
    return kept if user is None else kept.where(F.col("user_id") == (user if isinstance(user, Column) else F.lit(user)))


def since(rows: DataFrame, column: str, now: Column, minutes: int = 60) -> DataFrame:
    """Rows whose time lies in the last so many minutes, the border included."""
    return rows.where((F.col(column) >= now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(column) <= now))


def owned(rows: DataFrame, parents: DataFrame, key: str, user: Column | int) -> DataFrame:
    """Rows whose parent(key, user_id) belongs to a user: a semi join in place of a correlated EXISTS."""
    mine = parents.where(F.col("user_id") == (user if isinstance(user, Column) else F.lit(user))).select(key)
    return rows.join(mine, key, "left_semi")


def recent_first(rows: DataFrame, per: list[str], column: str, tie: str, most: int) -> DataFrame:
    """The latest rows of each group; rows without a time come last."""
    return top_k(rows, per, most, F.desc_nulls_last(column), tie)


def least_recent_out(rows: DataFrame, column: str, tie: str, most: int = 1000) -> DataFrame:
    """The `most` rows used last: the others are evicted. A limit after an order is a top-k in each task, then one merge."""
    return rows.orderBy(F.desc_nulls_last(column), tie).limit(most)


def fixed_chunks(rows: DataFrame, per: list[str], order: str, n: int) -> DataFrame:
    """Number the rows of a group into chunks of n, in order."""
    place = F.row_number().over(Window.partitionBy(*per).orderBy(order))
    return rows.withColumn("chunk", F.floor((place - 1) / n).cast("long"))


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """existing rows and, with is_new, those of wanted whose keys none has; repeated wishes make one row."""
    new = wanted.dropDuplicates(keys).join(existing, keys, "left_anti").withColumn("is_new", F.lit(True))
    return existing.withColumn("is_new", F.lit(False)).unionByName(new, allowMissingColumns=True)


def retitled(conversations: DataFrame, titles: DataFrame) -> DataFrame:
    """conversations(conv_id, title, is_manual) with titles(conv_id, new_title) unless their title was set by hand."""
    out = conversations.join(titles, "conv_id", "left")
    return out.withColumn("title", F.when(~F.coalesce("is_manual", F.lit(False)) & F.col("new_title").isNotNull(), F.col("new_title")).otherwise(F.col("title"))).drop("new_title")


def complete(runs: DataFrame, docs: DataFrame, versions: DataFrame, most: int = 25) -> DataFrame:
    """The latest runs(run_id, user_id, doc_id, version_id, created_at) of each user that still have both their document and version."""
    latest = top_k(runs, ["user_id"], most, F.desc("created_at"), "run_id").drop("rank")
    return latest.join(docs, "doc_id").join(versions, "version_id")


def rate_windows(events: DataFrame, keys: list[str], time: str = "ts", seconds: int = 3600) -> DataFrame:
    """Events with the start of their window and their number in it: a window opens at the first event after the one before has ended.

    A key's times are folded in order; only times are held, and a key's own events bound them.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    times = events.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("_times"))

    def step(a: Column, t: Column) -> Column:
        opens = (F.size(a) == 0) | (t >= F.element_at(a, -1) + seconds * 1_000_000)
        return F.when(F.size(a) == 0, F.array(t)).when(opens, F.concat(a, F.array(t))).otherwise(a)

    starts = F.aggregate("_times", F.array().cast("array<bigint>"), step)
    opened = times.select(*keys, F.explode(starts).alias("_start")).withColumn("_until", F.col("_start") + seconds * 1_000_000)
    joined = events.withColumn("_at", at).join(opened, keys).where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_until")))
    n = F.row_number().over(Window.partitionBy(*keys, "_start").orderBy("_at"))
    return joined.withColumn("window_start", F.timestamp_micros("_start")).withColumn("n", n).drop("_at", "_start", "_until")


def code_hash(code: Column, salt: Column) -> Column:
    return F.sha2(F.concat(code, salt), 256)


def code_checks(attempts: DataFrame, codes: DataFrame) -> DataFrame:
    """Attempts(user_id, at, hash) with their outcome against each user's latest codes(user_id, created_at, code_hash).

    ok, used, locked, expired, wrong or none. The fifth wrong try locks a code for 15 minutes, and each later one again; a code is
    valid for 10 minutes and for one success. A user's tries against one code are folded in order.
    """
    latest = attempts.join(codes, "user_id", "left").where("created_at is null or created_at <= at").groupBy("user_id", "at", "hash").agg(F.max("created_at").alias("created_at"), F.max_by("code_hash", "created_at").alias("code_hash"))
    missing = attempts.join(latest.select("user_id", "at", "hash"), ["user_id", "at", "hash"], "left_anti").select("user_id", "at", "hash", F.lit("none").alias("outcome"))
    none = latest.where("created_at is null").select("user_id", "at", "hash", F.lit("none").alias("outcome"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    tries = latest.where("created_at is not null").groupBy("user_id", "created_at").agg(F.array_sort(F.collect_list(F.struct(micros("at").alias("t"), "hash", (F.col("hash") == F.col("code_hash")).alias("right"), (micros("created_at") + VALID * 60_000_000).alias("until")))).alias("ts"))

    def step(a: Column, x: Column) -> Column:
        locked = a["locked"] > x["t"]
        wrong = ~a["used"] & ~locked & (x["until"] >= x["t"]) & ~x["right"]
        failed = a["failed"] + F.when(wrong, 1).otherwise(0)
        outcome = F.when(a["used"], "used").when(locked, "locked").when(x["until"] < x["t"], "expired").when(x["right"], "ok").otherwise("wrong")
        row = F.struct(x["t"].alias("t"), x["hash"].alias("hash"), outcome.alias("outcome"))
        return F.struct((a["used"] | (outcome == "ok")).alias("used"), failed.alias("failed"), F.when(wrong & (failed >= TRIES), x["t"] + LOCK * 60_000_000).otherwise(a["locked"]).alias("locked"), F.concat(a["out"], F.array(row)).alias("out"))

    begin = F.struct(F.lit(False).alias("used"), F.lit(0).alias("failed"), F.lit(0).cast("long").alias("locked"), F.array().cast("array<struct<t: bigint, hash: string, outcome: string>>").alias("out"))
    folded = tries.select("user_id", F.inline(F.aggregate("ts", begin, step, lambda a: a["out"])))
    done = folded.select("user_id", F.timestamp_micros("t").cast(attempts.schema["at"].dataType).alias("at"), "hash", "outcome")
    return done.unionByName(none).unionByName(missing)


def dialogues(turns: DataFrame, minutes: int = 60, most: int = 50) -> DataFrame:
    """Turns(conv_id, ts, turn) numbered into dialogues that end after so many idle minutes; of each the last `most` turns stay."""
    w = Window.partitionBy("conv_id").orderBy("ts", "turn")
    gap = F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {minutes} MINUTES")
    rows = turns.withColumn("dialogue", F.sum(F.when(gap, 1).otherwise(0)).over(w))
    back = F.row_number().over(Window.partitionBy("conv_id", "dialogue").orderBy(F.desc("ts"), F.desc("turn")))
    return rows.withColumn("_back", back).where(F.col("_back") <= most).drop("_back")


def registry(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_number, contracts): how far each conversation has come, and the contracts that it named, in order of first mention."""
    named = turns.where("contract is not null").groupBy("conv_id", "contract").agg(F.min("turn").alias("first")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "contract"))), lambda x: x["contract"]).alias("contracts"))
    return turns.groupBy("conv_id").agg(F.max("turn").alias("turn_number")).join(named, "conv_id", "left").withColumn("contracts", F.coalesce("contracts", F.array().cast("array<string>")))
