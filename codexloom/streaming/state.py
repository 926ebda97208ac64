"""Keyed streaming state: windows from the first hit, dialogues with bounded memory, one-time codes.

Each processor keeps a few values of a key between batches and answers each row as it comes; rows of a batch are taken in order of time.
State stores are RocksDB: a key's state isn't in the heap, and a lost executor's state comes back from the checkpoint folder. A
processor that needs it sets the session's state store by `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codexloom.operators.stores import LOCK, TRIES, VALID

#: The state store that such processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def kept(spark: SparkSession) -> None:
    """Use the state store that processors need in the session's next streams."""
    spark.conf.set(*PROVIDER)


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one batch."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class Windows(StatefulProcessor):
    """A window opens at the first row after the one before has ended; rows get its start and their number in it."""

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.window.get() if self.window.exists() else (None, 0)
        table = _sorted(rows, ["at", "id"])
        starts, numbers = [], []
        for at in table["at"].tolist():
            if start is None or at >= start + self.span:
                start, n = at, 0
            n += 1
            starts.append(start)
            numbers.append(n)
        self.window.update((start, n))
        yield pd.DataFrame({"key": [key[0]] * len(table), "id": table["id"], "at": table["at"], "start": starts, "n": numbers})

    def close(self) -> None:
        pass


class Dialogues(StatefulProcessor):
    """Turns numbered into dialogues that end after idle time; the last `most` turns of the open dialogue are held."""

    def __init__(self, minutes: int, most: int):
        self.idle, self.most = minutes * 60_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "last long, dialogue long")
        self.turns = handle.getListState("turns", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, dialogue = self.place.get() if self.place.exists() else (None, 0)
        held = [x[0] for x in self.turns.get()] if self.turns.exists() else []
        out = []
        for at, turn in _sorted(rows, ["at", "id"])[["at", "id"]].itertuples(index=False):
            if last is not None and at > last + self.idle:
                dialogue, held = dialogue + 1, []
            held = [*held, int(turn)][-self.most :]
            last = int(at)
            out.append((key[0], int(turn), last, dialogue, len(held), held[0]))
        self.place.update((last, dialogue))
        self.turns.put([(x,) for x in held])
        yield pd.DataFrame(out, columns=["key", "id", "at", "dialogue", "held", "first"])

    def close(self) -> None:
        pass


class Codes(StatefulProcessor):
    """Tries of one-time codes against a key's latest code: ok, used, locked, expired, wrong or none. Rows with is_code make codes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.code = handle.getValueState("code", "hash string, until long, used boolean, failed long, locked long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        code = self.code.get() if self.code.exists() else None
        out = []
        table = pd.concat(list(rows), ignore_index=True)
        table["later"] = ~table["is_code"].astype(bool)
        for at, turn, is_code, hash_ in table.sort_values(["at", "later", "id"], kind="stable")[["at", "id", "is_code", "hash"]].itertuples(index=False):
            if is_code:
                code = (hash_, int(at) + VALID * 60_000_000, False, 0, 0)
                continue
            if code is None:
                out.append((key[0], int(turn), int(at), "none"))
                continue
            wanted, until, used, failed, locked = code
            right = hash_ == wanted
            outcome = "used" if used else "locked" if locked > at else "expired" if until < at else "ok" if right else "wrong"
            if outcome == "wrong":
                failed += 1
                locked = int(at) + LOCK * 60_000_000 if failed >= TRIES else locked
            code = (wanted, until, used or outcome == "ok", failed, locked)
            out.append((key[0], int(turn), int(at), outcome))
        if code is not None:
            self.code.update(code)
        yield pd.DataFrame(out, columns=["key", "id", "at", "outcome"])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    kept(rows.sparkSession)
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "None")


def _timed(events: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    return events.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(id_).cast("long").alias("id"))


def windows(events: DataFrame, key: str = "user_id", time: str = "ts", id_: str = "event_id", seconds: int = 3600) -> DataFrame:
    """(key, id, at, start, n) of a stream of events; times are microseconds."""
    kind = events.schema[key].dataType.simpleString()
    return _run(_timed(events, key, time, id_), Windows(seconds), f"key {kind}, id long, at long, start long, n long")


def dialogues(turns: DataFrame, key: str = "user_id", time: str = "ts", id_: str = "event_id", minutes: int = 60, most: int = 50) -> DataFrame:
    """(key, id, at, dialogue, held, first) of a stream of turns: the number of turns in memory after it, and the first of them."""
    kind = turns.schema[key].dataType.simpleString()
    return _run(_timed(turns, key, time, id_), Dialogues(minutes, most), f"key {kind}, id long, at long, dialogue long, held long, first long")


def codes(rows: DataFrame) -> DataFrame:
    """(key, id, at, outcome) of a stream of rows(key, at, id, is_code, hash); a code of the same moment comes before tries."""
    kind = rows.schema["key"].dataType.simpleString()
    return _run(rows.select("key", "at", "id", "is_code", "hash"), Codes(), f"key {kind}, id long, at long, outcome string")
