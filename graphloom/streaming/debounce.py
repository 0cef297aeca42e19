"""Bursts of file changes: a repository is rebuilt once it has been quiet for a while, in numbered generations, whatever order changes come in.

State of one repository: spans of quiet time (``slots``) with their first and last change, and the paths of each. Two changes of one slot are always of one
burst, so bursts are found from the few slots that are open, and a burst's paths go from the state store to the output one by one. Changes come in frames, and
the store is called for each path of a slot, not for each change. Changes later than the
watermark are dropped by Spark; others may come in any order and more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from graphloom.streaming.watch import invalidation

GENERATIONS = "root string, generation long, path string, invalidates string, started long, ended long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Paths of a batch that are remembered as told to the store, and rows of a frame that goes out.
TOLD, FRAME = 1_000_000, 10_000


class Bursts(StatefulProcessor):
    """Rows (root, generation, path, invalidates, started, ended) of bursts that have ended; times in microseconds."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms, self.quiet = quiet_ms, quiet_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.generation = handle.getValueState("generation", "n long")
        self.slots = handle.getMapState("slots", "slot long", "first long, last long")
        self.paths = handle.getMapState("paths", "slot long, path string", "invalidates string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        spans: dict[int, tuple[int, int]] = {}
        told: set[tuple[int, str]] = set()  # what the store has been told in this batch
        for frame in rows:
            frame = frame.assign(slot=frame["micros"] // self.quiet)
            for slot, first, last in frame.groupby("slot")["micros"].agg(["min", "max"]).itertuples(name=None):
                old = spans.get(slot, (first, last))
                spans[slot] = min(first, old[0]), max(last, old[1])
            for slot, path, invalidates in frame[["slot", "path", "invalidates"]].drop_duplicates(["slot", "path"]).itertuples(index=False, name=None):
                if (slot, path) not in told:
                    self.paths.updateValue((slot, path), (invalidates,))
                    told.add((slot, path))
            if len(told) > TOLD:
                told.clear()
        for slot, (first, last) in spans.items():
            if self.slots.containsKey((slot,)):
                old = self.slots.getValue((slot,))
                first, last = min(first, old[0]), max(last, old[1])
            self.slots.updateValue((slot,), (first, last))
        yield from self._frames(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._frames(key, timerValues)

    def _frames(self, key: tuple, timers: object) -> Iterator[pd.DataFrame]:
        ended = self._ended(key, timers)
        while rows := list(islice(ended, FRAME)):
            yield pd.DataFrame(rows, columns=["root", "generation", "path", "invalidates", "started", "ended"])

    def close(self) -> None:
        pass

    def _ended(self, key: tuple, timers: object) -> Iterator[tuple]:
        """What bursts that have ended hold; a timer is set for the first one that has not."""
        bursts: list[list] = []
        for (slot,), (first, last) in sorted((tuple(k), tuple(v)) for k, v in self.slots.iterator()):
            if bursts and first - bursts[-1][1] < self.quiet:
                bursts[-1][1] = last
                bursts[-1][2].append(slot)
            else:
                bursts.append([first, last, [slot]])
        now, burst_of, waiting = timers.getCurrentWatermarkInMs(), {}, None
        n = self.generation.get()[0] if self.generation.exists() else 0
        for first, last, slots in bursts:
            ends = -(-last // 1000) + self.quiet_ms
            if ends > now:
                waiting = ends
                break
            n += 1
            burst_of |= dict.fromkeys(slots, (n, first, last))
        if burst_of:
            gone = []
            for (slot, path), (invalidates,) in self.paths.iterator():
                if slot in burst_of:
                    generation, first, last = burst_of[slot]
                    yield key[0], generation, path, invalidates, first, last
                    gone.append((slot, path))
            for each in gone:
                self.paths.removeKey(each)
            for slot in burst_of:
                self.slots.removeKey((slot,))
            self.generation.update((n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting is not None:
            self.handle.registerTimer(waiting)


def generations(changes: DataFrame, *, quiet_ms: int = 200, late: str = "10 seconds") -> DataFrame:
    """The stream of ended bursts of a stream of changes (root, path, ts); changes of files that invalidate nothing are no changes
    and don't move the watermark.

    A path that a burst holds in several spans of quiet time comes as often: all rows of a burst come in one batch, where ``distinct`` settles it.
    """
    relevant = changes.select("root", "path", invalidation(F.col("path")).alias("invalidates"), "ts", F.unix_micros("ts").alias("micros")).where("invalidates is not null and root is not null and ts is not null")
    return relevant.withWatermark("ts", late).groupBy("root").transformWithStateInPandas(Bursts(quiet_ms), GENERATIONS, "Append", "EventTime")


def rebuild_when_quiet(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, *, quiet_ms: int = 200, late: str = "10 seconds", **trigger: object) -> StreamingQuery:
    """Calls ``rebuild`` with the distinct (root, generation, path, invalidates, started, ended) of bursts that have ended, and the batch's number.

    A batch that is run again after a failure has its number again and the same rows, so a ``rebuild`` that writes by number is exact.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rebuild(rows.distinct(), number)

    spark, name = changes.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)  # state of this kind needs it; a stream takes the settings it starts with
    try:
        stream = generations(changes, quiet_ms=quiet_ms, late=late).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return stream.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(name, before)
