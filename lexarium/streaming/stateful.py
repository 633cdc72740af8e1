"""Rules over time that need state with a life of its own, by ``transformWithState``.

Rows of a key are held until the watermark has passed them and are then met in the order of their times, whatever order they came in, so a stream gives what the table form gives on all rows that weren't
later than the watermark allows.  What a key remembers goes by a timer once no later row can need it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """State with timers is kept by the RocksDB store; to be set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Holds a key's times until the watermark has passed them, then gives them to ``settled`` in order; equal times come together, with their number."""

    #: Microseconds after which what a key remembers is of no use.
    life: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "n long")
        self.wake = handle.getValueState("wake", "at long")
        self.kept = handle.getValueState("kept", "last long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = Counter(row["at"] for row in rows)
        for at, n in times.items():
            before = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
            self.waiting.updateValue((at,), ((before[0] if before else 0) + n,))
        self._wake_at(min(times), self.wake.get() if self.wake.exists() else None)
        return iter(())

    def _wake_at(self, first: int, now: tuple | None) -> None:
        """A timer for the first time that waits; a later one that is set already finds nothing to do."""
        if now is None or first < now[0]:
            self.wake.update((first,))
            self.handle.registerTimer(_millis(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((at[0], n[0]) for at, n in self.waiting.iterator())
        due = [h for h in held if _millis(h[0]) <= now]
        last, n = (self.kept.get() if self.kept.exists() else None) or (None, 0)
        for at, many in due:
            self.waiting.removeKey((at,))
            last, n, out = self.settled(key, at, many, last, n)
            yield from out
        left = held[len(due) :]
        if due:
            self.wake.clear()
        if left and due:
            self._wake_at(left[0][0], None)
        if last is not None and not left and _millis(last + self.life) < now:
            self.kept.clear()
            yield from self.over(key, last)
        elif due:
            self.kept.update((last, n))
            self.handle.registerTimer(_millis(last + self.life) + 1)

    def settled(self, key, at: int, many: int, last: int | None, n: int) -> tuple[int, int, list[Row]]:
        """What is remembered after ``many`` rows at a time, and the rows that they give."""
        raise NotImplementedError

    def over(self, key, last: int) -> list[Row]:
        """Rows to give when a key is forgotten."""
        return []

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """Milliseconds of a watermark that has passed the time."""
    return -(-micros // 1000)


class Dispatched(InOrder):
    """The first row of a key, and any more than ``life`` after the last that was given; rows that are skipped change nothing."""

    def __init__(self, life: int):
        self.life = life

    def settled(self, key, at, many, last, n):
        if last is None or at - last > self.life:
            return at, 1, [Row(key=key[0], at=at)]
        return last, n, []


class Counted(InOrder):
    """Rows of a key counted; each gives the key its whole life again, and after a life without a row the count begins anew."""

    def __init__(self, life: int):
        self.life = life

    def settled(self, key, at, many, last, n):
        n = many + (n if last is not None and at - last < self.life else 0)
        return at, n, [Row(key=key[0], at=at, n=n)]

    def over(self, key, last):
        return [Row(key=key[0], at=last + self.life, n=0)]


def _timed(rows: DataFrame, ts: str, delay: str, key: Column) -> DataFrame:
    """``key, ts, at`` under a watermark: times are compared in microseconds."""
    timed = rows.select(key.alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("ts IS NOT NULL").withWatermark("ts", delay)
    return timed.withColumn("at", F.unix_micros("ts"))


def dispatched_once(found: DataFrame, days: int, delay: str = "1 hour") -> DataFrame:
    """``sessions.dispatched_once`` over a stream of mentions (``id, ts``): first mention of each id, and any over ``days`` days after the last dispatched one: ``id, ts``.

    A mention is dispatched once the watermark, ``delay`` behind the latest time seen, has passed it; one that comes later than that is dropped.  Between its mentions an id is remembered for ``days`` days after
    its last dispatch."""
    with_state_store(found.sparkSession)
    kind = found.schema["id"].dataType.simpleString()
    rows = _timed(found, "ts", delay, F.col("id"))
    out = rows.groupBy("key").transformWithState(Dispatched(days * DAY), f"key {kind}, at long", "Append", "EventTime")
    return out.select(F.col("key").alias("id"), F.timestamp_micros("at").alias("ts"))


def living_counts(rows: DataFrame, key: Column, ts: str, days: int, delay: str = "1 hour") -> DataFrame:
    """``key, ts, n``: counters that live ``days`` days after their last row, as a stream of their states: a row at each time that adds to one, and a row with 0 at the time it is forgotten, once the
    watermark has passed that."""
    with_state_store(rows.sparkSession)
    timed = _timed(rows, ts, delay, key)
    out = timed.groupBy("key").transformWithState(Counted(days * DAY), f"key {timed.schema['key'].dataType.simpleString()}, at long, n long", "Append", "EventTime")
    return out.select("key", F.timestamp_micros("at").alias("ts"), "n")
