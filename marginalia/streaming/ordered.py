"""Transitions of a stream in event time, with state that is kept by timers and expires."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Holds the rows of a bucket of keys until the watermark has passed them, then links those of each key in the order of time.

    ``waiting`` is a list state of the rows not passed yet: no more than come
    within the lateness. ``last`` has the newest state passed of each key of
    the bucket, which expires ``keep_ms`` after its time. State is read and
    written for a bucket at once, as every call costs more than many rows.
    """

    def __init__(self, keep_ms: int, kept: StructType, out: list[str]):
        self.keep_ms, self.kept, self.out = keep_ms, kept, out

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kept)
        self.last = handle.getListState("last", self.kept)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        some: list[tuple[Any, int, str]] = []
        for r in rows:  # they are put away a few at a time, not held together
            if r["at"] >= passed * 1000:
                some.append((r["key"], r["at"], r["state"]))
                first = r["at"] if first is None else min(first, r["at"])
            if len(some) == 1000:
                self.waiting.appendList(some)
                some = []
        if some:
            self.waiting.appendList(some)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready: list[tuple[int, str, Any]] = []
        later: list[tuple[Any, int, str]] = []
        for k, at, state in self.waiting.get() if self.waiting.exists() else ():
            if at < passed * 1000:
                ready.append((at, state, k))
            else:
                later.append((k, at, state))
        last = {k: (at, state) for k, at, state in (self.last.get() if self.last.exists() else ())}
        known = len(last)
        found = []
        ready.sort(key=lambda r: r[:2])
        for at, state, k in ready:
            before = last.get(k)
            if before is not None and at - before[0] <= self.keep_ms * 1000:
                found.append((k, before[1], state, at))
            last[k] = (at, state)
        if ready:
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(r[1] for r in later) // 1000 + 1)
            else:
                self.waiting.clear()
        left = [(k, at, state) for k, (at, state) in last.items() if passed <= at // 1000 + self.keep_ms]  # nothing that may still come can follow the others
        if left:
            if ready or len(left) < known:
                self.last.put(left)
            self.handle.registerTimer(min(r[1] for r in left) // 1000 + self.keep_ms + 1)
        elif known:
            self.last.clear()
        return iter([Row(*self.out)(*f) for f in found])

    def close(self) -> None:
        pass


def ordered_transitions(stream: DataFrame, key: str, state: str, time: str, late: str = "1 hour", keep_ms: int = 7 * 86_400_000, buckets: int = 1024) -> DataFrame:
    """``key, previous, state, at`` for each row after the first of its key, in the order of event time, whatever the order of arrival.

    A row is given out once the watermark, ``late`` behind the newest row of
    the stream, has passed it; rows that come later than that are dropped. Rows
    of one key and time go by state. A state is forgotten ``keep_ms``
    milliseconds after its time, so a row that comes later than that after the
    one before it has no previous state, and no key is held for ever. Keys
    are dealt over ``buckets`` that hold their state together. Rows with
    a null time or state are left out. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), and protobuf.
    """
    kind = stream.schema[key].dataType
    timed = stream.select(F.col(key).alias("key"), F.col(state).cast("string").alias("state"), F.col(time).cast("timestamp").alias("ts"))
    timed = timed.where(F.col("ts").isNotNull() & F.col("state").isNotNull()).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    kept = StructType().add("key", kind).add("at", "long").add("state", "string")
    out = StructType().add("key", kind).add("previous", "string").add("state", "string").add("at", "long")
    dealt = timed.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithState(Ordered(keep_ms, kept, out.names), out, "Append", "EventTime")
