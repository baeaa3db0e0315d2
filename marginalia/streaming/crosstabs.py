"""Cross-tables over streams: running counts, event-time windows and chains of states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.crosstab import WEIGHT, weighted


def running(stream: DataFrame, variables: Sequence[str], weight: str | None = None) -> DataFrame:
    """A cross-table that follows the stream; write it in ``update`` or ``complete`` mode."""
    return weighted(stream, weight).groupBy(*variables).agg(F.sum(WEIGHT).alias(WEIGHT))


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The stream with a watermark on its time, as a timestamp of the session's time zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(stream: DataFrame, variables: Sequence[str], time: str, size: str, slide: str | None = None, late: str = "1 hour", weight: str | None = None) -> DataFrame:
    """Cross-tables of tumbling or sliding windows; rows later than ``late`` behind the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = weighted(timed(stream, time, late), weight).groupBy(w.alias("window"), *variables)
    return grouped.agg(F.sum(WEIGHT).alias(WEIGHT)).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *variables, WEIGHT)


def sessions(stream: DataFrame, key: str, variables: Sequence[str], time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Cross-tables of sessions: rows of a key less than ``gap`` apart."""
    grouped = weighted(timed(stream, time, late)).groupBy(F.session_window(time, gap).alias("window"), key, *variables)
    return grouped.agg(F.sum(WEIGHT).alias(WEIGHT)).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, *variables, WEIGHT)


def transitions(stream: DataFrame, key: str, state: str, time: str) -> DataFrame:
    """``key, previous, state`` for each row of a stream after the first of its key, in the order of arrival and time.

    The last state of each key is kept between batches. Within a batch the rows
    of a key are ordered by time as a whole, so they have to fit a task; limit
    the size of batches, such as by ``maxFilesPerTrigger``, for larger keys.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        rows = pd.concat([f[["time", "state"]] for f in frames])  # a key may come in several frames
        states = rows.sort_values(["time", "state"])["state"].tolist()
        before = [last, *states[:-1]]
        last = states[-1] if states else last
        found = [(k[0], a, b) for a, b in zip(before, states) if a is not None]
        yield pd.DataFrame(found, columns=["key", "previous", "state"])
        if last is not None:
            held.update((last,))

    chosen = stream.select(F.col(key).alias("key"), F.col(state).cast("string").alias("state"), F.col(time).alias("time"))
    return chosen.groupBy("key").applyInPandasWithState(step, f"key {kind}, previous string, state string", "last string", "append", "NoTimeout")


def day(time: Column) -> Column:
    return F.date_trunc("day", time)
