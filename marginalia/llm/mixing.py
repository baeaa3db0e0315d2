"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source's documents are cut into blocks. Block ``i`` of a source of weight
``w`` is released at slot ``floor(i / w)`` and due at ``ceil((i + 1) / w)``;
serving the earliest deadline among the released blocks keeps every source
within one block of its weight at every slot. Weights are exact fractions, so
the schedule repeats after as many slots as their common denominator. The
driver goes through one period, or all slots if they are fewer, and keeps how
many blocks each source has had at every ``RANGE``-th slot. From there tasks
go through the ranges again, each on its own, and write the slots, which the
documents join: no machine holds them all, unless they are few.

Sources run out at different times: then a new phase begins, in which the
remaining sources share the slots by their renormalised weights. Nothing is
dropped or repeated. A document's place needs only its rank within its
source, which salted windows give without collecting a source in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.shared import materialise, plain_names, salted_rank

SALTS = 64
RANGE = 1 << 16
NONE = "\0none"


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The smallest whole numbers in the proportion of the weights as they are written in decimals."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    share = {k: int(x * scale) for k, x in exact.items()}
    common = math.gcd(*share.values())
    return {k: a // common for k, a in share.items()}


def served(share: dict[str, int], period: int, done: dict[str, int], begin: int, end: int) -> Iterator[str]:
    """The sources of the slots from ``begin`` to ``end`` of a period, earliest deadline first among released blocks; ``done`` is what each has had before."""
    coming = [(done[name] * period // a, name, done[name]) for name, a in share.items() if done[name] < a]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    for t in range(begin, end):
        while coming and coming[0][0] <= t:
            _, name, i = heapq.heappop(coming)
            a = share[name]
            heapq.heappush(ready, (-(-(i + 1) * period // a), name, i))
            if i + 1 < a:
                heapq.heappush(coming, ((i + 1) * period // a, name, i + 1))
        due, name, _ = heapq.heappop(ready)
        if due <= t:
            raise ValueError("weights exceed one")
        yield name


class Period:
    """One period of a schedule, or its part until some source's last block, known by what each source has had at every ``every``-th slot."""

    def __init__(self, share: dict[str, int], blocks: dict[str, int] | None = None, every: int = RANGE):
        self.share, self.size, self.every = share, sum(share.values()), every
        self.names = list(share)
        self.states: list[list[int]] = []
        self.done = dict.fromkeys(share, 0)  # at the end
        self.end = 0
        self.cut = False  # some source's last block has been served
        for name in served(share, self.size, dict(self.done), 0, self.size):
            if self.end % every == 0:
                self.states.append([self.done[k] for k in self.names])
            self.end += 1
            self.done[name] += 1
            if blocks and self.done[name] == blocks[name]:
                self.cut = True
                break

    def again(self, r: int, until: int | None = None) -> Iterator[str]:
        """The sources of the slots of the ``r``-th range."""
        begin = r * self.every
        return served(self.share, self.size, dict(zip(self.names, self.states[r])), begin, min(begin + self.every, self.end if until is None else until))

    def slot(self, name: str, i: int) -> int:
        """The slot of a source's ``i``-th block of the period."""
        k = self.names.index(name)
        r = max(r for r, state in enumerate(self.states) if state[k] <= i)
        left = i - self.states[r][k]
        for t, n in enumerate(self.again(r), r * self.every):
            if n == name:
                if not left:
                    return t
                left -= 1
        raise IndexError(i)

    def had(self, t: int) -> dict[str, int]:
        """How many blocks each source has had before slot ``t`` of the period."""
        if t == self.end:
            return dict(self.done)
        r = t // self.every
        found = dict(zip(self.names, self.states[r]))
        for name in self.again(r, t):
            found[name] += 1
        return found


def phases(blocks: dict[str, int], weights: dict[str, float], every: int = RANGE) -> list[dict]:
    """Phases until all blocks are placed: start slot, period, and per source its first block, number, and slots in a period."""
    left, done, start, found = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        period = Period(whole({k: weights[k] for k in left}), left, every)
        share, size = period.share, period.size
        if period.cut:
            end = size = period.end
            had = dict(period.done)
            share = {k: max(1, n) for k, n in had.items()}
        else:
            end = min((n - 1) // share[k] * size + period.slot(k, (n - 1) % share[k]) for k, n in left.items()) + 1
            rest = period.had(end % size)
            had = {k: end // size * share[k] + rest[k] for k in left}
        found.append({"start": start, "period": period, "size": size, "parts": {k: (done[k], had[k], share[k]) for k in left}})
        for k, n in had.items():
            done[k] += n
            left[k] -= n
        left = {k: n for k, n in left.items() if n > 0}
        start += end
    return found


def schedule(spark: SparkSession, found: list[dict]) -> DataFrame:
    """``_phase, _source, _nth, _t``: the slot in its period of every source's block of a period, written. A task goes through each range."""
    ranges = [(p, r, phase["period"].states[r]) for p, phase in enumerate(found) for r in range(len(phase["period"].states))]
    fixed = {p: (x["period"].share, x["period"].size, x["period"].names, x["period"].every, x["period"].end) for p, x in enumerate(found)}  # a few numbers for each source and phase

    def slots(batches):
        for b in batches:
            for p, r, state in zip(b["p"], b["r"], b["state"]):
                share, size, names, every, end = fixed[p]
                done = dict(zip(names, map(int, state)))
                nth, source = [], []
                for name in served(share, size, dict(done), r * every, min((r + 1) * every, end)):
                    source.append(name)
                    nth.append(done[name])
                    done[name] += 1
                yield pd.DataFrame({"_phase": int(p), "_source": source, "_nth": nth, "_t": np.arange(r * every, r * every + len(nth))})

    rows = spark.createDataFrame(ranges, "p int, r long, state array<long>")
    if len(ranges) > 1:
        rows = rows.repartition(len(ranges))
    return materialise(rows.mapInPandas(slots, "_phase int, _source string, _nth long, _t long"), "slots")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, block: int = 8, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """Every column of ``docs`` with ``_source_rank, _block, _slot`` and ``_position``.

    Sources absent from ``weights`` get ``default``; all weights are positive.
    A null source is a source of its own, with the default weight. Within a
    source, rows go in an order set by a hash of the id; repeated ids, nulls
    too, are separate rows. ``_position`` counts from 0 and is unique, but
    leaves gaps after a source's last, shorter block. The number of sources is
    taken to fit the driver. The driver's time grows with the smaller of the
    weights' common denominator and the number of blocks; what it keeps is
    a number for each source and ``RANGE`` slots.
    """
    spark = docs.sparkSession
    given = dict(weights or {})
    if default <= 0 or any(w <= 0 for w in given.values()):
        raise ValueError("weights are positive")
    added = ("_source_rank", "_block", "_slot", "_position")
    plain, names, at = plain_names(docs, added)
    hashable = [c for c, kind in plain.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = plain.withColumn("_source", F.coalesce(F.col(at[source_col]).cast("string"), F.lit(NONE)))
    keyed = keyed.withColumns({"_place": F.xxhash64(at[id_col], F.lit("mix")), "_tie": F.xxhash64(*hashable)})
    full, counted = salted_rank(keyed, ["_source"], ["_place", "_tie"], "_source_rank", SALTS)
    totals: dict[str, int] = {}
    ahead: dict[str, list[int]] = {}
    for source, salt, n in sorted(tuple(r) for r in counted.collect()):  # SALTS rows of each source
        ahead.setdefault(source, [0] * SALTS)[salt] = totals.get(source, 0)
        totals[source] = totals.get(source, 0) + n
    found = phases({s: -(-n // block) for s, n in totals.items()}, {s: given.get(s, default) for s in totals})
    # SALTS numbers a source, and a few for each source and phase
    shared = spark.sparkContext.broadcast((ahead, [(x["start"], x["size"], x["parts"]) for x in found]))

    own = ("_source_rank", "_block", "_phase", "_nth", "_from")
    kinds = (T.LongType(), T.LongType(), T.IntegerType(), T.LongType(), T.LongType())
    schema = T.StructType([*plain.schema.fields, T.StructField("_source", T.StringType()), *(T.StructField(c, kind) for c, kind in zip(own, kinds))])
    width = len(names) + 1

    def rows(batches):
        ahead, found = shared.value
        for b in batches:
            source = b.column("_source").to_pylist()
            rank = b.column("_source_rank").to_numpy(zero_copy_only=False) + np.array([ahead[s][k] for s, k in zip(source, b.column("_salt").to_pylist())], dtype=np.int64)
            block_ = rank // block
            phase, nth, start = np.zeros(len(rank), dtype=np.int32), np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            names_ = np.array(source, dtype=object)
            for s in set(source):
                mine = names_ == s
                for p, (begin, size, parts) in enumerate(found):
                    if s in parts:
                        first, n, share = parts[s]
                        here = mine & (block_ >= first) & (block_ < first + n)
                        k = block_[here] - first
                        phase[here], nth[here], start[here] = p, k % share, begin + k // share * size
            extra = (rank, block_, phase, nth, start)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *(pa.array(x) for x in extra)], names=[*schema.names])

    placed = full.select(*plain.columns, "_source", "_salt", "_source_rank").mapInArrow(rows, schema)
    joined = placed.join(schedule(spark, found), ["_phase", "_source", "_nth"])  # the planner knows the schedule's size
    slot = F.col("_from") + F.col("_t")
    return joined.select(*plain.columns, "_source_rank", "_block", slot.alias("_slot"), (slot * block + F.col("_source_rank") % block).alias("_position")).toDF(*names, *added)
