"""Kept counts under replays, retractions and folding; ordered transitions with late rows and expiry."""

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.operators import learning
from marginalia.streaming.kept import KeptTable
from marginalia.streaming.ordered import ROCKS, ordered_transitions

T0 = dt.datetime(2024, 1, 1)


def counts(kept, **how):
    return {(r.a, r.b): r.weight for r in kept.read(**how).collect()}


def test_replays_retractions_and_folding(spark, tmp_path):
    rows = spark.createDataFrame([(k % 2, k % 3) for k in range(12)], "a int, b int")
    kept = KeptTable(spark, f"{tmp_path}/kept", ["a", "b"])
    with pytest.raises(ValueError, match="nothing"):
        kept.read()
    kept.apply(rows, 0)
    kept.apply(rows.where("a = 0"), 1)
    kept.apply(rows.where("a = 0"), 1)  # a replay
    assert counts(kept) == {(a, b): 2.0 * (2 - a) for a in (0, 1) for b in (0, 1, 2)}
    kept.apply(rows.limit(0), 2, retract=rows.where("a = 1"))
    assert counts(kept) == {(0, b): 4.0 for b in (0, 1, 2)}
    assert counts(kept, upto=0) == {(a, b): 2.0 for a in (0, 1) for b in (0, 1, 2)}
    kept.compact(1)
    kept.compact(1)
    kept.apply(rows, 0)  # a replay of what is folded
    assert counts(kept) == {(0, b): 4.0 for b in (0, 1, 2)} and kept.base() == 1
    with pytest.raises(ValueError, match="folded"):
        kept.read(upto=0)
    a, b = Variable("a", (0, 1)), Variable("b", (0, 1, 2))
    model = kept.train([a, b], {"a": [], "b": ["a"]})
    expected = learning.train(rows.where("a = 0"), [a, b], {"a": [], "b": ["a"]})
    for f, g in zip(model.factors, expected.factors):
        assert sorted(map(tuple, f.nonzero().collect())) == sorted(map(tuple, g.nonzero().collect()))


def test_signed_rows_of_a_stream(spark, tmp_path):
    for k, sign in enumerate((1, 1, -1)):
        spark.createDataFrame([(0, k % 2, sign), (1, 0, None)], "a int, b int, sign int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kept = KeptTable(spark, f"{tmp_path}/kept", ["a", "b"])
    stream = spark.readStream.schema("a int, b int, sign int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(kept.writer(sign="sign")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert counts(kept) == {(0, 1): 1.0, (1, 0): 3.0}


def test_ordered_transitions_over_batches(spark, tmp_path):
    def at(minutes):
        return T0 + dt.timedelta(minutes=minutes)

    files = [
        [(1, "a", at(0)), (1, "c", at(40)), (2, "x", at(10)), (1, None, at(5)), (3, "n", None)],
        [(1, "b", at(20)), (1, "d", at(90)), (2, "y", at(85))],  # b is late, but within the hour
        [(1, "z", at(10)), (9, "end", at(400))],  # z is too late: the watermark is at 30
        [(1, "e", at(430)), (9, "end", at(1000))],  # e comes over four hours after d
        [(9, "end", at(1001))],
    ]
    for f in files:
        spark.createDataFrame(f, "user long, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    got = collections.Counter()
    try:
        stream = spark.readStream.schema("user long, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = ordered_transitions(stream, "user", "kind", "ts", "1 hour", keep_ms=4 * 3_600_000)
        add = lambda batch, epoch: got.update((r.key, r.previous, r.state) for r in batch.collect())
        found.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == collections.Counter([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (2, "x", "y")])
