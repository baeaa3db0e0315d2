"""Streams fed in several batches give what the whole table gives."""

import datetime as dt

from pyspark.sql import functions as F

from marginalia.streaming import crosstabs

SCHEMA = "user long, kind string, ts timestamp"


def events():
    t0 = dt.datetime(2024, 1, 1)
    rows = [(u, "abc"[(u * k) % 3], t0 + dt.timedelta(minutes=17 * k + u)) for k in range(30) for u in range(3)]
    return sorted(rows, key=lambda r: r[2])


def fed(spark, path, build, mode, n=3):
    """Writes the events in n files, one batch each, and returns the rows of all batches, the last state per key in update mode."""
    rows = events()
    size = -(-len(rows) // n)
    got = []
    query = None
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        query = build(stream).writeStream.outputMode(mode).foreachBatch(lambda b, e: got.append(b.collect())).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return got


def test_running_counts(spark, tmp_path):
    got = {(r.kind,): r.weight for batch in fed(spark, str(tmp_path), lambda s: crosstabs.running(s, ["kind"]), "update") for r in batch}
    want = {}
    for _, kind, _ in events():
        want[(kind,)] = want.get((kind,), 0) + 1
    assert got == want


def test_windows(spark, tmp_path):
    got = {(r.start, r.kind): r.weight for batch in fed(spark, str(tmp_path), lambda s: crosstabs.windowed(s, ["kind"], "ts", "2 hours", late="1 day"), "update") for r in batch}
    want = {}
    for _, kind, ts in events():
        key = (ts.replace(hour=ts.hour // 2 * 2, minute=0), kind)
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_transitions_keep_state_between_batches(spark, tmp_path):
    got = [tuple(r) for batch in fed(spark, str(tmp_path), lambda s: crosstabs.transitions(s, "user", "kind", "ts"), "append") for r in batch]
    last, want = {}, []
    for user, kind, _ in events():
        if user in last:
            want.append((user, last[user], kind))
        last[user] = kind
    assert sorted(got) == sorted(want)


def test_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4),)], "ts timestamp")
    assert df.select(crosstabs.day(F.col("ts"))).first()[0] == dt.datetime(2024, 1, 2)
