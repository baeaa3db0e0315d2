"""Keys share their state by buckets, so calls of the state store do not grow with the keys."""

import datetime as dt

from marginalia.streaming.ordered import ROCKS, ordered_transitions

SCHEMA = "user long, kind string, ts timestamp"


def test_many_keys_in_few_buckets(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    users = [*range(40), None]
    rows = [(u, "abc"[(k + (u or 0)) % 3], t0 + dt.timedelta(minutes=7 * k + (u or 0) % 5)) for u in users for k in range(5)]
    spark.createDataFrame(rows[::-1] + [(99, "a", t0 + dt.timedelta(days=1))], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        found = ordered_transitions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "user", "kind", "ts", "1 hour", keep_ms=3_600_000, buckets=3)
        got = []
        add = lambda batch, epoch: got.extend(tuple(r)[:3] for r in batch.collect())
        found.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    want = [(u, "abc"[(k + (u or 0)) % 3], "abc"[(k + 1 + (u or 0)) % 3]) for u in users for k in range(4)]
    assert sorted(got, key=str) == sorted(want, key=str)
