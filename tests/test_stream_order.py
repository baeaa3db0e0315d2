"""A key with more rows than an Arrow batch, in no order of time."""

import collections
import datetime as dt

from marginalia.streaming import crosstabs
from tests.test_streams import SCHEMA


def test_transitions_of_a_key_in_several_frames(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    kinds = ["abc"[k * k % 7 % 3] for k in range(25_000)]
    rows = [(1, s, t0 + dt.timedelta(seconds=k)) for k, s in enumerate(kinds)]
    spark.createDataFrame(rows[::-2] + rows[-2::-2], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = crosstabs.transitions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "user", "kind", "ts")
    got = collections.Counter()
    add = lambda batch, epoch: got.update((r.previous, r.state) for r in batch.collect())
    stream.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert got == collections.Counter(zip(kinds, kinds[1:]))
