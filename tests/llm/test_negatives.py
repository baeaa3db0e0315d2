"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import negatives

NAN, INF = float("nan"), float("inf")


def brute(rows, is_anchor, positives=5, k=10, low=30, high=90, of=100, scale=256):
    usable = {(i, l, tuple(np.floor(np.array(v, dtype=float) * scale).astype(int))) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    found = []
    for i, l, v in usable:
        if not is_anchor(i):
            continue
        scored = [(-int(np.dot(v, w)), j, m) for j, m, w in usable]
        best = sorted((s, j) for s, j, m in scored if m == l and j != i)[:positives]
        for s, j in best:
            other = sorted((t, o) for t, o, m in scored if m != l and low * -s <= of * -t <= high * -s)[:k]
            found += [(i, j, r + 1, o, -s, -t) for r, (t, o) in enumerate(other)]
    return sorted(found)


def got(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("kind", ["uneven norms", "copies", "integers"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 6)) * (rng.pareto(1.5, (400, 1)) + 0.1)
    if kind == "copies":
        x[100:300] = x[7]  # a hot vector, in several labels
    if kind == "integers":
        x = rng.integers(-2, 3, (400, 6)).astype(float)  # many ties, zero vectors
    labels = np.where(np.arange(400) < 250, 1, rng.integers(0, 4, 400))  # a hot label
    rows = [(i, [float(a) for a in v], int(l)) for i, (v, l) in enumerate(zip(x, labels))]
    rows += [(400, None, 1), (401, [1.0, NAN] + [0.0] * 4, 1), (402, [INF] + [0.0] * 5, 2), (403, [None] + [1.0] * 5, 2), (404, [1.0] * 6, None), (None, [1.0] * 6, 1), (405, [], 1)]
    rows += [rows[3], rows[3]]  # repeated rows
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("shard", F.lit("clash")).withColumn("windows", F.lit(1))
    expected = brute(rows, lambda i: i % 5 == 0)
    assert expected and got(negatives.mine(frame, F.col("vec_id") % 5 == 0, bucket=16, batch=7)) == expected
    assert got(negatives.mine(frame, F.col("vec_id") % 5 == 0, bucket=64, shard_rows=30)) == expected


def test_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0], 1)], schema)
    assert negatives.mine(one, F.col("vec_id") % 5 == 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2)], schema)
    assert got(negatives.mine(three, F.col("vec_id") % 5 == 0)) == [(0, 1, 1, 2, 65536, 32768)]


def test_bounds_prune():
    rng = np.random.default_rng(9)
    x = np.floor(rng.standard_normal((4000, 8)) * 256)
    x *= np.repeat([10, 1, 0.1, 0.01], 1000)[:, None]
    x = np.floor(x)
    shard = negatives.Shard(np.arange(4000), np.zeros(4000, dtype=np.int64), x, 100)
    scored = []
    whole, shard.x = shard.x, None

    class Watched:
        dtype = whole.dtype

        def __getitem__(self, at):
            scored.append(at)
            return whole[at]

    shard.x = Watched()
    q = whole[:1] * 0 + 256.0
    found = list(shard.search(np.array([-1]), np.array([1]), q, [np.array([(100_000, 1 << 40)])], False, 10))
    products = whole.astype(np.int64) @ q[0].astype(np.int64)
    best = sorted(((-s, i) for i, s in zip(shard.ids, products) if s >= 100_000))[:10]
    assert [(-s, i) for s, i in best] == [(int(s), int(shard.ids[a])) for _, _, at, got in found for a, s in zip(at, got)]
    assert len(scored) < 20  # of 40 buckets
