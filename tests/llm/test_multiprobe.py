"""Probe sequences, recall on clustered and on uneven vectors, and the exact search of queries that find too few."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import neighbours


def index_of(x, n, k=5, functions=3, recall=0.95):
    return neighbours.fit(x, n, float(np.linalg.norm(x, axis=1).max()), k, 4, functions, 1.2, recall, seed=2)


def test_probes_come_in_falling_success_and_once():
    x = np.random.default_rng(1).standard_normal((2000, 8))
    index = index_of(x, 2000)
    asked = neighbours.unit_queries(x[:20])
    for t in index.tables:
        success = t.success(asked, index.similarity)
        for q in range(20):
            own = [s[q] for s in success]
            every = sorted((sum(s[c] for s, c in zip(own, at)) for at in itertools.product(*(range(len(s)) for s in own))), reverse=True)
            got = list(t.probes(own, 2.0))
            assert len(got) == len(set(got)) == len(every)
            assert np.allclose([sum(s[c] for s, c in zip(own, at)) for at in got], every)
            few = list(t.probes(own, 0.1))
            held = [np.prod([p[c] for p, c in zip(t.shares, at)]) for at in few]
            assert few == got[: len(few)] and sum(held[:-1]) < 0.1 <= sum(held)


def test_a_query_visits_few_buckets_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((50, 16))
    x = centres[rng.integers(0, 50, 4000)] + 0.1 * rng.standard_normal((4000, 16))
    index = index_of(x, 100_000, k=20, functions=5)
    probes = [len(k) for k in index.query_keys(x[:100])]
    assert index.fraction < 0.15 and np.mean(probes) < 0.25 * sum(np.prod([len(s) for s in t.shares]) for t in index.tables)


def recall(spark, x, k=10, **how):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=k, **how).collect()
    found = {}
    for r in rows:
        assert np.isclose(r.score, x[r.query_id] @ x[r.vec_id]) and r.query_id != r.vec_id
        found.setdefault(r.query_id, []).append((r["rank"], r.score))
    hits = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert [r for r, _ in sorted(found[q])] == list(range(1, k + 1))
        hits += sum(s >= np.sort(scores)[-k] - 1e-9 for _, s in found[q])
    return hits / (k * len(range(0, len(x), 20)))


def test_recall_of_uneven_vectors_with_a_hot_one(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 12)) * rng.uniform(0.2, 3, (3000, 1))
    x[500:1500] = x[7]
    assert recall(spark, x, bucket_rows=100, part_rows=200) >= 0.9


def test_queries_that_find_too_few_are_searched_exactly(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 12))
    real = neighbours.fit

    def narrow(*a, **k):
        index = real(*a, **k)
        index.fraction = 1e-9  # one bucket of each table
        return index

    monkeypatch.setattr(neighbours, "fit", narrow)
    assert recall(spark, x, k=50, bucket_rows=5, tables=1) == 1.0


def test_the_best_of_a_task_are_kept_in_a_bounded_buffer():
    import pyarrow as pa

    from marginalia.llm.vectors import Best

    rng = np.random.default_rng(8)
    names = ["uid", "query_id", "vec_id", "score"]
    for most in (50, 1 << 20):
        held, out, rows = Best(3, most), [], []
        for _ in range(40):
            q, v = rng.integers(0, 6, 20), rng.integers(0, 30, 20)
            score = ((q * 7 + v * 5) % 11).astype(float)
            rows += list(zip(q.tolist(), v.tolist(), score.tolist()))
            out += held.add(pa.RecordBatch.from_arrays([pa.array(x) for x in (q, q, v, score)], names=names))
        out += held.rest()
        got = [tuple(r.values())[1:] for b in out for r in b.to_pylist()]
        for q in range(6):
            want = sorted({(-s, v) for a, v, s in rows if a == q})[:3]
            assert sorted({(-s, v) for a, v, s in got if a == q})[:3] == want
        assert most == 50 or len(got) == 18
