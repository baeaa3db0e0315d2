"""Chains that copy states, in segments, against plain steps with the same numbers."""

import numpy as np
import pytest

from marginalia.catalog import Variable
from marginalia.functions.scalar import uniform_of
from marginalia.operators import factors, sampling
from marginalia.operators.factors import Model
from pyspark.sql import functions as F


def fixed(k):
    return uniform_of(F.col("row"), step=12345 + 777 * k)


def u_of(row, k):
    return ((row * 1103515245 + 12345 + 777 * k) % 2147483648) / 2147483648


def model_of(spark):
    rng = np.random.default_rng(2)
    x, y, z = (Variable(n, tuple(range(k))) for n, k in zip("xyz", (3, 3, 2)))
    make = lambda *vs: factors.dense(spark, vs, (rng.random(int(np.prod([len(v) for v in vs]))) + 0.1).tolist())
    return Model((x, y, z), (make(x, y), make(y, z), make(z, x)))


def test_segments_follow_the_plain_chain(spark):
    model = model_of(spark)
    joint = np.ones((3, 3, 2))
    for f in model.factors:
        for r in f.table.collect():
            at = [slice(None)] * 3
            for v in f.scope:
                at["xyz".index(v)] = r[v]
            joint[tuple(at)] *= r.w
    joint[:, :, :] *= np.array([1, 1])[None, None, :]
    length = 40
    whole = {(r.chain, r.step): (r.x, r.y, r.z) for r in sampling.chained(model, {"x": "y"}, 3, length, {"x": 0}, draw=fixed, segment=7).collect()}
    assert whole == {(r.chain, r.step): (r.x, r.y, r.z) for r in sampling.chained(model, {"x": "y"}, 3, length, {"x": 0}, draw=fixed, segment=1000).collect()}
    assert len(whole) == 3 * length
    pair = joint.sum(axis=2)  # x, y
    for c in range(3):
        assert whole[c, 0][0] == 0
        for t in range(1, length):
            before, (x, y, z) = whole[c, t - 1][0], whole[c, t]
            assert y == before
            w = pair[:, y] / pair[:, y].sum()
            row = c * length + t
            assert x == int(np.searchsorted(np.cumsum(w), u_of(row, -1), side="right"))
            v = joint[x, y] / joint[x, y].sum()
            assert z == int(np.searchsorted(np.cumsum(v), u_of(row, 2), side="right"))


def test_chains_end_where_nothing_goes_on(spark):
    x, prev = Variable("x", (0, 1, 2)), Variable("prev", (0, 1, 2))
    up = factors.sparse(spark, [x, prev], {(1, 0): 1.0, (2, 1): 1.0})
    got = {(r.chain, r.step): (r.x, r.prev) for r in sampling.chained(Model((x, prev), (up,)), {"x": "prev"}, 2, 9, {"prev": 0}, segment=2).collect()}
    assert got == {(c, s): v for c in (0, 1) for s, v in enumerate([(1, 0), (2, 1)])}
    assert sampling.chained(Model((x, prev), (up,)), {"x": "prev"}, 2, 9, {"x": 0}).count() == 0
    assert sampling.chained(Model((x, prev), (up,)), {"x": "prev"}, 2, 1).count() == 2
    with pytest.raises(ValueError, match="over 1 rows"):
        sampling.chained(Model((x, prev), (up,)), {"x": "prev"}, 2, 9, most_cells=1)
    with pytest.raises(ValueError, match="inconsistent"):
        sampling.chained(Model((x, prev), (up,)), {"x": "other"}, 2, 9)


def test_several_pairs_shift(spark):
    names = [Variable(n, (0, 1)) for n in ("a", "b", "c")]
    free = factors.dense(spark, names[:1], [0.5, 0.5])
    rows = sorted((r.chain, r.step, r.a, r.b, r.c) for r in sampling.chained(Model(tuple(names), (free,)), {"a": "b", "b": "c"}, 2, 30, segment=4).collect())
    assert len(rows) == 60 and len({r[2] for r in rows}) == 2
    for p, q in zip(rows, rows[1:]):
        if p[0] == q[0]:
            assert q[3] == p[2] and q[4] == p[3]
