"""Coalescing of cross-tables that fit and of those that do not, against numpy."""

import itertools

import numpy as np
import pytest

from marginalia.catalog import Variable
from marginalia.operators import learning

A, B, C = (Variable(n, tuple(range(k))) for n, k in zip("abc", (2, 3, 2)))


def tables_of(spark, consistent, seed=1):
    rng = np.random.default_rng(seed)
    joint = rng.random((2, 3, 2)) + 0.2
    other = joint if consistent else joint * rng.uniform(0.8, 1.25, joint.shape)
    ab, bc = joint.sum(axis=2), other.sum(axis=0)
    frames = [spark.createDataFrame([(i, j, float(t[i, j])) for i in range(t.shape[0]) for j in range(t.shape[1])], f"{x} int, {y} int, weight double") for t, (x, y) in ((ab, "ab"), (bc, "bc"))]
    return frames, ab / ab.sum(), bc / bc.sum()


def system(ab, bc):
    columns = list(itertools.product(range(2), range(3), range(2)))
    m = np.zeros((12, 12))
    for k, (i, j, l) in enumerate(columns):
        m[i * 3 + j, k] = m[6 + j * 2 + l, k] = 1
    return m, np.concatenate([ab.ravel(), bc.ravel()]), columns


@pytest.mark.parametrize("consistent", [True, False])
def test_least_squares_is_the_smallest_best_one(spark, consistent):
    frames, ab, bc = tables_of(spark, consistent)
    m, b, columns = system(ab, bc)
    expected = np.linalg.lstsq(m, b, rcond=None)[0]
    got = {(r.a, r.b, r.c): r.weight for r in learning.least_squares_tables(frames, [A, B, C], shift=False).collect()}
    assert [got[c] for c in columns] == pytest.approx(expected.tolist(), abs=1e-7)
    raised = {(r.a, r.b, r.c): r.weight for r in learning.least_squares_tables(frames, [A, B, C]).collect()}
    assert [raised[c] for c in columns] == pytest.approx((expected - min(0.0, expected.min())).tolist(), abs=1e-7)


def test_residuals_of_tables_that_do_not_fit(spark):
    frames, ab, bc = tables_of(spark, False)
    m, b, columns = system(ab, bc)
    variables = [A, B, C]
    squares = learning.least_squares_tables(frames, variables)
    updates = learning.coalesce_tables(frames, variables, rounds=25)
    mean = learning.split_and_mean_tables(frames, variables, rounds=25)
    both = learning.split_and_mean_tables(frames, variables, start=squares, rounds=10)
    assert min(r.weight for r in mean.collect()) >= 0
    best = float(((m @ np.linalg.lstsq(m, b, rcond=None)[0] - b) ** 2).sum())
    left = {k: learning.misfit(t, frames, variables).first().squared for k, t in (("squares", squares), ("updates", updates), ("mean", mean), ("both", both))}
    assert left["squares"] == pytest.approx(best, rel=0.05)
    assert left["squares"] <= 1.05 * left["updates"] and left["mean"] <= 1.2 * left["updates"] and left["both"] <= 1.2 * left["updates"]


def test_tables_that_fit_leave_nothing(spark):
    frames, *_ = tables_of(spark, True)
    mean = learning.split_and_mean_tables(frames, [A, B, C], tolerance=1e-6)
    assert learning.misfit(mean, frames, [A, B, C]).first().absolute < 2e-6
