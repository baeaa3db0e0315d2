"""Derivatives, the most probable instance and exact samples on messages that are written."""

import itertools

import numpy as np
import pytest
from marginalia import examples
from marginalia.catalog import Variable
from marginalia.operators import factors, inference, sampling
from marginalia.operators.factors import Factor, Model


def model_of(spark, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c, d, e = (Variable(n, tuple(range(k))) for n, k in zip("abcde", (2, 3, 2, 2, 2)))
    make = lambda *vs: factors.dense(spark, vs, rng.integers(0, 4, int(np.prod([len(v) for v in vs]))).astype(float).tolist())
    return Model((a, b, c, d, e), (make(a, b), make(b, c), make(c, a), make(c, d), make(b)))  # e is in no factor


def dense(model):
    found = []
    for f in model.factors:
        t = np.zeros([len(v) for v in f.variables])
        for r in f.table.collect():
            t[tuple(r[v] for v in f.scope)] = r.w
        found.append(t)
    return found


def brute(model, cond):
    """Both kinds of derivatives by enumeration, leaving one thing out at a time."""
    tables, names = dense(model), [v.name for v in model.variables]
    by_parameter, by_indicator = {}, {}
    for x in itertools.product(*(range(len(v)) for v in model.variables)):
        at = dict(zip(names, x))
        ok = {v: at[v] in states for v, states in cond.items()}
        values = [t[tuple(at[v] for v in f.scope)] for f, t in zip(model.factors, tables)]
        for k, f in enumerate(model.factors):
            key = (k, tuple(at[v] for v in f.scope))
            rest = np.prod([v for j, v in enumerate(values) if j != k]) * all(ok.values())
            by_parameter[key] = by_parameter.get(key, 0) + rest
        for v in names:
            key = (v, at[v])
            by_indicator[key] = by_indicator.get(key, 0) + np.prod(values) * all(o for w, o in ok.items() if w != v)
    return by_parameter, by_indicator


@pytest.mark.parametrize("cond", [{"b": (0, 2), "e": (0,)}, {"d": ()}])
def test_derivatives_against_enumeration(spark, cond):
    model = model_of(spark)
    parameters, indicators = inference.derivatives(model, cond)
    expected = brute(model, cond)
    assert {(r.factor, tuple(r.states)): r.d for r in parameters.collect()} == pytest.approx(expected[0])
    assert {(r.variable, r.state): r.d for r in indicators.collect()} == pytest.approx(expected[1])
    one = inference.gradient(model, 0, cond)
    assert {(0, (r.a, r.b)): r.d for r in one.collect()} == pytest.approx({k: v for k, v in expected[0].items() if k[0] == 0})


def joins(frame):
    return frame._jdf.queryExecution().analyzed().toString().count("Join")


def test_plans_are_linear_in_the_model(spark):
    model = examples.random_network(spark)
    n = len(model.variables)
    cond = {"n20": (1,)}
    parameters, indicators = inference.derivatives(model, cond)
    best, drawn = inference.mpe(model, cond), sampling.direct(model, 200, cond=cond)
    assert max(map(joins, (parameters, indicators, best, drawn))) < 12 * n
    held = [{tuple(r[v] for v in f.scope): r.w for r in f.table.collect()} for f in model.factors]

    def weight_of(row):
        return float(np.prod([t[tuple(row[v] for v in f.scope)] for f, t in zip(model.factors, held)]))

    # Euler: the parameters of a factor times their derivatives sum to the weight
    sums = {}
    for r in parameters.collect():
        sums[r.factor] = sums.get(r.factor, 0.0) + r.d * held[r.factor].get(tuple(r.states), 0.0)
    assert len(sums) == n and max(sums.values()) == pytest.approx(min(sums.values()))
    (x,) = best.collect()
    rows = drawn.collect()
    assert x.n20 == 1 and weight_of(x) == pytest.approx(x.w)
    assert len(rows) == 200 and {r.n20 for r in rows} == {1} and x.w >= max(map(weight_of, rows))
