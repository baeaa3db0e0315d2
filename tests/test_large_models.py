"""Inference on networks of dozens of variables against an elimination in numpy."""

import numpy as np
import pytest

from marginalia import examples
from marginalia.operators import inference


def brute(model, wanted, evidence):
    """The marginal of one variable, by ``einsum`` over all factors at once."""
    names = [v.name for v in model.variables]
    operands = []
    for f in model.factors:
        dense = np.zeros([model.sizes[v] for v in f.scope])
        for r in f.table.select(*f.scope, "w").collect():
            dense[tuple(r)[:-1]] = r[-1]
        operands += [dense, [names.index(v) for v in f.scope]]
    for v, s in evidence.items():
        operands += [np.eye(model.sizes[v])[s], [names.index(v)]]
    sums = np.einsum(*operands, [names.index(wanted)], optimize="greedy")
    return sums / sums.sum()


def test_all_marginals_of_a_network_of_37_variables(spark):
    model = examples.random_network(spark)
    found = {(r.variable, r.state): r.p for r in inference.all_marginals(model, {"n20": 1}).collect()}
    assert {v for v, _ in found} == set(model.sizes)
    for v in ("n0", "n17", "n20", "n36"):
        expected = brute(model, v, {"n20": 1})
        for s in range(model.sizes[v]):
            assert found.get((v, s), 0.0) == pytest.approx(expected[s], abs=1e-9)
