"""Product trees, maximal clusters, posteriors of all states, dense indexes over many tasks, and bounded rounds."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.catalog import Variable, state_index
from marginalia.operators import divergence, factors, inference, sampling
from marginalia.operators.factors import Model
from marginalia.operators.space import Space
from marginalia.plans.products import best_tree

SIZES = {"v": 2, **{x: 10 for x in "abcd"}}
#: Smallest first joins (v, a) and (v, b) to 200 rows, then with (a, c), and holds all of a, b, c at once.
STAR = [("v", "a"), ("v", "b"), ("a", "c", "d"), ("c", "d"), ("b",)]


def smallest_first(scopes, sizes):
    log = lambda s: sum(math.log2(sizes[v]) for v in s)
    order, seen, worst = sorted(scopes, key=log), set(), 0.0
    for s in order:
        seen |= set(s)
        worst = max(worst, log(seen))
    return worst


def test_trees_sum_out_early():
    tree, worst = best_tree(STAR, SIZES)
    assert worst <= math.log2(1000) + 1e-9 < smallest_first(STAR, SIZES)
    every = sorted(x for x in itertools.chain.from_iterable(str(tree).split()) if x.isdigit())
    assert every == [str(k) for k in range(5)]
    many = [(f"x{k}", f"x{k + 1}") for k in range(30)]
    tree, worst = best_tree(many, {f"x{k}": 4 for k in range(31)}, most=6)
    assert worst == 6.0  # three variables of four states


def test_trees_give_the_same_results(spark):
    rng = np.random.default_rng(3)
    variables = {v: Variable(v, tuple(range(2 if v == "v" else 3))) for v in SIZES}
    made = [factors.dense(spark, [variables[v] for v in s], rng.random(int(np.prod([len(variables[v]) for v in s]))).tolist()) for s in STAR]
    model = Model(tuple(variables.values()), tuple(made))
    one, two = ({(r.a, r.b): r.p for r in inference.marginal(model, ["a", "b"], {"c": (0, 2)}, trees=t).collect()} for t in (False, True))
    assert one == pytest.approx(two) and len(one) == 9
    x, y = ({(r.variable, r.state): r.p for r in inference.all_marginals(model, {"c": 1}, maximal=m).collect()} for m in (False, True))
    assert x == pytest.approx(y) and len(x) == 12


def test_posteriors_have_all_states(spark):
    a, b, c = (Variable(n, (0, 1)) for n in "abc")
    model = Model((a, b, c), (factors.sparse(spark, [a, b], {(0, 0): 1.0, (1, 1): 3.0}), factors.sparse(spark, [c], {(0,): 1.0})))
    evidence = spark.createDataFrame([(0, None, 1), (1, 0, 2), (None, None, 3), (0, 1, 4)], "a int, c int, k int")
    got = {(r.k, r.b): r.p for r in inference.batch_evidence(model, evidence, ["a", "c"], target="b").collect()}
    nan = got.pop((4, None))
    assert math.isnan(nan) and got == {(1, 0): 1.0, (1, 1): 0.0, (2, 0): 0.0, (2, 1): 1.0, (3, 0): 0.25, (3, 1): 0.75}
    assert {r.k: r.wmc for r in inference.batch_evidence(model, evidence, ["a", "c"]).collect()} == {1: 1.0, 2: 3.0, 3: 4.0, 4: 0.0}
    plan = inference.batch_evidence(model, evidence, ["a", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1


def test_indexes_are_dense_over_many_tasks(spark):
    values = [f"v{k:04d}" for k in range(500)]
    rows = spark.createDataFrame([(v,) for v in values * 2 + [None]], "x string").repartition(7)
    got = {(r.x, r.i) for r in state_index(rows, "x", "i").collect()}
    assert got == {(v, k) for k, v in enumerate(values)} | {(None, None)}


def test_kl_counts_instances_that_neither_has(spark):
    p = Space(spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 4.0)], "x int, y int, weight double"))
    q = Space(spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)], "x int, y int, weight double"))
    assert divergence.kl(p, q, ["x", "y"]).first().kl == pytest.approx(sum(w * math.log2(w * 4) for w in (0.125, 0.125, 0.25, 0.5)))
    few = Space(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 1.0)], "x int, y int, weight double"))
    assert math.isnan(divergence.kl(few, few, ["x", "y"]).first().kl)


def test_proposals_that_are_never_accepted_end(spark):
    with pytest.raises(RuntimeError, match="0 of 5 rows"):
        sampling.until(5, lambda start, size: spark.range(start, start + 1).select(F.col("id").alias("row")).limit(0), most_rounds=3)
