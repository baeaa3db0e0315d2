"""Recursive conditioning against elimination, within its bound of rows."""

import pytest

from marginalia import examples
from marginalia.catalog import Variable
from marginalia.operators import factors, inference
from marginalia.operators.conditioning import conditioned_marginal, conditioning
from marginalia.operators.factors import Model


def test_a_grid_within_a_bound_of_rows(spark):
    model = examples.rectangle(spark, 3, 3, 3)
    cond = {model.variables[0].name: (0, 2)}
    expected = inference.wmc(model, cond).first()["wmc"]
    whole, run = conditioning(model, cond=cond)
    assert whole.first()["w"] == pytest.approx(expected) and run.batches == 0
    wide = run.largest
    bound = wide // 4
    some, run = conditioning(model, cond=cond, most_rows=bound)
    assert some.first()["w"] == pytest.approx(expected)
    assert 0 < run.largest <= bound < wide and run.batches > 1


def test_marginals_under_conditions(spark):
    model = examples.loop(spark, 5, 3)
    names = [v.name for v in model.variables]
    keep, cond = [names[0], names[2]], {names[3]: (1, 2)}
    expected = {tuple(r[v] for v in keep): r.p for r in inference.marginal(model, keep, cond).collect()}
    found = {tuple(r[v] for v in keep): r.p for r in conditioned_marginal(model, keep, cond, most_rows=4).collect()}
    assert found == pytest.approx(expected) and len(found) == 9
    both = conditioned_marginal(model, keep, {names[0]: 1, **cond}, most_rows=2).collect()
    assert {r[names[0]] for r in both} == {1}


def test_parts_that_share_nothing_unused_variables_and_nothing_at_all(spark):
    a, b, c = (Variable(n, (0, 1, 2)) for n in "abc")
    model = Model((a, b, c), (factors.dense(spark, [a], [1, 2, 3]), factors.dense(spark, [b], [1, 0, 4])))
    assert conditioning(model, most_rows=1)[0].first()["w"] == pytest.approx(6 * 5 * 3)  # c is in no factor
    assert {(r.b, r.w) for r in conditioning(model, ["b"], most_rows=1)[0].collect()} == {(0, 18.0), (2, 72.0)}
    assert conditioning(model, cond={"b": 1})[0].first()["w"] == 0
    assert conditioning(model, ["a"], {"b": ()}, most_rows=2)[0].count() == 0
    one = Model((a,), (factors.dense(spark, [a], [1, 2, 3]),))
    assert conditioning(one, cond={"a": (0, 2)})[0].first()["w"] == 4
    with pytest.raises(ValueError, match="bound"):
        conditioning(model, most_rows=0)


def test_too_many_batches_are_an_error(spark):
    with pytest.raises(ValueError, match="over 2 batches"):
        conditioning(examples.rectangle(spark, 2, 2, 3), most_rows=1, most_batches=2)
