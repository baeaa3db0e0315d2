"""Alias tables, and samplers as batches and streams."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.folders import shared_folder, written
from marginalia.functions.scalar import uniform_of
from marginalia.operators import alias, factors, samplers, sampling
from marginalia.operators.factors import Model


def fixed(k):
    return uniform_of(F.col("row"), step=12345 + 777 * k)


def table_of(spark, weights):
    return spark.createDataFrame([(i // 7, i % 7, w) for i, w in enumerate(weights)], "a int, b int, weight double")


def law(spark, weights):
    instances = written(alias.numbered(table_of(spark, weights)), "instances")
    slots = written(alias.slots(alias.weight_groups(instances)), "slots")
    return {r.a * 7 + r.b: r.p for r in alias.law(slots, instances).collect()}, slots.collect()


@pytest.mark.parametrize(
    "weights",
    [
        [1.0],
        [0.1, 0.1, 0.1],
        [5.0] + [1.0] * 40,
        [1e-9, 1.0, 1e9],
        [0.0, 3.0, 0.0, 1.0, -2.0],
        [2.0, 2.0, 4.0, 8.0, 8.0, 16.0, 1.0],  # masses at the mean
        [float(k) for k in range(1, 200)],
        [random.Random(3).paretovariate(0.5) for _ in range(300)],
    ],
)
def test_slots_keep_the_law(spark, weights):
    found, slots = law(spark, weights)
    total = sum(w for w in weights if w > 0)
    assert found == pytest.approx({i: w / total for i, w in enumerate(weights) if w > 0}, rel=1e-9, abs=1e-15)
    assert sorted(r.slot for r in slots) == list(range(len({w for w in weights if w > 0})))
    assert all(0 <= r.keep <= 1 and (r.other_n is not None or r.keep == 1) for r in slots)


def test_tables_without_weight_and_weights_that_are_none(spark):
    for weights in ([], [0.0, 0.0]):
        assert law(spark, weights) == ({}, [])
        assert samplers.batch(samplers.weighted(table_of(spark, weights)), spark, 50).count() == 0
    with pytest.raises(ValueError, match="finite"):
        law(spark, [1.0, float("inf")])


def test_draws_follow_a_table_with_a_heavy_first_column(spark):
    weights = [float(1 + k % 5) for k in range(70)]
    table = table_of(spark, weights)
    n = 200_000
    sampler = samplers.weighted(table, seed=5)
    got = {r.a * 7 + r.b: r["count"] for r in samplers.batch(sampler, spark, n).groupBy("a", "b").count().collect()}
    assert sum(got.values()) == n
    total = sum(weights)
    square = sum((got.get(i, 0) - n * w / total) ** 2 / (n * w / total) for i, w in enumerate(weights))
    assert square < 69 + 5 * math.sqrt(2 * 69)
    again = samplers.batch(sampler, spark, 100, start=100).orderBy("row").collect()
    assert again == samplers.batch(samplers.weighted(table, seed=5), spark, 200).where("row >= 100").orderBy("row").collect()


def network(spark):
    x, y = Variable("x", (0, 1, 2)), Variable("y", (0, 1))
    return Model((x, y), (factors.dense(spark, [x], [0.2, 0.3, 0.5]), factors.cpt(factors.dense(spark, [y, x], [1, 2, 3, 4, 5, 6]))))


def all_samplers(spark):
    model = network(spark)
    table = table_of(spark, [1.0, 2.0, 3.0, 2.0])
    return {
        "forward": (samplers.forward(model, draw=fixed), lambda n: sampling.forward(model, n, draw=fixed)),
        "direct": (samplers.direct(model, cond={"y": 1}, draw=fixed), lambda n: sampling.direct(model, n, cond={"y": 1}, draw=fixed)),
        "uniform": (samplers.uniform(model.variables, {"x": (0, 2)}, fixed), lambda n: sampling.uniform(spark, model.variables, n, {"x": (0, 2)}, fixed)),
        "weighted": (samplers.weighted(table, fixed), lambda n: samplers.batch(samplers.weighted(table, fixed), spark, n)),
    }


def test_streams_go_on_where_they_ended_and_equal_the_functions(spark):
    for name, (sampler, function) in all_samplers(spark).items():
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        seen = []
        for _ in range(2):
            rows = samplers.stream(sampler, spark, 60)
            rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
            seen.append(spark.read.parquet(path).count())
        assert seen == [60, 120], name
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, function(120).collect())), name


def test_conditions(spark):
    model = network(spark)
    kept = samplers.batch(samplers.forward(model, {"y": 0}, fixed), spark, 500)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, sampling.forward(model, 500, draw=fixed).where("y = 0").collect()))
    assert samplers.batch(samplers.direct(model, cond={"x": ()}), spark, 20).count() == 0
