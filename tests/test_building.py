import itertools
import math

import pytest
from pyspark.sql import functions as F

from marginalia import examples
from marginalia.catalog import Variable
from marginalia.operators import building, divergence, factors, inference, sampling
from marginalia.operators.factors import Factor, Model
from marginalia.operators.space import Space
from marginalia.plans import elimination
from marginalia.sources import net

X, Y = Variable("x", ("a", "b")), Variable("y", (0, 1, 2))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns_rows_and_data_sets(spark):
    data = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0)], "x int, y int, weight double")
    with pytest.raises(ValueError):
        building.new_columns(data, [X])
    z = Variable("z", (0, 1))
    assert building.ensure_columns(data, [X, z]).columns == ["x", "y", "weight", "z"]
    assert building.delete_columns(data, [Y]).columns == ["x", "weight"]
    with pytest.raises(ValueError):
        building.delete_columns(data, [z])
    assert rows(building.append(data, [(1, None)], [X, Y])) == rows(data.unionByName(spark.createDataFrame([(1, None, 1.0)], data.schema)))
    with pytest.raises(ValueError):
        building.append(data, [(2, 0)], [X, Y])
    numbered = data.withColumn("k", F.col("x").cast("long"))
    got = building.insert(numbered, "k", 1, [(0, 0)], [X, Y]).orderBy("k").select("k", "x", "y").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1), (1, 0, 0), (2, 1, 2)]
    other = spark.createDataFrame([(9, 1)], "extra int, x int")
    assert rows(building.append_dataset(data, other, [X, Y])) == [(0, 1, 1.0), (1, 2, 2.0), (1, None, 1.0)]
    soft = spark.createDataFrame([([0.5, 0.5], 1.0)], "x array<double>, weight double")
    assert rows(building.append_dataset(soft, other, [X])) == [([0.0, 1.0], 1.0), ([0.5, 0.5], 1.0)]
    assert [r.line for r in building.dump(data.orderBy("x"), [X, Y]).collect()] == ["a, 1, x 1.0", "b, 2, x 2.0"]


def test_checked_columns(spark):
    data = spark.createDataFrame([(0, "b", [0.1, 0.9]), (5, "?", [1.0])], "i int, s string, v array<double>")
    fine = spark.createDataFrame([(0, "b", [0.1, 0.9])], data.schema)
    assert building.with_indexes(fine, X, F.col("i")).first().x == 0
    assert building.with_labels(fine, X, F.col("s")).first().x == 1
    assert building.with_weights(fine, X, F.col("v")).first().x == [0.1, 0.9]
    for build, column in ((building.with_indexes, "i"), (building.with_labels, "s"), (building.with_weights, "v")):
        with pytest.raises(Exception):
            build(data, X, F.col(column)).collect()
    with pytest.raises(ValueError):
        Variable("odd", (0, "0")).of_labels(F.col("i"))


def test_max_sum_keeps_its_one_and_free_variables(spark):
    a, b, free = Variable("a", (0, 1)), Variable("b", (0, 1)), Variable("f", (0, 1))
    model = Model((a, b, free), (factors.dense(spark, [a], [0, -5]), factors.dense(spark, [a, b], [-1, -2, -3, -4])))
    assert inference.wmc(model, ring=inference.SEMIRINGS["max_sum"]).first().wmc == -1
    assert inference.wmc(model).first().wmc == 2 * (-5 * -7)


def test_kl_meets_the_whole_state_space(spark):
    p = Space(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "x int, y int, weight double"))
    assert math.isnan(divergence.kl(p, p, ["x", "y"]).first().kl)
    assert divergence.kl(p, p, ["x"]).first().kl == 0


def test_posteriors_of_repeated_and_impossible_evidence(spark):
    model = examples.network(spark, "rain")
    evidence = spark.createDataFrame([(0,), (0,), (None,)], "`Slippery Road` int")
    got = inference.batch_evidence(model, evidence, ["Slippery Road"], target="Rain").groupBy("Slippery Road", "Rain").agg(F.round(F.sum("p"), 9).alias("p"), F.count("*").alias("n"))
    by = {(r[0], r[1]): (r.p, r.n) for r in got.collect()}
    assert by[0, 0] == (2.0, 2)
    assert sum(p for (e, _), (p, _) in by.items() if e is None) == pytest.approx(1)


def test_samplers_give_as_many_as_asked_and_nothing_for_an_impossible_condition(spark):
    model = examples.network(spark, "rain")
    cond = {"Rain": 1}
    for sample in (sampling.forward(model, 300, cond=cond), sampling.rejection(model, 300, cond), sampling.direct(model, 300, cond=cond)):
        got = sample.collect()
        assert len(got) == 300 and {r.Rain for r in got} == {1} and len({r.row for r in got}) == 300
    never = {"Rain": 1, "Slippery Road": 0}  # it is only slippery when it rains
    for sample in (sampling.forward(model, 5, cond=never), sampling.rejection(model, 5, never), sampling.direct(model, 5, cond=never), sampling.markov_chains(model, 2, 3, cond=never)):
        assert sample.count() == 0


def test_direct_samples_of_a_large_network(spark):
    model = examples.random_network(spark, 20)
    got = sampling.direct(model, 200, cond={"n19": 0})
    assert got.count() == 200 and got.select("n19").distinct().count() == 1


def test_prefixes_planners_and_trees():
    scopes = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    assert elimination.twig_prefix(scopes) == ["e", "d"]
    assert set(elimination.optimal_prefix(scopes)) == set("abcde")
    grid = [(f"x{r}{c}", f"x{r + i}{c + j}") for r, c in itertools.product(range(3), range(3)) for i, j in ((0, 1), (1, 0)) if r + i < 3 and c + j < 3]
    sizes = {v: 2 for s in grid for v in s}
    for planner in ("best", *elimination.PLANNERS):
        for prefix in (None, "twig", "optimal"):
            assert sorted(elimination.planned(grid, sizes, planner, prefix)) == sorted(sizes)
    clusters, parents = elimination.maximal_tree(grid, sizes)
    assert all(any(set(s) <= c for c in clusters) for s in grid)
    assert not any(a < b for a in clusters for b in clusters)
    for v in sizes:  # the clusters with a variable are connected
        mine = [k for k, c in enumerate(clusters) if v in c]
        assert sum(parents[k] not in mine for k in mine) == 1


@pytest.mark.parametrize("name", sorted(examples.GRAPHS))
def test_graphs_agree_with_enumeration(spark, name):
    model = examples.graph(spark, name)
    assert inference.wmc(model).first().wmc == pytest.approx(inference.wmc_by_enumeration(model).first().wmc)


def test_net_files_with_percent_signs_and_too_few_values(spark, tmp_path):
    v = Variable("v", ("100 % {x}", "b"))
    model = Model((v,), (factors.dense(spark, [v], [0.25, 0.75]),))
    net.write_net(spark, model, str(tmp_path / "good"))
    again = net.read_net(spark, str(tmp_path / "good"))
    assert again.variables[0].states == v.states
    assert rows(again.factors[0].table.select("v", "w")) == [(0, 0.25), (1, 0.75)]
    (tmp_path / "few.net").write_text('node v { states = ("a" "b"); }\npotential (v) { data = (0.5); } % comment\n')
    with pytest.raises(ValueError):
        net.read_net(spark, str(tmp_path / "few.net"))


def test_labels_of_missing_cells_are_missing(spark):
    from pyspark.sql import functions as F

    from marginalia.catalog import Variable
    from marginalia.operators.building import dump

    v = Variable("v", ("a", "b"))
    rows = spark.range(6).select(F.when(F.col("id") % 3 != 2, F.col("id") % 3).cast("int").alias("v"), F.lit(1.0).alias("weight"))
    assert sorted(r.line for r in dump(rows, [v]).collect()) == ["?, x 1.0"] * 2 + ["a, x 1.0"] * 2 + ["b, x 1.0"] * 2
