import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia import examples
from marginalia.catalog import Variable
from marginalia.operators import evidence, inference, shuffles
from marginalia.operators.sampling import random_draw
from marginalia.operators.space import ProbabilitySpace, SampleSpace, Space
from marginalia.plans import elimination

X, Y = Variable("x", (0, 1)), Variable("y", (0, 1, 2))


def one(df):
    return df.first()[0]


def test_samples_count_alike(spark):
    samples = spark.createDataFrame([(0, 0, "k"), (0, 0, "l"), (1, 2, "m"), (0, 1, "n"), (1, 2, None)], "x int, y int, weight string")
    space = SampleSpace(samples, [X, "y"])
    assert one(space.wmc()) == 5.0 and one(space.wmc({"x": 0, "y": (0, 2)})) == 2.0
    assert one(space.probability({"x": 1}, {"y": (1, 2)})) == pytest.approx(2 / 3)
    assert tuple(space.most_likely(["x", "y"]).first()) == (0, 0, 0.4)
    p = [0.4, 0.4, 0.2]
    assert one(space.entropy(["x", "y"])) == pytest.approx(-sum(q * math.log2(q) for q in p))
    nothing = SampleSpace(samples.limit(0), [X, Y])
    assert one(nothing.wmc()) == 0.0 and math.isnan(one(nothing.probability({"x": 0})))


def test_a_model_is_a_space(spark):
    model = examples.network(spark, "student")
    space, table = inference.ModelSpace(model, ["grade", "sat"]), inference.space(model, ["grade", "sat"])
    assert one(space.wmc()) == pytest.approx(1)
    assert one(space.correlation(("grade", 0), ("sat", 0))) == pytest.approx(one(table.correlation(("grade", 0), ("sat", 0))))
    assert one(space.probability({"grade": 0}, {"letter": 1})) == pytest.approx(one(inference.probability(model, {"grade": 0}, {"letter": 1})))


def test_a_space_of_ones_own_needs_its_rows_alone(spark):
    class Even(ProbabilitySpace):
        def given(self, cond=None):
            return Space(spark.range(6).select((F.col("id") % 2).alias("x"), (F.col("id") % 3).alias("y"), F.lit(1.0).alias("weight"))).given(cond)

    m = Even().measures("x", "y").first()
    assert m["mutual_information"] == pytest.approx(0, abs=1e-12) and m["joint_entropy"] == pytest.approx(math.log2(6))
    with pytest.raises(TypeError):
        ProbabilitySpace()


def test_planners_of_ones_own(spark):
    model = examples.network(spark, "asia")
    backwards = lambda scopes, sizes, keep=(): sorted({v for s in scopes for v in s} - set(keep), reverse=True)
    want = one(inference.wmc(model, {"xray": 0}))
    assert one(inference.wmc(model, {"xray": 0}, order=backwards)) == pytest.approx(want)
    scopes = [f.scope for f in model.factors]
    order = elimination.planned(scopes, model.sizes, backwards, "optimal", keep=["lung"])
    assert sorted(order) == sorted({v.name for v in model.variables} - {"lung"})
    for wrong in (lambda *_: ["asia"], lambda s, z, k: backwards(s, z, k) + ["asia"]):
        with pytest.raises(ValueError):
            elimination.planned(scopes, model.sizes, wrong)


def test_hard_and_soft_columns_side_by_side(spark):
    data = spark.createDataFrame([([0.25, 0.75], 2, 2.0), ([1.0, 0.0], 0, 1.0)], "x array<double>, y int, n double")
    got = {tuple(r) for r in evidence.cross_table_of(data, [X, Y], "n").collect()}
    assert got == {(0, 2, 0.5), (1, 2, 1.5), (0, 0, 1.0)}
    hard = data.withColumn("x", F.lit(1))
    assert {tuple(r) for r in evidence.cross_table_of(hard, [X, Y]).collect()} == {(1, 2, 1.0), (1, 0, 1.0)}
    assert sum(r["weight"] for r in evidence.cross_table_of(data.limit(0), [X, Y], prior=2.0).collect()) == 12.0


def test_permutations(spark):
    rows = spark.range(1000).repartition(7)
    one_, two = (dict(shuffles.permuted(rows, ["id"], seed=s).collect()) for s in (1, 2))
    assert sorted(one_.values()) == sorted(two.values()) == list(range(1000)) and one_ != two
    assert one_ == dict(shuffles.permuted(rows.coalesce(1), ["id"], seed=1).collect())
    assert sum(one_[k] < one_[k + 1] for k in range(999)) in range(430, 570)
    equal = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert sorted(r["place"] for r in shuffles.permuted(equal, ["k"]).collect()) == [0, 1, 2]
    assert shuffles.permuted(equal.limit(0), ["k"]).count() == 0


def test_distinct_pairs(spark):
    rows = spark.range(6000).withColumnRenamed("id", "row").withColumn("n", F.lit(3))
    a, b = shuffles.distinct_pair(F.col("n"), random_draw(5))
    counts = Counter(map(tuple, rows.select(a, b).collect()))
    assert set(counts) == {(i, j) for i in range(3) for j in range(3) if i != j} and min(counts.values()) > 850
    assert tuple(rows.select(*shuffles.distinct_pair(1, random_draw(5))).first()) == (None, None)
