"""Probability operators against known values and brute force."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from marginalia import examples
from marginalia.catalog import Variable, condition, state_space, variables_of
from marginalia.operators import crosstab as ct
from marginalia.operators import divergence, evidence, factors, inference, learning, sampling
from marginalia.operators.factors import Factor, Model
from marginalia.operators.space import Space
from marginalia.plans import elimination
from marginalia.sources import circuits, net, store, text

X, Y, Z = Variable("x", ("n", "y")), Variable("y", (0, 1, 2)), Variable("z", (True, False))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def student(spark) -> Model:
    d, i = Variable("difficult", ("Yes", "No")), Variable("intelligent", ("Yes", "No"))
    g, s, letter = Variable("grade", ("1", "2", "3")), Variable("sat", ("High", "Low")), Variable("letter", ("Yes", "No"))

    def cpt(child, parents, *cpds):  # one list per parent instance, the last parent fastest
        rows = {}
        for given, cpd in zip(itertools.product(*(range(len(p)) for p in parents)), cpds):
            rows |= {(k, *given): w for k, w in enumerate(cpd)}
        return factors.sparse(spark, [child, *parents], rows)

    return Model(
        (d, i, g, s, letter),
        (
            cpt(d, [], (0.6, 0.4)),
            cpt(i, [], (0.7, 0.3)),
            cpt(g, [d, i], (0.3, 0.4, 0.3), (0.05, 0.25, 0.7), (0.9, 0.08, 0.02), (0.5, 0.3, 0.2)),
            cpt(s, [i], (0.95, 0.05), (0.2, 0.8)),
            cpt(letter, [g], (0.1, 0.9), (0.4, 0.6), (0.99, 0.01)),
        ),
    )


def mixed(spark) -> Model:
    """Dense, clause, zero-free and shared scopes, with a variable that no factor has."""
    a, b, c, lone = Variable("a", (0, 1)), Variable("b", (0, 1, 2)), Variable("c", (0, 1, 2)), Variable("lone", (0, 1, 2, 3))
    f = factors.dense(spark, [a, b], [0.1, 0.2, 0.3, 0.4, 0.0, 0.6])
    g = factors.clause(spark, [b, c], [1, 2], 0.5)
    h = factors.dense(spark, [c, a], [1, 2, 3, 4, 5, 0])
    return Model((a, b, c, lone), (f, g, h, f))


def brute(model: Model) -> dict:
    tables = [(f.scope, {tuple(r)[:-1]: r[-1] for r in f.table.select(*f.scope, "w").collect()}) for f in model.factors]
    names = [v.name for v in model.variables]
    out = {}
    for x in itertools.product(*(range(len(v)) for v in model.variables)):
        at = dict(zip(names, x))
        out[x] = math.prod(t.get(tuple(at[v] for v in scope), 0.0) for scope, t in tables)
    return out


@pytest.mark.parametrize("make", [student, mixed])
def test_inference_equals_brute_force(spark, make):
    model = make(spark)
    all_ = brute(model)
    names = [v.name for v in model.variables]
    cond = {names[1]: (0, 1), names[2]: (0, 2)}
    met = {x: w for x, w in all_.items() if x[1] in (0, 1) and x[2] in (0, 2)}
    assert inference.wmc(model).first()[0] == pytest.approx(sum(all_.values()))
    assert inference.wmc(model, cond).first()[0] == pytest.approx(sum(met.values()))
    assert inference.wmc(model, {names[1]: ()}).first()[0] == 0
    assert inference.wmc(model, ring=inference.SEMIRINGS["max_product"]).first()[0] == pytest.approx(max(all_.values()))
    z = sum(met.values())
    for r in inference.all_marginals(model, cond).collect():
        k = names.index(r.variable)
        assert r.p == pytest.approx(sum(w for x, w in met.items() if x[k] == r.state) / z)
    for r in inference.marginal(model, [names[0], names[2]], cond).collect():
        assert r.p == pytest.approx(sum(w for x, w in met.items() if (x[0], x[2]) == (r[0], r[1])) / z)
    event = sum(w for x, w in met.items() if x[0] == 1) / z
    assert inference.probability(model, {names[0]: 1}, cond).first().p == pytest.approx(event)
    best = inference.mpe(model, cond).first()
    assert best.w == pytest.approx(max(met.values())) and tuple(best)[:-1] == min(x for x, w in met.items() if w >= max(met.values()) - 1e-12)
    f = model.factors[0]
    for r in inference.gradient(model, 0).collect():
        same = {x: w for x, w in brute(Model(model.variables, model.factors[1:])).items() if all(x[names.index(v)] == r[v] for v in f.scope)}
        assert r.d == pytest.approx(sum(same.values()))


def test_student_grades(spark):
    got = {r.grade: r.p for r in inference.marginal(student(spark), ["grade"]).collect()}
    assert got == pytest.approx({0: 0.447, 1: 0.2714, 2: 0.2816})


MAKERS = [(examples.network, n) for n in ("sprinkler", "rain", "cancer", "earthquake", "survey")] + [(f, None) for f in (examples.loop, examples.clique, examples.star, examples.cnf, examples.stress)]


@pytest.mark.parametrize("make, name", MAKERS, ids=lambda x: x if isinstance(x, str) else getattr(x, "__name__", ""))
def test_examples(spark, make, name):
    model = make(spark, name) if name else make(spark)
    if name:
        assert factors.is_bayesian(model)
    elif make is examples.loop:
        model = examples.loop(spark, 4, 3)
    all_ = brute(model)
    v = model.variables[-1]
    assert inference.wmc(model, {v.name: 1}).first()[0] == pytest.approx(sum(w for x, w in all_.items() if x[-1] == 1))


def test_asia(spark):
    got = {(r.variable, r.state): r.p for r in inference.all_marginals(examples.network(spark, "asia")).collect()}
    assert got["lung", 0] == pytest.approx(0.055) and got["tub", 0] == pytest.approx(0.0104) and got["either", 0] == pytest.approx(0.064828) and got["bronc", 0] == pytest.approx(0.45)


def test_batch_and_soft_evidence(spark):
    model = student(spark)
    all_ = brute(model)
    data = spark.createDataFrame([(1, 0, 1), (2, None, 0), (3, 1, None), (4, None, None), (5, 1, 1)], "id int, sat int, letter int")
    got = {r.id: r.wmc for r in inference.batch_evidence(model, data, ["sat", "letter"]).collect()}
    for i, s, letter in [tuple(r) for r in data.collect()]:
        assert got[i] == pytest.approx(sum(w for x, w in all_.items() if s in (None, x[3]) and letter in (None, x[4])))
    posterior = inference.batch_evidence(model, data, ["sat", "letter"], target="grade").collect()
    assert len(posterior) == 15 and all(abs(sum(r.p for r in posterior if r.id == i) - 1) < 1e-9 for i in got)
    soft = spark.createDataFrame([(1, [0.2, 0.8], [1.0, 0.0])], "id int, sat array<double>, letter array<double>")
    want = sum(w * (0.2, 0.8)[x[3]] * (1.0, 0.0)[x[4]] for x, w in all_.items())
    assert inference.soft_evidence(model, soft, ["sat", "letter"], "id").first().wmc == pytest.approx(want)


def test_orders_and_join_tree():
    scopes = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e")]
    sizes = dict.fromkeys("abcde", 3)
    for o in elimination.OBJECTIVES:
        order, largest = elimination.order(scopes, sizes, o)
        assert sorted(order) == list("abcde") and largest == pytest.approx(3 * math.log2(3))
    assert elimination.order(scopes, sizes, keep=["a", "e"])[0] in (["b", "c", "d"], ["c", "b", "d"])
    clusters, parents = elimination.join_tree(scopes, sizes)
    assert all(any(set(s) <= c for c in clusters) for s in scopes)
    assert all(p is None or p > k for k, p in enumerate(parents))


def divergence_models(spark):
    v = {n: Variable(n, (0, 1)) for n in ("x1", "x2", "x3")}

    def f(child, parents, values):
        return factors.dense(spark, [v[child], *(v[p] for p in parents)], values)

    a = Model(tuple(v.values()), (f("x2", ["x1"], [0.8, 0.6, 0.2, 0.4]), f("x3", ["x1"], [0.9, 0.7, 0.1, 0.3]), f("x1", [], [0.5, 0.5])))
    b = Model(tuple(v.values()), (f("x1", ["x2"], [4 / 7, 1 / 3, 3 / 7, 2 / 3]), f("x3", ["x2"], [57 / 70, 23 / 30, 13 / 70, 7 / 30]), f("x2", [], [0.7, 0.3])))
    return [Space(inference.marginal(m, ["x1", "x2", "x3"]).withColumnRenamed("p", "weight")) for m in (a, b)]


def test_divergences(spark):
    a, b = divergence_models(spark)
    by = ["x1", "x2", "x3"]
    assert divergence.kl(a, b, by).first().kl == pytest.approx(0.04468347826465541)
    assert divergence.kl(b, a, by).first().kl == pytest.approx(0.04805616840705247)
    assert divergence.factored_histogram_intersection(a, b, {"x2": ["x1"], "x3": ["x1"], "x1": []}).first().fhi == pytest.approx(0.9682539682539683)
    assert divergence.factored_histogram_intersection(b, a, {"x1": ["x2"], "x3": ["x2"], "x2": []}).first().fhi == pytest.approx(1.0)
    assert divergence.histogram_intersection(a, a, by).first().hi == pytest.approx(1)
    gone = Space(b.table.where("x1 = 0"))
    assert math.isnan(divergence.kl(a, gone, by).first().kl)


def test_space_measures(spark):
    rows = [(x, y, float(1 + x * 3 + y * y)) for x in range(2) for y in range(3)]
    s = Space(spark.createDataFrame(rows, "x int, y int, weight double"))
    z = sum(w for *_, w in rows)
    px = {x: sum(w for a, _, w in rows if a == x) / z for x in range(2)}
    py = {y: sum(w for _, b, w in rows if b == y) / z for y in range(3)}
    hx, hy = (-sum(p * math.log2(p) for p in d.values()) for d in (px, py))
    hxy = -sum(w / z * math.log2(w / z) for *_, w in rows)
    m = s.measures("x", "y").first()
    mi = hx + hy - hxy
    want = [hx, hy, hxy, hxy - hy, mi, mi / min(hx, hy), mi / hy, 2 * mi / (hx + hy), mi / hxy, mi / math.sqrt(hx * hy)]
    assert tuple(m) == pytest.approx(want)
    assert s.entropy("x").first()[0] == pytest.approx(hx)
    assert s.probability({"x": 1}, {"y": (0, 2)}).first().p == pytest.approx((4 + 8) / (1 + 5 + 4 + 8))
    assert math.isnan(s.probability({"x": 1}, {"y": 7}).first().p)
    assert s.wmc({"y": 7}).first().wmc == 0
    assert s.most_likely(["x", "y"]).first().p == pytest.approx(8 / z)
    assert s.correlation(("x", 1), ("x", 1)).first()[0] == 1 and s.correlation(("x", 1), ("x", 0)).first()[0] == 0
    assert math.isnan(s.correlation(("x", 1), ("x", 1), {"x": 0}).first()[0])
    assert s.correlation(("x", 1), ("y", 1), {"y": 1}).first()[0] == 0
    full = s.marginal(["y"], {"y": 1}, space=state_space(spark, [Y])).collect()
    assert {r.y: r.p for r in full} == {0: 0, 1: 1, 2: 0}
    empty = Space(s.table.limit(0))
    assert empty.entropy("x").first()[0] == 0
    assert all(math.isnan(r.p) for r in empty.marginal(["x"], space=state_space(spark, [X])).collect())


def test_cross_tables(spark):
    data = spark.createDataFrame([(0, 0, 2.0), (0, 0, 1.0), (1, 2, 0.5), (1, 2, -0.5), (1, 1, 4.0)], "x int, y int, wt double")
    t = ct.cross_table(data, [X, Y], "wt")
    assert rows_of(t) == [(0, 0, 3.0), (1, 1, 4.0)]
    assert rows_of(ct.cross_table(data, [X, Y], prior=1.0)) == [(0, 0, 3.0), (0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)]
    assert rows_of(ct.cross_table(data, [])) == [(5.0,)]
    assert ct.scale(t, 0).count() == 0 and rows_of(ct.project(t, ["x"])) == [(0, 3.0), (1, 4.0)]
    assert ct.same(ct.add(t, t), ct.scale(t, 2)) and not ct.same(t, ct.scale(t, 2))
    many = ct.cross_tables(data.withColumn("x", F.nullif("x", F.lit(1))), [["x", "y"], ["y"], ["y", "x"]], "wt")
    assert {tuple(r) for r in many.where("scope = 0").collect()} == {(0, 0, 0, 3.0), (0, None, 1, 4.0)}
    assert many.where("scope = 2").count() == 2 and many.where("scope = 1").count() == 2
    abc = spark.createDataFrame([(a, b, c, float(1 + 4 * a + 2 * b + c)) for a in range(2) for b in range(2) for c in range(2)], "a int, b int, c int, weight double")
    target = spark.createDataFrame([(0, 1000.0), (1, 52.0)], "a int, weight double")
    assert [r[-1] for r in sorted(tuple(r) for r in ct.condition_table(abc, target).collect())] == pytest.approx([100, 200, 300, 400, 10, 12, 14, 16])


def test_soft_evidence_tables(spark):
    soft = spark.createDataFrame([([0.25, 0.75], [1.0, 0.0, 1.0], 2.0), ([0.0, 0.0], [1.0, 1.0, 1.0], 1.0)], "x array<double>, y array<double>, weight double")
    n = evidence.normalise(soft, [X, Y]).collect()
    assert n[0].y == [0.5, 0.0, 0.5] and n[0].weight == 4.0 and n[1].x == [0.0, 0.0] and n[1].weight == 0
    hard = evidence.harden(soft, [X, Y]).collect()
    assert tuple(hard[0]) == (1, 0, 4.0)
    assert rows_of(evidence.expand(soft, [X, Y], merge=True)) == [(0, 0, 0.5), (0, 2, 0.5), (1, 0, 1.5), (1, 2, 1.5)]
    assert rows_of(evidence.expand(evidence.soften(ct.weighted(spark.createDataFrame([(1, 2)], "x int, y int")), [X, Y]), [X, Y])) == [(1, 2, 1.0)]
    with pytest.raises(Exception, match="negative"):
        evidence.normalise(spark.createDataFrame([([-1.0, 0.5], 1.0)], "x array<double>, weight double"), [X]).collect()


def test_learning_student_rows(spark):
    rows = [tuple(map(int, r)) for r in "01201 11201 11201 00200 01110 11111 11000 11001 10000".split()]
    names = ["difficult", "intelligent", "grade", "award", "letter"]
    data = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    d, i, g = Variable("difficult", ("y", "n")), Variable("intelligent", ("y", "n")), Variable("grade", ("low", "medium", "high"))
    structure = {"difficult": [], "intelligent": [], "grade": ["intelligent", "difficult"]}
    model = learning.train(data, [d, i, g], structure)
    assert factors.is_bayesian(model)
    cpts = {f.scope[0]: {tuple(r)[:-1]: r[-1] for r in f.table.select(*f.scope, "w").collect()} for f in model.factors}
    assert cpts["difficult"] == pytest.approx({(0,): 3 / 9, (1,): 6 / 9}) and cpts["intelligent"] == pytest.approx({(0,): 2 / 9, (1,): 7 / 9})
    assert [cpts["grade"][k, 1, 1] for k in range(3)] == pytest.approx([2 / 5, 1 / 5, 2 / 5])
    prior = learning.train(data, [d, i, g], structure, priors=1.0)
    assert prior.factors[0].table.where("difficult = 0").first().w == pytest.approx((3 + 1) / (9 + 2))
    with pytest.raises(ValueError):
        learning.train(data, [d, i, g], {"difficult": ["grade"], "grade": ["difficult"], "intelligent": []})
    assert learning.log_likelihood(model, data).first()[0] < 0


def test_coalescing_rebuilds_a_cube(spark):
    v = [Variable(n, (0, 1)) for n in "xyz"]
    cube = spark.createDataFrame([(a, b, c, float(1 + 4 * a + 2 * b + c)) for a in range(2) for b in range(2) for c in range(2)], "x int, y int, z int, weight double")
    pairs = [ct.project(cube, p) for p in (["x", "y"], ["x", "z"], ["y", "z"])]
    got = learning.coalesce_tables(pairs, v, rounds=25)
    for pair, p in zip(pairs, (["x", "y"], ["x", "z"], ["y", "z"])):
        want = {tuple(r)[:-1]: r[-1] / 36 for r in pair.collect()}
        assert {tuple(r)[:-1]: r[-1] for r in ct.project(got, p).select(*p, "weight").collect()} == pytest.approx(want, abs=2e-3)


def test_factor_kinds(spark):
    with pytest.raises(ValueError):
        factors.dense(spark, [X, Y], [1.0])
    with pytest.raises(ValueError):
        Variable("v", (1, 1))
    assert Variable("v", (1, True, 1.0, None, "1")).index(True) == 1
    f = factors.dense(spark, [X, Y], [0.5, 0.5, 0.5, 0.25, 0.0, 0.25])
    c = factors.compact(f).collect()
    assert {(r.w, r.param_id, r.uses) for r in c} == {(0.25, 0, 2), (0.5, 1, 3)} and len(c) == 5
    n = factors.cpt(factors.dense(spark, [X, Y], [1, 1, 0, 3, 1, 0]))
    assert factors.is_cpt(n) and not factors.is_cpt(f) and n.table.where("y = 2").count() == 0
    assert factors.zero(spark, [X]).table.count() == 0
    a, b = factors.reduce_rows([Factor((X,), spark.createDataFrame([(0, 1.0)], "x int, w double")), f])
    assert b.table.count() == 3 and a.table.count() == 1
    assert factors.markov_blanket(student(spark), "intelligent") == {"difficult", "grade", "sat"}
    assert condition(("x", 1), {"x": (0,)}, None) == {"x": (0, 1)}


def test_labels(spark):
    df = spark.createDataFrame([("n",), ("y",), (None,)], "x string")
    assert [r[0] for r in df.select(X.of_labels(F.col("x"))).collect()] == [0, 1, None]
    with pytest.raises(Exception, match="unknown state"):
        spark.createDataFrame([("q",)], "x string").select(X.of_labels(F.col("x"))).collect()
    assert variables_of(df, ["x"])[0].states == ("n", "y")


def test_samples_follow_the_model(spark):
    model = student(spark)
    n = 20_000
    want = {r.grade: r.p for r in inference.marginal(model, ["grade"], {"intelligent": 1}).collect()}
    draws = {
        "direct": sampling.direct(model, n, ["difficult", "grade"], {"intelligent": 1}),
        "forward": sampling.forward(model, 3 * n, cond={"intelligent": 1}),
        "rejection": sampling.rejection(model, 3 * n, {"intelligent": 1}),
        "gibbs": sampling.markov_chains(model, 8, 1500, cond={"intelligent": 1}, burn_in=20),
        "metropolis": sampling.markov_chains(model, 8, 1500, "metropolis", {"intelligent": 1}, burn_in=50, skip=6),
    }
    for name, rows in draws.items():
        found = {r.grade: r["count"] for r in rows.groupBy("grade").count().collect()}
        total = sum(found.values())
        for k, p in want.items():
            assert found.get(k, 0) / total == pytest.approx(p, abs=0.03), name
    table = spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0), (1, 2, 5.0)], "x int, y int, weight double")
    got = {tuple(r)[:-1]: r["count"] for r in sampling.from_table(table, n).groupBy("x", "y").count().collect()}
    assert sum(got.values()) == n and got[1, 2] / n == pytest.approx(0.625, abs=0.02)
    assert {r.x for r in sampling.uniform(spark, [X, Y], 100, {"x": 1}).collect()} == {1}


def test_text_source(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("# comment\nz, x ,other,y,w\n0,1, 9,2,0.5 # more\n\n1,0,9,1,2\n")
    got = text.hard_dataset(spark, str(path), [X, Y], weights="w")
    assert rows_of(got) == [(0, 1, 2.0), (1, 2, 0.5)]
    path.write_text("1 2\n0   1\n")
    assert rows_of(text.hard_dataset(spark, str(path), [X, Y], sep=None)) == [(0, 1, 1.0), (1, 2, 1.0)]
    path.write_text("3|1|2\n4|0|0\n")
    assert rows_of(text.hard_dataset(spark, str(path), [X, Y], sep="|", weights=0)) == [(0, 0, 4.0), (1, 2, 3.0)]
    path.write_text("1,9\n")
    with pytest.raises(Exception, match="bad state"):
        text.hard_dataset(spark, str(path), [X, Y]).collect()
    path.write_text("")
    assert text.hard_dataset(spark, str(path), [X, Y]).count() == 0


def test_model_files(spark, tmp_path):
    model = student(spark)
    want = brute(model)
    store.save(spark, model, f"{tmp_path}/m")
    loaded = store.load(spark, f"{tmp_path}/m")
    assert loaded.variables == model.variables and brute(loaded) == pytest.approx(want)
    net.write_net(spark, model, f"{tmp_path}/net")
    read = net.read_net(spark, f"{tmp_path}/net/part-*")
    assert [v.name for v in read.variables] == [v.name for v in model.variables] and brute(read) == pytest.approx(want)


def test_circuit_files(spark, tmp_path):
    (tmp_path / "c.nnf").write_text("c comment\nnnf 7 6 4\nL 1\nL -1\nL 2\nA 2 0 2\nO 1 2 1 3\n* 0\n+ 2 4 5\n%\nignored\n")
    nodes = circuits.read_nnf(spark, str(tmp_path / "c.nnf"))
    assert [r.op for r in nodes.orderBy("node").collect()] == ["lit", "lit", "lit", "mul", "add", "mul", "add"]
    (tmp_path / "c.lmap").write_text("cc$N$3\ncc$V$x$2\ncc$I$1$1.0$+$x$0\ncc$I$-1$1.0$+$x$1\ncc$C$2$0.25$+$t\ncc$K$1\n")
    indicators, parameters = circuits.read_literal_map(spark, str(tmp_path / "c.lmap"))
    assert rows_of(indicators) == [(-1, "x", 1), (1, "x", 0)] and rows_of(parameters) == [(2, 0.25)]
    values = parameters.unionByName(spark.createDataFrame([(1, 1.0), (-1, 0.0)], "literal int, value double"))
    got = {r.node: r.value for r in circuits.evaluate(nodes, values).collect()}
    assert got == {0: 1, 1: 0, 2: 0.25, 3: 0.25, 4: 0.25, 5: 1, 6: 1.25}


def test_chained_samples(spark):
    x, prev = Variable("x", (0, 1, 2, 3)), Variable("prev", (0, 1, 2, 3))
    cycle = factors.functional(spark, x, [prev], lambda p: (p + 1) % 4)
    model = Model((x, prev), (cycle, factors.dense(spark, [prev], [0.25] * 4)))
    rows = sampling.chained(model, {"x": "prev"}, chains=2, length=9, initial={"x": 2}).orderBy("chain", "step").collect()
    assert [r.x for r in rows] == [(2 + t) % 4 for t in range(9)] * 2
    with pytest.raises(ValueError):
        sampling.chained(model, {"x": "nothing"}, chains=1, length=1)


def test_model_space(spark):
    s = inference.space(student(spark), ["grade", "sat"], {"intelligent": 0})
    assert s.measures("grade", "sat").first().mutual_information == pytest.approx(0, abs=1e-9)


def test_training_from_soft_rows(spark):
    soft = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0, 0.0], 1.0), ([0.0, 1.0], [0.0, 0.5, 0.5], 2.0)], "x array<double>, y array<double>, weight double")
    model = learning.train_soft(soft, [X, Y], {"x": [], "y": ["x"]})
    assert dict(rows_of(model.factors[0].table)) == pytest.approx({0: 1 / 6, 1: 5 / 6})
    assert dict(rows_of(model.factors[1].table.where("x = 1").select("y", "w"))) == pytest.approx({0: 0.2, 1: 0.4, 2: 0.4})


@pytest.mark.parametrize("method", ["first", "sum", "all"])
def test_networks_from_tables(spark, method):
    xy = spark.createDataFrame([(a, b, float(1 + a * 3 + b)) for a in range(2) for b in range(3)], "x int, y int, weight double")
    model = learning.network_from_tables(spark, [xy, ct.project(xy, ["y"])], [X, Y], method)
    assert factors.is_bayesian(model)
    joint = inference.marginal(model, ["x", "y"]).collect()
    assert {(r.x, r.y): r.p for r in joint} == pytest.approx({(a, b): (1 + a * 3 + b) / 21 for a in range(2) for b in range(3)})
