import re

import pytest
from pyspark.sql import functions as F

from marginalia import examples
from marginalia.catalog import Variable
from marginalia.operators import factors
from marginalia.operators.factors import Model
from marginalia.sources import net, scripts


def text(lines) -> str:
    return "\n".join(r["value"] for r in lines.orderBy("place").select("value").collect())


def rows(table):
    return {tuple(r[c] for c in sorted(table.columns)) for r in table.collect()}


def test_bugs_has_the_child_fastest(spark):
    got = text(scripts.bugs_lines(spark, examples.network(spark, "sprinkler")))
    assert "grass ~ dcat(p.grass[rain,sprinkler,1:3])" in got
    data, dims = re.search(r"p\.grass = structure\(\.Data = c\(([^)]*)\), \.Dim = c\(([^)]*)\)", got).groups()
    assert dims == "2,2,3"
    assert [float(x) for x in data.split(",")] == [0.90, 0.09, 0.01, 0.01, 0.01, 0.98, 0.02, 0.08, 0.90, 0.01, 0.04, 0.95]
    assert got.startswith("model {\n") and got.endswith("\n)") and got.count("(") == got.count(")")
    with pytest.raises(ValueError, match="name"):
        scripts.bugs_lines(spark, examples.network(spark, "rain"))  # has a name with a blank
    with pytest.raises(ValueError, match="Bayesian"):
        scripts.bugs_lines(spark, examples.chain(spark, 3))


class Recorder:
    """Stands in for the module that a script imports."""

    def __init__(self):
        self.nodes, self.edges, self.baked = [], [], False

    DiscreteDistribution = staticmethod(lambda d: ("root", d))
    ConditionalProbabilityTable = staticmethod(lambda r, parents: ("cpt", r, parents))
    State = staticmethod(lambda d, name: (name, d))

    def BayesianNetwork(self, name):
        return self

    def add_nodes(self, s):
        self.nodes.append(s)

    def add_edge(self, a, b):
        self.edges.append((a[0], b[0]))

    def bake(self):
        self.baked = True


def test_a_pomegranate_script_defines_parents_first(spark):
    model = examples.network(spark, "student")
    got = text(scripts.pomegranate_lines(spark, model))
    module = Recorder()
    exec(got.replace("import pomegranate as pom", ""), {"pom": module})
    assert [n for n, _ in module.nodes] == [v.name for v in model.variables] and module.baked
    assert set(module.edges) == {("difficult", "grade"), ("intelligent", "grade"), ("intelligent", "sat"), ("grade", "letter")}
    found = dict(module.nodes)
    assert found["difficult"] == ("root", {"Yes": 0.6, "No": 0.4})
    kind, table, parents = found["grade"]
    assert kind == "cpt" and len(table) == 12 and parents == [found["difficult"], found["intelligent"]]
    assert table[0] == ["Yes", "Yes", "1", 0.3] and ["Yes", "No", "3", 0.7] in table
    assert "bake" not in text(scripts.pomegranate_lines(spark, model, bake=False))


@pytest.mark.parametrize("which", ["asia", "stress"])
def test_a_python_script_builds_the_model_again(spark, which):
    model = examples.stress(spark) if which == "stress" else examples.network(spark, which)
    names = {}
    exec(text(scripts.python_lines(spark, model, "again")), names)
    again = names["again"](spark)
    assert again.variables == model.variables
    for f, g in zip(model.factors, again.factors, strict=True):
        assert f.variables == g.variables and rows(f.nonzero()) == rows(g.table)


def test_models_without_factors(spark):
    names = {}
    exec(text(scripts.python_lines(spark, examples.empty())), names)
    assert names["model"](spark) == examples.empty()
    assert text(scripts.bugs_lines(spark, examples.empty())) == "model {\n}\nlist(\n)"


def test_a_written_script_is_the_lines(spark, tmp_path):
    lines = scripts.bugs_lines(spark, examples.network(spark, "cancer"))
    scripts.write_script(lines, str(tmp_path / "s"))
    files = sorted((tmp_path / "s").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == text(lines).splitlines()


def test_builders(spark, tmp_path):
    a, b = Variable("a", ("x", "y")), Variable("b", ("u", "v"))
    wide = Model((a, b), (factors.dense(spark, [b, a], [2.0, 0.0, 2.0, 5.0]), factors.dense(spark, [a], [3.0, 1.0])))
    path = str(tmp_path / "net")
    net.write_net(spark, wide, path)
    got = {k: net.read_net(spark, path, net.ModelBuilder(k)) for k in ("dense", "sparse", "cpt", "compact")}
    assert rows(got["dense"].factors[0].table) == {(0, 0, 2.0), (0, 1, 2.0), (1, 0, 0.0), (1, 1, 5.0)}  # a, b, w
    assert rows(got["sparse"].factors[0].table) == rows(got["compact"].factors[0].table) == {(0, 0, 2.0), (0, 1, 2.0), (1, 1, 5.0)}
    assert rows(got["cpt"].factors[0].table) >= {(0, 0, 0.5), (0, 1, 0.5), (1, 1, 1.0)}
    assert factors.is_bayesian(got["cpt"]) and not factors.is_bayesian(got["dense"])
    with pytest.raises(ValueError):
        net.ModelBuilder("other")

    class Sizes:
        def __init__(self):
            self.found = []

        def node(self, name, states):
            self.found.append((name, len(states)))

        def potential(self, scope, rows):
            self.found.append((tuple(scope), rows.agg(F.sum("w")).first()[0]))

        def result(self):
            return self.found

    assert net.read_net(spark, path, Sizes()) == [("a", 2), ("b", 2), (("b", "a"), 9.0), (("a",), 4.0)]
