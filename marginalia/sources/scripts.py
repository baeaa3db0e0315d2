"""Bayesian networks as scripts: BUGS models, pomegranate scripts and Python that builds the model again.

A script is a table of lines with their places. Lines with weights are made
where the factors' rows are, one for each parent instance or each instance, so
no table passes through the driver and no line grows with one; the driver adds
the lines that depend on variables alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Variable, natural, state_space
from marginalia.operators.factors import Factor, Model, structure_is_bayesian
from marginalia.sources.net import parent_rows

Part = str | DataFrame  # a line, or ``b, value``: lines and their order


def script(spark: SparkSession, parts: Iterable[Part]) -> DataFrame:
    """``place, value``: the parts one after the other."""
    parts = list(parts)
    plain = [(k, -1, x) for k, x in enumerate(parts) if isinstance(x, str)]
    lines = spark.createDataFrame(plain, "a long, b long, value string")
    for k, x in enumerate(parts):
        if isinstance(x, DataFrame):
            lines = lines.unionByName(x.select(F.lit(k).cast("long").alias("a"), F.col("b").cast("long").alias("b"), "value"))
    return lines.select(F.struct("a", "b").alias("place"), "value")


def write_script(lines: DataFrame, path: str) -> None:
    """The lines in order, as text files in a folder; the files' order is that of their names."""
    lines.orderBy("place").select("value").write.mode("overwrite").text(path)


def _checked(model: Model) -> dict[str, Factor]:
    """The factor of each child; an error where the structure is not Bayesian."""
    if not structure_is_bayesian(model):
        raise ValueError("the structure is not Bayesian: each variable is the child of one factor, without cycles")
    return {f.scope[0]: f for f in model.factors}


def _parents_first(families: dict[str, Factor]) -> list[str]:
    found: list[str] = []
    while len(found) < len(families):
        found += [n for n, f in families.items() if n not in found and set(f.scope[1:]) <= set(found)]
    return found


def bugs_lines(spark: SparkSession, model: Model) -> DataFrame:
    """A BUGS model with its tables as a list; the child's states are the last, fastest dimension.

    Names must be BUGS names without dots: letters and digits after a letter.
    """
    families = _checked(model)
    for n in families:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", n):
            raise ValueError(f"not a name in BUGS: {n!r}")
    parts: list[Part] = ["model {"]
    parts += [f"    {n} ~ dcat(p.{n}[{''.join(p + ',' for p in f.scope[1:])}1:{len(f.variables[0])}])" for n, f in families.items()]
    parts += ["}", "list("]
    for k, (n, f) in enumerate(families.items()):
        child, *parents = f.variables
        delimiter = "," if k + 1 < len(families) else ""
        rows = parent_rows(spark, f)
        last = 1
        for p in parents:
            last *= len(p)
        values = F.concat(F.lit("        "), F.array_join(F.col("w").cast("array<string>"), ","), F.when(F.col("b") < last - 1, ",").otherwise(""))
        dims = ",".join(str(len(v)) for v in (*parents, child))
        parts += [f"    p.{n} = " + ("structure(.Data = c(" if parents else "c("), rows.select("b", values.alias("value")), f"    ), .Dim = c({dims})){delimiter}" if parents else f"    ){delimiter}"]
    return script(spark, [*parts, ")"])


def _literal(v: Variable, column: Column) -> Column:
    """The state as a Python literal."""
    return F.element_at(F.array(*(F.lit(repr(s)) for s in v.states)), column + 1)


def _instances(spark: SparkSession, f: Factor) -> DataFrame:
    """All instances with ``b``, their natural index, and their weights, 0 where absent."""
    return state_space(spark, f.variables).join(f.table, list(f.scope), "left").withColumns({"b": natural(f.variables), "w": F.coalesce("w", F.lit(0.0)).cast("string")})


def pomegranate_lines(spark: SparkSession, model: Model, network: str = "network", module: str = "pom", bake: bool = True, name: str = "network") -> DataFrame:
    """A script for pomegranate: distributions, parents first, then states, nodes and edges, and ``bake`` if wanted.

    An instance of a conditional table has the states of the parents, then of the child.
    """
    families = _checked(model)
    place = {v.name: k for k, v in enumerate(model.variables)}
    parts: list[Part] = [f"import pomegranate as {module}", ""]
    for n in _parents_first(families):
        f = families[n]
        child, *parents = f.variables
        rows = _instances(spark, f)
        if parents:
            states = F.concat_ws(", ", *(_literal(v, F.col(v.name)) for v in (*parents, child)), "w")
            parts += [f"d{place[n]} = {module}.ConditionalProbabilityTable([", rows.select("b", F.concat(F.lit("    ["), states, F.lit("],")).alias("value"))]
            parts.append(f"], [{', '.join(f'd{place[p.name]}' for p in parents)}])")
        else:
            parts += [f"d{place[n]} = {module}.DiscreteDistribution({{", rows.select("b", F.concat(F.lit("    "), _literal(child, F.col(n)), F.lit(": "), "w", F.lit(",")).alias("value")), "})"]
    parts.append("")
    parts += [f"s{k} = {module}.State(d{k}, name={n!r})" for n, k in place.items()]
    parts.append(f"{network} = {module}.BayesianNetwork({name!r})")
    parts += [f"{network}.add_nodes(s{k})" for k in place.values()]
    parts += [f"{network}.add_edge(s{place[p]}, s{place[n]})" for n, f in families.items() for p in f.scope[1:]]
    return script(spark, [*parts, *([f"{network}.bake()"] if bake else [])])


def python_lines(spark: SparkSession, model: Model, function: str = "model") -> DataFrame:
    """Python source of a function of a session that builds any model again: states by their literals, rows that weigh something."""
    place = {v.name: k for k, v in enumerate(model.variables)}
    parts: list[Part] = ["from marginalia.catalog import Variable", "from marginalia.operators.factors import Model, sparse", "", "", f"def {function}(spark):"]
    parts += [f"    v{k} = Variable({v.name!r}, {v.states!r})" for k, v in enumerate(model.variables)]
    for k, f in enumerate(model.factors):
        states = F.concat_ws(", ", *(F.col(n).cast("string") for n in f.scope))
        line = F.concat(F.lit("        ("), states, F.lit(",): "), F.col("w").cast("double").cast("string"), F.lit(","))
        rows = f.nonzero().select(natural(f.variables).alias("b"), line.alias("value"))
        parts += [f"    f{k} = sparse(spark, [{', '.join(f'v{place[n]}' for n in f.scope)}], {{", rows, "    })"]

    def tuple_of(letter: str, n: int) -> str:
        return "(" + "".join(f"{letter}{k}, " for k in range(n)).rstrip() + ")"

    return script(spark, [*parts, f"    return Model({tuple_of('v', len(place))}, {tuple_of('f', len(model.factors))})"])
