"""Bayesian networks in the Hugin ``net`` format."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Variable, natural, state_space
from marginalia.folders import written
from marginalia.operators.factors import Factor, Model, compact, cpt

BLOCK = r"(node|potential)\s+(\([^)]*\)|[^\s{]+)\s*\{((?:\"(?:[^\"\\]++|\\.)*+\"|[^}\"]++)*+)\}"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


class NetworkBuilder(Protocol):
    """What a reader of networks hands its findings to, in the order of the file: all nodes, then all potentials."""

    def node(self, name: str, states: Sequence[str]) -> None: ...

    def potential(self, scope: Sequence[str], rows: DataFrame) -> None: ...  # the child first; a column per node and ``w``

    def result(self): ...


#: What becomes of a potential's rows: all of them, those with weight, or conditional rows normalised for each parent instance.
FLAVOURS = {
    "dense": lambda f: f,
    "sparse": lambda f: Factor(f.variables, f.nonzero()),
    "cpt": cpt,
}


class ModelBuilder:
    """Builds a model; ``flavour`` is one of ``FLAVOURS``, or ``compact`` to write every distinct weight once and refer to it."""

    def __init__(self, flavour: str = "dense"):
        if flavour != "compact" and flavour not in FLAVOURS:
            raise ValueError(f"unknown flavour {flavour}")
        self.flavour, self.variables, self.factors = flavour, {}, []

    def node(self, name: str, states: Sequence[str]) -> None:
        if name in self.variables:
            raise ValueError(f"node {name} is given twice")
        self.variables[name] = Variable(name, tuple(states))

    def potential(self, scope: Sequence[str], rows: DataFrame) -> None:
        factor = Factor(tuple(self.variables[n] for n in scope), rows)
        if self.flavour == "compact":
            numbered = written(compact(factor), "compact")
            parameters = written(numbered.select("param_id", "w").distinct(), "parameters")
            self.factors.append(Factor(factor.variables, numbered.select(*factor.scope, "param_id").join(parameters, "param_id").select(*factor.scope, "w")))
        else:
            self.factors.append(FLAVOURS[self.flavour](factor))

    def result(self) -> Model:
        return Model(tuple(self.variables.values()), tuple(self.factors))


def read_net(spark: SparkSession, path: str, builder: NetworkBuilder | None = None):
    """A model from a file of ``node`` and ``potential`` blocks, or what another builder makes of them.

    Comments go from ``%`` to the end of the line. A potential's data run over
    its parents, the last fastest, and within these over the child. Numbers
    are taken apart in Spark, so large tables don't pass through the driver.
    """
    text = F.regexp_replace("value", r'("(?:[^"\\]++|\\.)*+")|%[^\n]*', "$1")  # quoted text stays
    whole = spark.read.text(path, wholetext=True).select(text.alias("value"))
    blocks = whole.select(F.posexplode(F.regexp_extract_all("value", F.lit(BLOCK), F.lit(0))).alias("place", "block"))
    parts = written(blocks.select("place", *(F.regexp_extract("block", BLOCK, k).alias(n) for k, n in ((1, "what"), (2, "name"), (3, "body")))), "net")  # the file is taken apart once

    def field(name: str) -> Column:
        return F.regexp_extract("body", name + r"\s*=\s*([^;]*);", 1)

    builder = ModelBuilder() if builder is None else builder
    variables = {}  # numbers of states
    for r in parts.where("what = 'node'").orderBy("place").select("name", F.regexp_extract_all(field("states"), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)).alias("states")).collect():
        variables[r["name"]] = len(r["states"])
        builder.node(r["name"], r["states"])
    potentials = parts.where("what = 'potential'")
    for r in potentials.orderBy("place").select("place", "name").collect():
        names = re.findall(r"[^\s()|]+", r["name"])
        missing = [n for n in names if n not in variables]
        if missing:
            raise ValueError(f"potential of unknown nodes {missing}")
        data = potentials.where(F.col("place") == r["place"]).select(F.posexplode(F.regexp_extract_all(field("data"), F.lit(NUMBER), F.lit(0))).alias("k", "w"))
        order = [*names[1:], names[0]]  # child fastest
        stride, columns = 1, {}
        for n in reversed(order):
            columns[n] = (F.floor(F.col("k") / stride) % variables[n]).cast("int").alias(n)
            stride *= variables[n]
        given = data.count()
        if given < stride:
            raise ValueError(f"too few values for {names[0]}: {given} of {stride}")
        w = F.when(F.col("k") < stride, F.col("w").cast("double")).otherwise(F.raise_error(F.lit(f"too many values for {names[0]}")).cast("double"))
        builder.potential(names, data.select(*(columns[n] for n in names), w.alias("w")))
    return builder.result()


def parent_rows(spark: SparkSession, factor: Factor) -> DataFrame:
    """``b, w``: every parent instance's natural index and the weights of the child's states in order, 0 where absent."""
    child, *parents = factor.variables
    full = state_space(spark, factor.variables).join(factor.table, list(factor.scope), "left")
    pairs = F.sort_array(F.collect_list(F.struct(child.name, F.coalesce("w", F.lit(0.0)).alias("w"))))  # states of one variable
    rows = full.groupBy(*(p.name for p in parents)).agg(pairs.alias("d"))
    return rows.select((natural(parents) if parents else F.lit(0)).cast("long").alias("b"), F.transform("d", lambda x: x["w"]).alias("w"))


def net_lines(spark: SparkSession, model: Model) -> DataFrame:
    """``place, value``: the lines of the file, to be ordered by place."""

    def quoted(s) -> str:
        return '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'

    head = ["net", "{", "}"]
    for v in model.variables:
        head += [f"node {v.name}", "{", f"  states = ({' '.join(map(quoted, v.states))});", "}"]
    lines = spark.createDataFrame([(k, -1, x) for k, x in enumerate(head)], "a long, b long, value string")
    for k, f in enumerate(model.factors):
        child, *parents = f.variables
        given = f" | {' '.join(p.name for p in parents)}" if parents else ""
        start = spark.createDataFrame([(len(head) + k, -1, f"potential ({child.name}{given}) {{ data = (")], lines.schema)
        value = F.concat(F.lit("  ("), F.array_join(F.col("w").cast("array<string>"), " "), F.lit(")"))
        body = parent_rows(spark, f).select(F.lit(len(head) + k).cast("long").alias("a"), "b", value.alias("value"))
        end = spark.createDataFrame([(len(head) + k, 1 << 60, "); }")], lines.schema)
        lines = lines.unionByName(start).unionByName(body).unionByName(end)
    return lines.select(F.struct("a", "b").alias("place"), "value")


def write_net(spark: SparkSession, model: Model, path: str) -> None:
    """The model as one text file in a folder; lines are few, one per parent instance."""
    net_lines(spark, model).orderBy("place").select("value").coalesce(1).write.mode("overwrite").text(path)
