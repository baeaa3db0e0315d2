"""Models kept as Parquet: one table of states, one of factors' rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.operators.factors import Factor, Model

KINDS = {"int": int, "float": float, "str": str, "bool": lambda x: x == "True", "NoneType": lambda x: None}


def states_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(k, v.name, j, None if s is None else str(s), type(s).__name__) for k, v in enumerate(model.variables) for j, s in enumerate(v.states)]
    return spark.createDataFrame(rows, "variable int, name string, state int, label string, kind string")


def factors_table(model: Model) -> DataFrame:
    """``factor, scope, states, w``: the rows of all factors."""
    parts = [f.nonzero().select(F.lit(k).alias("factor"), F.array(*map(F.lit, f.scope)).alias("scope"), F.array(*(F.col(c).cast("int") for c in f.scope)).alias("states"), F.col("w").cast("double")) for k, f in enumerate(model.factors)]
    empty = [F.array(*map(F.lit, f.scope)) for f in model.factors]
    marks = [p.sparkSession.range(1).select(F.lit(k).alias("factor"), s.alias("scope"), F.lit(None).cast("array<int>").alias("states"), F.lit(0.0).alias("w")) for k, (p, s) in enumerate(zip(parts, empty))]
    return reduce(DataFrame.unionByName, [*parts, *marks])


def save(spark: SparkSession, model: Model, path: str) -> None:
    states_table(spark, model).write.mode("overwrite").parquet(f"{path}/states")
    factors_table(model).write.mode("overwrite").partitionBy("factor").parquet(f"{path}/factors")


def load(spark: SparkSession, path: str) -> Model:
    """The saved model; its factors' rows stay on disk until they are used."""
    found: dict[int, tuple[str, list]] = {}
    for r in spark.read.parquet(f"{path}/states").orderBy("variable", "state").collect():
        found.setdefault(r["variable"], (r["name"], []))[1].append(KINDS[r["kind"]](r["label"]))
    variables = [Variable(name, tuple(states)) for _, (name, states) in sorted(found.items())]
    by_name = {v.name: v for v in variables}
    rows = spark.read.parquet(f"{path}/factors")
    factors = []
    for r in rows.where("states is null").select("factor", "scope").orderBy("factor").collect():
        mine = rows.where((F.col("factor") == r["factor"]) & F.col("states").isNotNull())
        factors.append(Factor(tuple(by_name[n] for n in r["scope"]), mine.select(*(F.col("states")[k].alias(n) for k, n in enumerate(r["scope"])), "w")))
    return Model(tuple(variables), tuple(factors))
