"""Hard and soft data sets: conversions, normalisation and expansion.

A hard column holds state indexes; a soft column holds a vector of weights, one
per state. ``weight`` is the weight of a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.functions.scalar import arg_max, one_hot, total
from marginalia.operators.crosstab import WEIGHT, cross_table, summed, weighted


def soften(data: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """Hard columns as one-hot vectors."""
    return data.withColumns({v.name: one_hot(F.col(v.name), len(v)) for v in variables})


def harden(data: DataFrame, variables: Sequence[Variable], adjust: bool = True) -> DataFrame:
    """Soft columns as their first most likely state; ``adjust`` multiplies the weight by each vector's sum."""
    if adjust:
        factor = reduce(lambda a, v: a * total(F.col(v.name)), variables, F.col(WEIGHT))
        data = data.withColumn(WEIGHT, factor)
    return data.withColumns({v.name: arg_max(F.col(v.name)) for v in variables})


def normalise(data: DataFrame, variables: Sequence[Variable], check: bool = True) -> DataFrame:
    """Vectors that sum to one, with their sums moved into the weight; a zero sum makes the row zero.

    A negative weight that results is an error if ``check``.
    """
    sums = [total(F.col(v.name)) for v in variables]
    weight = reduce(lambda a, s: a * s, sums, F.col(WEIGHT).cast("double"))
    if check:
        weight = F.when(weight < 0, F.raise_error(F.lit("negative instance weight")).cast("double")).otherwise(weight)
    out = data.withColumn("_weight", weight)

    def divided(vector: Column, by: Column) -> Column:
        return F.transform(vector, lambda x: F.when(F.col("_weight") == 0, F.lit(0.0)).otherwise(F.try_divide(x, by)))

    return out.withColumns({v.name: divided(F.col(v.name), s) for v, s in zip(variables, sums)}).withColumn(WEIGHT, F.col("_weight")).drop("_weight")


def expand(data: DataFrame, variables: Sequence[Variable], merge: bool = False) -> DataFrame:
    """Hard rows of soft data: a row for every combination of states with weight; ``merge`` sums equal instances."""
    keep = [c for c in data.columns if c not in {v.name for v in variables} and c != WEIGHT]
    out = data.where(F.col(WEIGHT) != 0)
    for v in variables:
        rest = [c for c in out.columns if c != v.name]
        out = out.select(*rest, F.posexplode(v.name).alias("_state", "_w")).where(F.col("_w") != 0)
        out = out.withColumn(WEIGHT, F.col(WEIGHT) * F.col("_w")).withColumn(v.name, F.col("_state")).drop("_state", "_w")
    columns = [*keep, *(v.name for v in variables)]
    return summed(out, columns) if merge else out.select(*columns, WEIGHT)


def cross_table_of(data: DataFrame, variables: Sequence[Variable], weight: str | None = None, prior: float | DataFrame = 0) -> DataFrame:
    """The cross-table of hard or soft data: a column of arrays is soft, any other holds states; both may stand side by side."""
    kinds = dict(data.dtypes)
    rows = weighted(data, weight).select(*(v.name for v in variables), WEIGHT)
    soft = [v for v in variables if kinds[v.name].startswith("array")]
    return cross_table(expand(rows, soft) if soft else rows, variables, WEIGHT, prior)


def hard_cell(hard: Column, soft: Column, missing: int) -> Column:
    """The state of a cell that is hard, soft or missing."""
    return F.coalesce(hard.cast("int"), arg_max(soft), F.lit(missing))


def soft_cell(hard: Column, soft: Column, variable: Variable, missing: Sequence[float] | float = float("nan")) -> Column:
    """The vector of a cell that is hard, soft or missing."""
    fill = [float(missing)] * len(variable) if isinstance(missing, (int, float)) else [float(x) for x in missing]
    return F.coalesce(soft, one_hot(hard, len(variable)), F.array(*(F.lit(x) for x in fill)))


def checked_cell(hard: Column, soft: Column, variable: Variable) -> tuple[Column, Column]:
    """The same cell, with an error for a state out of range or a vector of another length."""
    bad = (hard < 0) | (hard >= len(variable)) | (F.size(soft) != len(variable))
    problem = F.raise_error(F.lit(f"bad value of {variable.name}"))
    return F.when(bad, problem.cast("int")).otherwise(hard), F.when(bad, problem.cast("array<double>")).otherwise(soft)


def accumulate(data: DataFrame, results: Sequence[Column], aliases: Sequence[str]) -> DataFrame:
    """Weighted sums of expressions over all rows."""
    return data.agg(*(F.coalesce(F.sum(r * F.col(WEIGHT)), F.lit(0.0)).alias(a) for r, a in zip(results, aliases)))
