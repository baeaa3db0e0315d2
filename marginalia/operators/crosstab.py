"""Cross-tables: weighted counts of instances, with zero weights absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.catalog import Variable, names, state_space

WEIGHT = "weight"


def weighted(data: DataFrame, weight: str | None = None) -> DataFrame:
    """The data with a double column ``weight``, 1 unless given."""
    return data.withColumn(WEIGHT, F.lit(1.0) if weight is None else F.col(weight).cast("double"))


def summed(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.groupBy(*by).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def cross_table(data: DataFrame, variables: Sequence[Variable | str], weight: str | None = None, prior: float | DataFrame = 0, space: DataFrame | None = None) -> DataFrame:
    """The summed weight of every instance of the variables.

    A positive ``prior`` adds that weight to every instance of the state space,
    which is that of the variables, or ``space``; a table is added as it is.
    Without variables the result is one row, the total weight.
    """
    by = names(variables)
    rows = weighted(data, weight).select(*by, WEIGHT)
    if isinstance(prior, DataFrame):
        rows = rows.unionByName(prior.select(*by, F.col(WEIGHT).cast("double").alias(WEIGHT)))
    elif prior:
        if space is None:
            space = state_space(data.sparkSession, [v for v in variables if isinstance(v, Variable)])
        rows = rows.unionByName(space.select(*by).withColumn(WEIGHT, F.lit(float(prior))))
    return summed(rows, by)


def cross_tables(data: DataFrame, scopes: Sequence[Sequence[str]], weight: str | None = None) -> DataFrame:
    """The cross-tables of several scopes from one scan, by grouping sets.

    One row per instance: ``scope`` (its number), every variable (null outside
    the scope) and ``weight``. Scopes of the same variables share their rows'
    computation. Null states are kept apart from absent variables.
    """
    every = list(dict.fromkeys(c for s in scopes for c in s))
    rows = weighted(data, weight).select(*every, WEIGHT)
    sets = [[F.col(c) for c in s] for s in dict.fromkeys(frozenset(s) for s in scopes)]
    grouped = rows.groupingSets(sets, *every).agg(F.sum(WEIGHT).alias(WEIGHT), F.grouping_id(*(F.col(c) for c in every)).alias("_set"))
    mask = {k: sum((c not in s) << (len(every) - 1 - j) for j, c in enumerate(every)) for k, s in enumerate(scopes)}
    numbers = F.explode(F.filter(F.array(*(F.when(F.col("_set") == m, F.lit(k)) for k, m in mask.items())), lambda x: x.isNotNull()))
    return grouped.where(F.col(WEIGHT) != 0).select(numbers.alias("scope"), *every, WEIGHT)


def add(table: DataFrame, *more: DataFrame) -> DataFrame:
    """The sum of cross-tables of the same variables."""
    by = [c for c in table.columns if c != WEIGHT]
    for m in more:
        table = table.unionByName(m.select(*table.columns))
    return summed(table, by)


def scale(table: DataFrame, by: float) -> DataFrame:
    return table.withColumn(WEIGHT, F.col(WEIGHT) * F.lit(float(by))).where(F.col(WEIGHT) != 0)


def project(table: DataFrame, variables: Sequence[Variable | str]) -> DataFrame:
    """The table with all other variables summed out."""
    return summed(table, names(variables))


def total_weight(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.sum(WEIGHT), F.lit(0.0)).alias(WEIGHT))


def condition_table(table: DataFrame, target: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Weights rescaled so that the sums over ``on`` are those of ``target``.

    Groups absent from the target disappear; groups that only the target has
    stay absent.
    """
    on = list(on or [c for c in target.columns if c != WEIGHT and c in table.columns])
    wanted = summed(target, on).withColumnRenamed(WEIGHT, "_wanted")
    have = summed(table, on).withColumnRenamed(WEIGHT, "_have")
    joined = table.join(have, on).join(wanted, on)
    return joined.withColumn(WEIGHT, F.col(WEIGHT) * F.col("_wanted") / F.col("_have")).select(*table.columns).where(F.col(WEIGHT) != 0)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same variables and weights."""
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def conditional(table: DataFrame, parents: Sequence[str]) -> DataFrame:
    """``w``: each weight as a fraction of its parents' total. Parents without weight have no rows."""
    over = Window.partitionBy(*[F.col(p) for p in parents]) if parents else None
    if over is None:
        sums = table.agg(F.sum(WEIGHT).alias("_sum"))
        joined = table.crossJoin(F.broadcast(sums))  # one row
    else:
        joined = table.withColumn("_sum", F.sum(WEIGHT).over(over))
    return joined.where(F.col("_sum") > 0).withColumn("w", F.col(WEIGHT) / F.col("_sum")).drop("_sum")
