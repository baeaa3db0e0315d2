"""Samplers as sources: each turns row numbers into samples, so that any batch or stream of numbers is a sample.

A sample depends on its number and the seed alone. A batch is a range of
numbers; a stream without end counts them up, a bounded number a micro-batch,
and goes on from its checkpoint after a restart. What a sampler needs of its
model is worked out once, when it is made, and written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Condition, Variable, condition, holds
from marginalia.folders import written
from marginalia.operators import alias
from marginalia.operators.crosstab import WEIGHT
from marginalia.operators.factors import Model
from marginalia.operators.sampling import Draw, Step, _products, cdf, families, random_draw, stepped, uniform_rows


class Sampler(Protocol):
    """Anything that gives the samples of a table of numbers ``row``: ``row`` and the columns; at most one for each."""

    columns: Sequence[str]

    def of(self, numbers: DataFrame) -> DataFrame: ...


def batch(sampler: Sampler, spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """The samples of ``n`` numbers from ``start``."""
    return sampler.of(spark.range(start, start + n).withColumnRenamed("id", "row"))


def stream(sampler: Sampler, spark: SparkSession, rows_per_batch: int, start: int = 0) -> DataFrame:
    """Samples without end, those of ``rows_per_batch`` numbers in each micro-batch."""
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    return sampler.of(numbers.select((F.col("value") + start).alias("row")))


@dataclass(frozen=True)
class Stepwise:
    """Variables drawn one after the other, each from a written table given earlier ones; samples without ``cond`` are left out."""

    columns: tuple[str, ...]
    steps: tuple[Step, ...]
    draw: Draw
    cond: Condition | None = None

    def of(self, numbers: DataFrame) -> DataFrame:
        rows = stepped(numbers, ["row"], self.steps, self.draw)
        return rows.where(holds(condition(self.cond))).select("row", *self.columns)


@dataclass(frozen=True)
class Uniform:
    """Every variable uniform over its allowed states."""

    variables: tuple[Variable, ...]
    draw: Draw
    cond: Condition | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(v.name for v in self.variables)

    def of(self, numbers: DataFrame) -> DataFrame:
        return uniform_rows(numbers.select("row"), self.variables, self.cond, self.draw)


@dataclass(frozen=True)
class Weighted:
    """Instances of a cross-table in proportion to their weights, by an alias table over groups of equal weight."""

    columns: tuple[str, ...]
    instances: DataFrame  # with ``index``
    slots: DataFrame
    size: int
    draw: Draw

    def of(self, numbers: DataFrame) -> DataFrame:
        place = F.least(F.floor(self.draw(0) * self.size), F.lit(self.size - 1))
        rows = numbers.select("row", place.alias("slot"), self.draw(1).alias("_v"), self.draw(2).alias("_w")).join(self.slots, "slot")
        own = (F.col("_v") < F.col("keep")) | F.col("other_n").isNull()
        first, n = F.when(own, F.col("first")).otherwise(F.col("other_first")), F.when(own, F.col("n")).otherwise(F.col("other_n"))
        chosen = rows.select("row", (first + F.least(F.floor(F.col("_w") * n), n - 1)).alias("index"))
        return chosen.join(self.instances, "index").select("row", *self.columns)


def forward(model: Model, cond: Condition | None = None, draw: Draw | None = None, seed: int = 1) -> Stepwise:
    """Ancestral samples of a Bayesian network; those that miss the condition are left out."""
    steps = tuple((f.scope[0], f.scope[1:], written(cdf(f.table, f.scope[0], f.scope[1:]), "cdf"), k) for k, f in enumerate(families(model)))
    return Stepwise(tuple(v.name for v in model.variables), steps, draw or random_draw(seed), cond)


def direct(model: Model, variables: Sequence[str] | None = None, cond: Condition | None = None, draw: Draw | None = None, seed: int = 1, order: Sequence[str] | None = None) -> Stepwise:
    """Exact samples of any model under a condition, one for each number; none where nothing meets the condition."""
    names = [v.name for v in model.variables]
    steps = tuple((v, tuple(rest), written(cdf(t, v, rest), "cdf"), names.index(v)) for v, rest, t in reversed(_products(model, cond, (), order, 8)))
    return Stepwise(tuple(variables or names), steps, draw or random_draw(seed))


def uniform(variables: Sequence[Variable], cond: Condition | None = None, draw: Draw | None = None, seed: int = 1) -> Uniform:
    return Uniform(tuple(variables), draw or random_draw(seed), cond)


def weighted(table: DataFrame, draw: Draw | None = None, seed: int = 1) -> Weighted:
    """Draws from a cross-table; none from one without weight. Draws 0 to 2 are the slot, the side and the place in the group."""
    instances = written(alias.numbered(table), "instances")
    slots = written(alias.slots(alias.weight_groups(instances)), "slots")
    return Weighted(tuple(c for c in table.columns if c != WEIGHT), instances.drop(WEIGHT), slots, slots.count(), draw or random_draw(seed))
