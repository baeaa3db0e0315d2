"""Factors: tables of state indexes with a weight ``w``, absent rows weighing 0."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.catalog import Variable, natural, state_space

TOLERANCE = 1e-6


@dataclass(frozen=True)
class Factor:
    """Variables, the child first in a conditional table, and their weights."""

    variables: tuple[Variable, ...]
    table: DataFrame

    def __post_init__(self):
        object.__setattr__(self, "variables", tuple(self.variables))
        if not self.variables or len(set(self.scope)) != len(self.scope):
            raise ValueError("a factor has variables, each once")
        if set(self.table.columns) != {*self.scope, "w"}:
            raise ValueError(f"columns {self.table.columns} do not fit {self.scope}")

    @property
    def scope(self) -> tuple[str, ...]:
        return tuple(v.name for v in self.variables)

    def nonzero(self) -> DataFrame:
        return self.table.where(F.col("w") != 0)


@dataclass(frozen=True)
class Model:
    """A factor graph: the weight of an instance is the product of its factors."""

    variables: tuple[Variable, ...]
    factors: tuple[Factor, ...]

    def __post_init__(self):
        object.__setattr__(self, "variables", tuple(self.variables))
        object.__setattr__(self, "factors", tuple(self.factors))
        known = {v.name: v for v in self.variables}
        if len(known) != len(self.variables):
            raise ValueError("variables share a name")
        for f in self.factors:
            for v in f.variables:
                if known.get(v.name) != v:
                    raise ValueError(f"{v.name} is not a variable of the model")

    def variable(self, name: str) -> Variable:
        return next(v for v in self.variables if v.name == name)

    @property
    def sizes(self) -> dict[str, int]:
        return {v.name: len(v) for v in self.variables}


def _space(spark: SparkSession, variables: Sequence[Variable]) -> DataFrame:
    return state_space(spark, variables)


def zero(spark: SparkSession, variables: Sequence[Variable]) -> Factor:
    return Factor(tuple(variables), _space(spark, variables).withColumn("w", F.lit(0.0)).limit(0))


def dense(spark: SparkSession, variables: Sequence[Variable], values: Sequence[float]) -> Factor:
    """Weights of all instances in natural order, the last variable fastest."""
    n = reduce(lambda a, v: a * len(v), variables, 1)
    if len(values) != n:
        raise ValueError(f"{n} values are needed, not {len(values)}")
    weights = F.array(*(F.lit(float(x)) for x in values))
    table = _space(spark, variables).withColumn("w", F.element_at(weights, (natural(variables) + 1).cast("int")))
    return Factor(tuple(variables), table)


def sparse(spark: SparkSession, variables: Sequence[Variable], rows: Mapping[Sequence[int], float]) -> Factor:
    """The given instances; those not given weigh 0."""
    schema = ", ".join(f"`{v.name}` int" for v in variables) + ", w double"
    return Factor(tuple(variables), spark.createDataFrame([(*k, float(w)) for k, w in rows.items() if w], schema))


def filled(spark: SparkSession, variables: Sequence[Variable], weight: Column | Callable[[], Column]) -> Factor:
    """A weight for every instance from an expression, such as ``F.rand(seed)`` or a constant."""
    return Factor(tuple(variables), _space(spark, variables).withColumn("w", (weight() if callable(weight) else weight).cast("double")))


def compact(factor: Factor) -> DataFrame:
    """The factor's rows with ``param_id``, one for each distinct weight, and ``uses``, its number of rows."""
    params = factor.nonzero().groupBy("w").agg(F.count(F.lit(1)).alias("uses"))
    numbered = params.withColumn("param_id", F.row_number().over(Window.orderBy("w")) - 1)  # distinct weights
    return factor.nonzero().join(numbered, "w").select(*factor.scope, "w", "param_id", "uses")


def clause(spark: SparkSession, variables: Sequence[Variable], states: Sequence[int], weight: float = 1.0) -> Factor:
    """``weight`` where any variable has its state."""
    met = reduce(lambda a, b: a | b, (F.col(v.name) == s for v, s in zip(variables, states)))
    return Factor(tuple(variables), _space(spark, variables).where(met).withColumn("w", F.lit(float(weight))))


def implies(spark: SparkSession, a: Variable, a_states: Sequence[int], b: Variable, b_states: Sequence[int]) -> Factor:
    """1 where ``a`` in its states implies ``b`` in its."""
    met = ~F.col(a.name).isin(*a_states) | F.col(b.name).isin(*b_states)
    return Factor((a, b), _space(spark, [a, b]).where(met).withColumn("w", F.lit(1.0)))


def equivalent(spark: SparkSession, a: Variable, a_states: Sequence[int], b: Variable, b_states: Sequence[int]) -> Factor:
    """1 where ``a`` in its states if and only if ``b`` in its."""
    met = F.col(a.name).isin(*a_states) == F.col(b.name).isin(*b_states)
    return Factor((a, b), _space(spark, [a, b]).where(met).withColumn("w", F.lit(1.0)))


def functional(spark: SparkSession, result: Variable, inputs: Sequence[Variable], function: Callable[..., Column]) -> Factor:
    """1 where ``result`` is the function, a column expression, of the inputs."""
    table = _space(spark, inputs).withColumn(result.name, function(*(F.col(v.name) for v in inputs)).cast("int"))
    return Factor((result, *inputs), table.select(result.name, *(v.name for v in inputs), F.lit(1.0).alias("w")))


def normalised(factor: Factor, by: Sequence[str]) -> Factor:
    """Weights divided by their sum within each group; groups without weight disappear."""
    sums = factor.table.groupBy(*by).agg(F.sum("w").alias("_sum"))
    joined = factor.table.join(sums, list(by)) if by else factor.table.crossJoin(F.broadcast(sums))  # one row
    return Factor(factor.variables, joined.where(F.col("_sum") > 0).withColumn("w", F.col("w") / F.col("_sum")).select(*factor.scope, "w"))


def cpt(factor: Factor, rows: DataFrame | None = None) -> Factor:
    """The factor as a conditional table of its first variable, normalised for each parent instance."""
    return normalised(Factor(factor.variables, rows) if rows is not None else factor, factor.scope[1:])


def invalid_parents(factor: Factor, tolerance: float = TOLERANCE) -> DataFrame:
    """Parent instances whose weights sum neither to 0 nor to 1; none for a conditional table."""
    sums = factor.table.groupBy(*factor.scope[1:]).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"))
    return sums.where((F.abs(F.col("total")) > tolerance) & (F.abs(F.col("total") - 1) > tolerance))


def is_cpt(factor: Factor, tolerance: float = TOLERANCE) -> bool:
    return invalid_parents(factor, tolerance).isEmpty()


def structure_is_bayesian(model: Model) -> bool:
    """One factor per variable, each the child of one, and no cycle."""
    children = [f.scope[0] for f in model.factors]
    if sorted(children) != sorted(v.name for v in model.variables):
        return False
    left = {f.scope[0]: set(f.scope[1:]) for f in model.factors}
    while left:
        free = [v for v, parents in left.items() if not parents & left.keys()]
        if not free:
            return False
        for v in free:
            del left[v]
    return True


def is_bayesian(model: Model, tolerance: float = TOLERANCE) -> bool:
    return structure_is_bayesian(model) and all(is_cpt(f, tolerance) for f in model.factors)


def markov_blanket(model: Model, name: str) -> set[str]:
    """All variables that share a factor with the variable."""
    return {v for f in model.factors if name in f.scope for v in f.scope} - {name}


def reduce_rows(factors: Sequence[Factor]) -> list[Factor]:
    """The factors without rows that can't join another factor's rows, by semi-joins between pairs that share variables."""
    tables = [f.nonzero() for f in factors]
    for i, f in enumerate(factors):
        for j, g in enumerate(factors):
            shared = [v for v in f.scope if v in g.scope]
            if i != j and shared:
                tables[i] = tables[i].join(tables[j].select(*shared).distinct(), shared, "left_semi")
    return [Factor(f.variables, t.select(*f.scope, "w")) for f, t in zip(factors, tables)]
