"""Learning conditional tables and network structure from data and from cross-tables."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Variable, state_space
from marginalia.folders import written
from marginalia.operators.crosstab import WEIGHT, add, conditional, cross_table, cross_tables, project, summed
from marginalia.operators.factors import Factor, Model, structure_is_bayesian
from marginalia.operators.evidence import expand

Structure = Mapping[str, Sequence[str]]  # child -> parents


def network_counts(data: DataFrame, structure: Structure, weight: str | None = None) -> DataFrame:
    """The cross-tables of all families ``child, parents`` from one scan, with ``child`` naming the family."""
    families = [[c, *ps] for c, ps in structure.items()]
    counted = cross_tables(data, families, weight)
    labels = F.element_at(F.array(*(F.lit(c) for c in structure)), F.col("scope") + 1)
    return counted.withColumn("child", labels).drop("scope")


def cpt_table(data: DataFrame, child: Variable, parents: Sequence[Variable], weight: str | None = None, prior: float | DataFrame = 0) -> DataFrame:
    """``child, parents, w``: the conditional table of one family; parents never seen have no rows unless a prior gives them."""
    counts = cross_table(data, [child, *parents], weight, prior)
    return conditional(counts, [p.name for p in parents]).select(child.name, *(p.name for p in parents), "w")


def train(data: DataFrame, variables: Sequence[Variable], structure: Structure, weight: str | None = None, priors: float | Mapping[str, float | DataFrame] = 0) -> Model:
    """A Bayesian network with the structure and the most likely, or with priors the posterior, conditional tables.

    All families are counted in one scan; a prior adds its weight to every
    instance of a family. Vectors as evidence have to be expanded before.
    """
    by_name = {v.name: v for v in variables}
    counted = network_counts(data, structure, weight)
    if len(structure) > 1:
        counted = written(counted, "families")  # counted once; as small as the state spaces
    factors = []
    for child, parents in structure.items():
        family = [by_name[child], *(by_name[p] for p in parents)]
        counts = counted.where(F.col("child") == child).select(*(v.name for v in family), WEIGHT)
        prior = priors.get(child, 0) if isinstance(priors, Mapping) else priors
        if isinstance(prior, DataFrame):
            counts = add(counts, prior)
        elif prior:
            counts = add(counts, state_space(data.sparkSession, family).withColumn(WEIGHT, F.lit(float(prior))))
        table = conditional(counts, list(parents)).select(*(v.name for v in family), "w")
        factors.append(Factor(tuple(family), table))
    model = Model(tuple(variables), tuple(factors))
    if not structure_is_bayesian(model):
        raise ValueError("the structure is not that of a Bayesian network")
    return model


def train_soft(data: DataFrame, variables: Sequence[Variable], structure: Structure, priors: float | Mapping[str, float] = 0) -> Model:
    """The same from soft evidence: every row is expanded to the instances it supports."""
    return train(expand(data, variables), variables, structure, WEIGHT, priors)


def function_kind(rows: int, space: int) -> str:
    """How a learned table would be held: none, all instances, or only those with weight."""
    return "zero" if rows == 0 else "dense" if rows < 100 or rows > 0.9 * space else "sparse"


def structure_of_tables(tables: Sequence[Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """A structure whose families lie within the tables' variables.

    Variables are taken by the number of tables that have them, most first, and
    each gets the parents of the table that holds most of those taken before.
    """
    often: dict[str, int] = {}
    for t in tables:
        for v in t:
            often[v] = often.get(v, 0) + 1
    found: dict[str, tuple[str, ...]] = {}
    for v in sorted(often, key=lambda x: (-often[x], x)):
        homes = [tuple(x for x in t if x in found) for t in tables if v in t]
        found[v] = max(homes, key=len)
    return found


def network_from_tables(spark: SparkSession, tables: Sequence[DataFrame], variables: Sequence[Variable], method: str = "sum") -> Model:
    """A Bayesian network from marginal cross-tables.

    ``first`` takes each family from the first table that holds it, ``sum``
    adds up all that do, ``all`` adds the normalised tables.
    """
    if method not in ("first", "sum", "all"):
        raise ValueError(f"unknown method {method}")
    by_name = {v.name: v for v in variables}
    scopes = [[c for c in t.columns if c != WEIGHT] for t in tables]
    factors = []
    for child, parents in structure_of_tables(scopes).items():
        family = [child, *parents]
        having = [project(t, family) for t, s in zip(tables, scopes) if set(family) <= set(s)]
        if method == "first":
            counts = having[0]
        else:
            if method == "all":
                having = [t.crossJoin(F.broadcast(t.agg(F.sum(WEIGHT).alias("_z")))).withColumn(WEIGHT, F.col(WEIGHT) / F.col("_z")).drop("_z") for t in having]  # one row
            counts = add(having[0], *having[1:])
        factors.append(Factor(tuple(by_name[v] for v in family), conditional(counts, list(parents)).select(*family, "w")))
    return Model(tuple(variables), tuple(factors))


def coalesce_tables(tables: Sequence[DataFrame], variables: Sequence[Variable], rounds: int = 1000, tolerance: float = 1e-6, change: float = 1e-12) -> DataFrame:
    """One table over all variables whose projections fit the given tables, in proportion.

    Minimises the squared distance between the projections and the normalised
    tables over non-negative weights by multiplicative updates, each a join
    and an aggregate per table: a weight is multiplied by the sum of its
    targets over the sum of its projections. Instances start out equal. Rounds
    go on until the largest difference of a projection is below ``tolerance``
    or falls by less than ``change``; after ``rounds`` there is a warning. The
    given tables are written once, so what they come from is not read again.
    """
    spark = tables[0].sparkSession
    names = [v.name for v in variables]
    targets = []
    for t in tables:
        scope = [c for c in t.columns if c != WEIGHT]
        t = written(t, "targets")
        z = t.agg(F.sum(WEIGHT).alias("_z"))
        targets.append((scope, t.crossJoin(F.broadcast(z)).select(*scope, (F.col(WEIGHT) / F.col("_z")).alias("_b"))))  # one row
    a = state_space(spark, variables).withColumn(WEIGHT, F.lit(1.0))
    for scope, t in targets:  # only instances that every table supports can have weight
        a = a.join(t.where(F.col("_b") > 0).select(*scope), scope, "left_semi")
    n = a.agg(F.count(F.lit(1)).alias("_n"))
    a = a.crossJoin(F.broadcast(n)).select(*names, (F.lit(1.0) / F.col("_n")).alias(WEIGHT))
    last = float("inf")
    for _ in range(rounds):
        num, den, rows = F.lit(0.0), F.lit(0.0), a
        for j, (scope, t) in enumerate(targets):
            sums = summed(a, scope).withColumnRenamed(WEIGHT, f"_p{j}").join(t.withColumnRenamed("_b", f"_b{j}"), scope)
            rows = rows.join(sums, scope)
            num, den = num + F.col(f"_b{j}"), den + F.col(f"_p{j}")
        worst = F.greatest(*(F.abs(F.col(f"_b{j}") - F.col(f"_p{j}")) for j in range(len(targets))), F.lit(0.0))
        rows = written(rows.select(*names, (F.col(WEIGHT) * num / den).alias(WEIGHT), worst.alias("_worst")), "coalesced")
        error = rows.agg(F.max("_worst").alias("e")).first()["e"] or 0.0  # of the weights before this round
        a = rows.select(*names, WEIGHT)
        if error < tolerance or abs(last - error) < change:
            break
        last = error
    else:
        warnings.warn(f"projections still differ by up to {error:.3g} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return a


class Incidence:
    """The sums that cross-tables ask of the weights of instances: a sparse matrix, as joins and aggregates.

    A row of the matrix is an instance of one table, a column an instance of
    all variables that every table supports; an entry is 1 where the second
    projects onto the first. Vectors over columns are columns of a DataFrame of
    instances, and those over rows a DataFrame for each table. Each step is
    written, so no plan grows.
    """

    def __init__(self, tables: Sequence[DataFrame], variables: Sequence[Variable]):
        self.names = [v.name for v in variables]
        self.targets: list[tuple[list[str], DataFrame]] = []
        for t in tables:
            scope = [c for c in t.columns if c != WEIGHT]
            z = t.agg(F.sum(WEIGHT).alias("_z"))
            self.targets.append((scope, t.where(F.col(WEIGHT) > 0).crossJoin(F.broadcast(z)).select(*scope, (F.col(WEIGHT) / F.col("_z")).alias("_b"))))  # one row
        a = state_space(tables[0].sparkSession, variables)
        for scope, t in self.targets:
            a = a.join(t.select(*scope), scope, "left_semi")
        self.instances = written(a, "instances")
        self.targets = [(scope, written(t, "targets")) for scope, t in self.targets]

    def sums(self, x: DataFrame, column: str) -> list[DataFrame]:
        """The matrix times a vector: for each table its instances, with ``_b`` and the sum ``_s``."""
        return [t.join(x.groupBy(*scope).agg(F.sum(column).alias("_s")), scope, "left").withColumn("_s", F.coalesce("_s", F.lit(0.0))) for scope, t in self.targets]

    def spread(self, x: DataFrame, rows: Sequence[DataFrame], column: str, mean: bool = False) -> DataFrame:
        """``x`` with ``_s``: the transposed matrix times a vector, or its mean over the tables."""
        for j, ((scope, _), r) in enumerate(zip(self.targets, rows)):
            x = x.join(r.select(*scope, F.col(column).alias(f"_s{j}")), scope)
        columns = [F.col(f"_s{j}") for j in range(len(rows))]
        return x.withColumn("_s", reduce(lambda a, b: a + b, columns) / (len(rows) if mean else 1)).drop(*(f"_s{j}" for j in range(len(rows))))


def misfit(result: DataFrame, tables: Sequence[DataFrame], variables: Sequence[Variable]) -> DataFrame:
    """``squared, absolute, largest``: how the projections of a table differ from the given ones, in proportion."""
    parts = [(F.col("_b") - F.col("_s")).alias("_e")]
    z = result.agg(F.sum(WEIGHT).alias("_z"))
    share = result.crossJoin(F.broadcast(z)).withColumn(WEIGHT, F.col(WEIGHT) / F.col("_z")).drop("_z")  # one row
    rows = reduce(DataFrame.unionByName, (r.select(*parts) for r in Incidence(tables, variables).sums(share, WEIGHT)))
    return rows.agg(F.sum(F.col("_e") * F.col("_e")).alias("squared"), F.sum(F.abs("_e")).alias("absolute"), F.max(F.abs("_e")).alias("largest"))


def _norm(parts: Sequence[DataFrame], column: str) -> float:
    squares = reduce(DataFrame.unionByName, (p.select((F.col(column) * F.col(column)).alias("_q")) for p in parts))
    return float(squares.agg(F.coalesce(F.sum("_q"), F.lit(0.0)).alias("_q")).first()["_q"]) ** 0.5


def least_squares_tables(tables: Sequence[DataFrame], variables: Sequence[Variable], rounds: int = 100, tolerance: float = 1e-9, shift: bool = True) -> DataFrame:
    """One table over all variables by least squares, the smallest among the best; consistent or not.

    LSQR (Paige and Saunders 1982) on :class:`Incidence`: two joins and an
    aggregate for each table and round, and two numbers to the driver. Ends when
    the gradient or the residual is below ``tolerance`` in proportion. Weights
    may come out negative; ``shift`` then raises all by the least one, which
    keeps them in proportion of their differences but adds to the residual.
    """
    m = Incidence(tables, variables)
    u = [t.withColumn("_u", F.col("_b")) for _, t in m.targets]
    beta = _norm(u, "_u")
    size = beta
    u = [t.withColumn("_u", F.col("_u") / beta) for t in u]
    x = written(m.spread(m.instances, u, "_u").withColumnRenamed("_s", "_v"), "lsqr")
    alpha = _norm([x], "_v")
    if not alpha:
        return x.select(*m.names, F.lit(0.0).alias(WEIGHT))
    x = x.select(*m.names, (F.col("_v") / alpha).alias("_v"), (F.col("_v") / alpha).alias("_w"), F.lit(0.0).alias("_x"))
    phi, rho = beta, alpha
    for _ in range(rounds):
        # the next pair of the bidiagonal form
        u = [written(r.join(old.select(*scope, "_u"), scope).withColumn("_u", F.col("_s") - alpha * F.col("_u")).select(*scope, "_b", "_u"), "lsqr-u") for (scope, _), r, old in zip(m.targets, m.sums(x, "_v"), u)]
        beta = _norm(u, "_u")
        if beta > 1e-14 * size:
            u = [t.withColumn("_u", F.col("_u") / beta) for t in u]
            x = written(m.spread(x, u, "_u").withColumn("_v", F.col("_s") - beta * F.col("_v")).drop("_s"), "lsqr")
            alpha = _norm([x], "_v")
        else:
            beta = alpha = 0.0
        if alpha:
            x = x.withColumn("_v", F.col("_v") / alpha)
        # the rotation that keeps it upper bidiagonal, and the step it gives
        length = (rho * rho + beta * beta) ** 0.5
        c, s = rho / length, beta / length
        theta, rho, step, phi = s * alpha, -c * alpha, c * phi, s * phi
        x = x.withColumn("_x", F.col("_x") + step / length * F.col("_w")).withColumn("_w", F.col("_v") - theta / length * F.col("_w"))
        if phi < tolerance * size or abs(phi * alpha * c) < tolerance * size or not alpha:
            break
    if shift:
        least = x.agg(F.least(F.min("_x"), F.lit(0.0)).alias("_least"))
        x = x.crossJoin(F.broadcast(least)).withColumn("_x", F.col("_x") - F.col("_least"))  # one row
    return written(x.select(*m.names, F.col("_x").alias(WEIGHT)), "least-squares")


def split_and_mean_tables(tables: Sequence[DataFrame], variables: Sequence[Variable], start: DataFrame | None = None, rounds: int = 100, tolerance: float = 1e-6, change: float = 1e-12) -> DataFrame:
    """One table over all variables, without negative weights, by splitting and averaging.

    Every instance of a table splits what it lacks evenly among the instances
    that project onto it; an instance's weight becomes the mean of what the
    tables give it, and at least 0. Begins with even splits, or with ``start``
    such as the result of :func:`least_squares_tables`. Ends when the absolute
    differences of all projections sum to ``tolerance`` at most, or the sum
    changes by ``change`` at most, or after ``rounds``; :func:`misfit` tells
    what is left.
    """
    m = Incidence(tables, variables)
    sizes = m.instances.withColumn("_one", F.lit(1.0))
    share = [written(r.withColumnRenamed("_s", "_n"), "shares") for r in m.sums(sizes, "_one")]
    if start is None:
        first = [r.withColumn("_d", F.col("_b") / F.col("_n")) for r in share]
        x = m.spread(m.instances, first, "_d", mean=True).withColumnRenamed("_s", "_x")
    else:
        x = m.instances.join(start.select(*m.names, F.col(WEIGHT).alias("_x")), m.names, "left").withColumn("_x", F.greatest(F.coalesce("_x", F.lit(0.0)), F.lit(0.0)))
    x, last = written(x, "split-mean"), 0.0
    for _ in range(rounds):
        lacks = [written(r.join(n.select(*scope, "_n"), scope).withColumn("_e", F.abs(F.col("_b") - F.col("_s"))).withColumn("_d", (F.col("_b") - F.col("_s")) / F.col("_n")), "lacks") for (scope, _), r, n in zip(m.targets, m.sums(x, "_x"), share)]
        error = float(reduce(DataFrame.unionByName, (r.select("_e") for r in lacks)).agg(F.coalesce(F.sum("_e"), F.lit(0.0)).alias("_e")).first()["_e"])
        if error <= tolerance or abs(error - last) <= change:
            break
        last = error
        x = written(m.spread(x, lacks, "_d", mean=True).select(*m.names, F.greatest(F.col("_x") + F.col("_s"), F.lit(0.0)).alias("_x")), "split-mean")
    return x.select(*m.names, F.col("_x").alias(WEIGHT))


def log_likelihood(model: Model, data: DataFrame) -> DataFrame:
    """``log2_likelihood``: the summed log2 weight of the rows; NaN where a row has none."""
    rows = data
    terms = []
    for k, f in enumerate(model.factors):
        rows = rows.join(f.table.withColumnRenamed("w", f"_w{k}"), list(f.scope), "left")
        terms.append(F.col(f"_w{k}"))
    weight = reduce(lambda x, y: x * y, (F.coalesce(t, F.lit(0.0)) for t in terms))
    return rows.agg(F.sum(F.when(weight > 0, F.log2(weight)).otherwise(F.lit(float("nan")))).alias("log2_likelihood"))
