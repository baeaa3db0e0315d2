"""Queries on factor models as joins with the aggregates pushed between them.

Multiplying two factors is a join on their common variables; summing a variable
out is a ``groupBy`` over the rest. Evidence is a filter on every factor that
has the variable, so it reaches the scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.catalog import Condition, condition, holds, state_space
from marginalia.folders import written
from marginalia.functions.scalar import ratio
from marginalia.operators.crosstab import WEIGHT
from marginalia.operators.factors import Model
from marginalia.operators.space import ProbabilitySpace, Space
from marginalia.plans.elimination import Planner, best_order, join_tree, maximal_tree, planned
from marginalia.plans.products import Tree, best_tree


@dataclass(frozen=True)
class Semiring:
    """How weights are added up and multiplied."""

    add: Callable[[str], Column]
    mul: Callable[[Column, Column], Column]
    zero: object
    one: object


SEMIRINGS = {
    "sum_product": Semiring(F.sum, lambda a, b: a * b, 0.0, 1.0),
    "max_product": Semiring(F.max, lambda a, b: a * b, 0.0, 1.0),
    "max_sum": Semiring(F.max, lambda a, b: a + b, float("-inf"), 0.0),
    "max_min": Semiring(F.max, F.least, float("-inf"), float("inf")),
    "or_and": Semiring(F.bool_or, lambda a, b: a & b, False, True),
    "xor_and": Semiring(F.bit_xor, lambda a, b: a.bitwiseAND(b), 0, 1),
}
SUM_PRODUCT = SEMIRINGS["sum_product"]
Table = tuple[tuple[str, ...], DataFrame]


def product(a: Table, b: Table, ring: Semiring = SUM_PRODUCT) -> Table:
    """The join of two tables with their weights multiplied; of tables without common variables all pairs, which elimination avoids."""
    (sa, ta), (sb, tb) = a, b
    shared = [v for v in sa if v in sb]
    tb = tb.withColumnRenamed("w", "_w")
    joined = ta.join(tb, shared) if shared else ta.join(tb, F.lit(True))
    scope = (*sa, *(v for v in sb if v not in sa))
    return scope, joined.select(*scope, ring.mul(F.col("w"), F.col("_w")).alias("w"))


def sum_out(t: Table, variables: Sequence[str], ring: Semiring = SUM_PRODUCT) -> Table:
    rest = tuple(v for v in t[0] if v not in variables)
    return rest, t[1].groupBy(*rest).agg(ring.add("w").alias("w"))


def tables(model: Model, cond: Condition | None = None, skip: Sequence[int] = (), ring: Semiring = SUM_PRODUCT) -> list[Table]:
    """The factors' rows under the condition that are not the ring's zero, and a table of its ones for variables that no factor has."""
    cond = condition(cond)
    spark = model.factors[0].table.sparkSession if model.factors else None
    found = [(f.scope, f.table.where(F.col("w") != F.lit(ring.zero))) for k, f in enumerate(model.factors) if k not in skip]
    for v in model.variables:
        if spark is not None and not any(v.name in s for s, _ in found):
            found.append(((v.name,), state_space(spark, [v]).withColumn("w", F.lit(ring.one))))
    return [(s, t.where(holds({k: v for k, v in cond.items() if k in s}))) for s, t in found]


def eliminate(parts: Sequence[Table], sizes: Mapping[str, int], keep: Sequence[str] = (), ring: Semiring = SUM_PRODUCT, order: Sequence[str] | Planner | None = None, trees: bool = False) -> Table:
    """All variables summed out but the kept ones, in the given order, that of a planner, or the best one.

    The tables that a variable is in are joined smallest first, or by the best
    of the binary trees (see :func:`best_tree`), which sums variables out
    between the joins.
    """
    parts = list(parts)
    if callable(order):
        order = planned([s for s, _ in parts], sizes, order, keep=keep)
    order = [v for v in order if v not in keep] if order is not None else best_order([s for s, _ in parts], sizes, keep)
    for v in order:
        mine = sorted((p for p in parts if v in p[0]), key=lambda p: reduce(lambda n, x: n * sizes[x], p[0], 1))
        if trees and mine:
            parts = [p for p in parts if v not in p[0]]
            outside = {x for s, _ in parts for x in s} | set(keep)
            tree, _ = best_tree([s for s, _ in mine], sizes, outside)
            parts.append(along(tree, mine, outside, ring))
        elif mine:
            parts = [p for p in parts if v not in p[0]]
            parts.append(sum_out(reduce(lambda a, b: product(a, b, ring), mine), [v], ring))
    scope, table = reduce(lambda a, b: product(a, b, ring), parts)
    if len(parts) == 1 and set(scope) == set(keep):
        return sum_out((scope, table), [], ring)
    return scope, table


def along(tree: Tree, parts: Sequence[Table], keep: Iterable[str], ring: Semiring = SUM_PRODUCT) -> Table:
    """The product of tables in the order of a tree; a variable that neither ``keep`` nor a table still to come has is summed out at once."""
    keep = set(keep)

    def leaves(t: Tree) -> list[int]:
        return [t] if isinstance(t, int) else [x for side in t for x in leaves(side)]

    def joined(t: Tree, needed: set[str]) -> Table:
        if isinstance(t, int):
            return parts[t]
        found = product(*(joined(side, needed | {v for k in leaves(other) for v in parts[k][0]}) for side, other in (t, t[::-1])), ring)
        gone = [v for v in found[0] if v not in needed]
        return sum_out(found, gone, ring) if gone else found

    scope, table = joined(tree, keep)
    gone = [v for v in scope if v not in keep]
    return sum_out((scope, table), gone, ring) if gone else (scope, table)


def wmc(model: Model, cond: Condition | None = None, ring: Semiring = SUM_PRODUCT, order: Sequence[str] | Planner | None = None) -> DataFrame:
    """``wmc``: the weight of all instances that meet the condition."""
    _, table = eliminate(tables(model, cond, ring=ring), model.sizes, (), ring, order)
    return table.agg(F.coalesce(ring.add("w"), F.lit(ring.zero)).alias("wmc"))


def marginal(model: Model, variables: Sequence[str], cond: Condition | None = None, trees: bool = False) -> DataFrame:
    """``p`` of every instance of the variables that has weight; ``trees`` as for :func:`eliminate`."""
    _, table = eliminate(tables(model, cond), model.sizes, variables, trees=trees)
    table = table.select(*variables, "w")
    z = table.agg(F.sum("w").alias("_z"))
    return table.crossJoin(F.broadcast(z)).select(*variables, ratio(F.col("w"), F.col("_z")).alias("p"))  # z is one row


def space(model: Model, variables: Sequence[str], cond: Condition | None = None) -> Space:
    """The joint distribution of some variables as a probability space, for all its measures."""
    return Space(marginal(model, variables, cond).withColumnRenamed("p", "weight"))


class ModelSpace(ProbabilitySpace):
    """A model as a probability space: each question is an elimination that keeps the given variables and has the condition in its scans."""

    def __init__(self, model: Model, variables: Sequence[str]):
        self.model, self.variables = model, list(variables)

    def given(self, cond: Condition | None = None) -> DataFrame:
        _, table = eliminate(tables(self.model, cond), self.model.sizes, self.variables)
        return table.select(*self.variables, F.col("w").alias(WEIGHT))


def probability(model: Model, event: Condition, cond: Condition | None = None) -> DataFrame:
    """``p`` of the event under the condition, from one elimination that keeps the event's variables."""
    event = condition(event)
    _, table = eliminate(tables(model, cond), model.sizes, list(event))
    hit = F.coalesce(F.sum(F.when(holds(event), F.col("w"))), F.lit(0.0))
    return table.agg(ratio(hit, F.coalesce(F.sum("w"), F.lit(0.0))).alias("p"))


@dataclass(frozen=True)
class Messages:
    """A join tree with its tables and all messages up and down; each is a table with the number of joins in its plan."""

    clusters: list[frozenset]
    parents: list[int | None]
    home: list[list[int]]  # the numbers of the tables each cluster has
    parts: list[Table]
    up: dict[int, tuple[Table, int]]
    down: dict[int, tuple[Table, int]]

    def around(self, cluster: int, without: int | None = None) -> tuple[Table, int]:
        """The product of a cluster's tables, but one, and of all that comes in: the model summed over all variables outside."""
        own = [(self.parts[k], 0) for k in self.home[cluster] if k != without]
        return _times([*own, *(self.up[c] for c, p in enumerate(self.parents) if p == cluster), self.down[cluster]])

    def cluster_of(self, variable: str) -> int:
        """The largest cluster with the variable, as it serves most variables."""
        return max((k for k, c in enumerate(self.clusters) if variable in c), key=lambda k: (len(self.clusters[k]), k))


def _times(found: Sequence[tuple[Table, int]]) -> tuple[Table, int]:
    return reduce(product, (t for t, _ in found)), sum(n for _, n in found) + len(found) - 1


def _kept(scope: tuple[str, ...], rows: DataFrame, joins: int, most_joins: int) -> tuple[Table, int]:
    """The table, written if its plan has more than ``most_joins`` joins."""
    return ((scope, written(rows, "message")), 0) if joins > most_joins else ((scope, rows), joins)


def messages(parts: Sequence[Table], sizes: Mapping[str, int], most_joins: int = 8, maximal: bool = False) -> Messages:
    """One pass up and one down a join tree, of all clusters of an elimination or of the ``maximal`` ones alone. A message whose plan has come to more than ``most_joins`` joins is written, so plans stay small."""
    parts = list(parts)
    clusters, parents = join_tree([s for s, _ in parts], sizes)
    if maximal:  # with parents after their children
        found, above = maximal_tree([s for s, _ in parts], sizes)
        last = len(found) - 1
        clusters, parents = found[::-1], [None if p is None else last - p for p in above[::-1]]
    home: list[list[int]] = [[] for _ in clusters]
    for k, part in enumerate(parts):
        home[next(c for c, vs in enumerate(clusters) if set(part[0]) <= vs)].append(k)
    spark = parts[0][1].sparkSession
    one: tuple[Table, int] = (((), spark.range(1).select(F.lit(1.0).alias("w"))), 0)

    def message(found: Sequence[tuple[Table, int]], keep: frozenset) -> tuple[Table, int]:
        if not found:
            return one
        t, joins = _times(found)
        scope, rows = sum_out(t, [v for v in t[0] if v not in keep])
        return _kept(scope, rows, joins, most_joins)

    children: list[list[int]] = [[] for _ in clusters]
    for c, p in enumerate(parents):
        if p is not None:
            children[p].append(c)
    up: dict[int, tuple[Table, int]] = {}
    for c, p in enumerate(parents):
        up[c] = message([*((parts[k], 0) for k in home[c]), *(up[k] for k in children[c])], clusters[p] if p is not None else frozenset())
    down: dict[int, tuple[Table, int]] = {}
    roots = [c for c, p in enumerate(parents) if p is None]
    for c in reversed(range(len(clusters))):
        p = parents[c]
        others = [up[r] for r in roots if r != c] if p is None else [*((parts[k], 0) for k in home[p]), *(up[k] for k in children[p] if k != c), down[p]]
        down[c] = message(others, clusters[c])
    return Messages(clusters, parents, home, parts, up, down)


def _gathered(found: Iterable[tuple[DataFrame, int]], most_joins: int, name: str) -> DataFrame:
    """The union of tables given with the joins in their plans; parts of it are written once they have come to many."""
    done, now, joins = [], None, 0
    for rows, n in found:
        now, joins = rows if now is None else now.unionByName(rows), joins + n
        if joins > 4 * most_joins:
            done.append(written(now, name))
            now, joins = None, 0
    return reduce(DataFrame.unionByName, [*done, *([] if now is None else [now])])


def _state_sums(passed: Messages, variables: Sequence[str], most_joins: int) -> DataFrame:
    """``variable, state, w`` of variables, from one product for each cluster that serves some."""
    wanted: dict[int, list[str]] = {}
    for v in variables:
        wanted.setdefault(passed.cluster_of(v), []).append(v)

    def sums():
        for c, mine in wanted.items():
            (_, belief), n = passed.around(c)
            each = F.inline(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("state")) for v in mine)))
            yield belief.select(each, "w").groupBy("variable", "state").agg(F.sum("w").alias("w")), n

    return _gathered(sums(), most_joins, "marginals")


def all_marginals(model: Model, cond: Condition | None = None, most_joins: int = 8, maximal: bool = False) -> DataFrame:
    """``variable, state, p`` for every variable, from one pass up and one down a join tree.

    Large messages and sums are written (see :func:`messages`), so plans stay
    small however large the model is. With ``maximal`` clusters there are fewer
    messages, and so fewer exchanges.
    """
    found = _state_sums(messages(tables(model, cond), model.sizes, most_joins, maximal), [v.name for v in model.variables], most_joins)
    z = found.groupBy("variable").agg(F.sum("w").alias("_z"))
    return found.join(z, "variable").select("variable", "state", ratio(F.col("w"), F.col("_z")).alias("p"))


def derivatives(model: Model, cond: Condition | None = None, most_joins: int = 8) -> tuple[DataFrame, DataFrame]:
    """All first derivatives of the weight under a condition, from one pass up and down a join tree.

    The first table, ``factor, states, d``, is by the parameter of each row of
    each factor; the second, ``variable, state, d``, by the indicator of each
    state: what the weight would be if the variable had that state, and the
    rest of the condition held. States that the condition rules out have one
    too. A variable's condition is a table of its own in the tree, so leaving
    it out is leaving out one table of a product.
    """
    cond = condition(cond)
    spark = model.factors[0].table.sparkSession
    parts = tables(model)
    # factors come first in ``parts``, in their order; then variables that no factor has, and the conditions
    first = len(parts)
    for v, states in cond.items():
        parts.append(((v,), state_space(spark, [model.variable(v)]).where(F.col(v).isin(*states) if states else F.lit(False)).withColumn("w", F.lit(1.0))))
    passed = messages(parts, model.sizes, most_joins)
    cluster = {k: c for c, ks in enumerate(passed.home) for k in ks}

    def by_parameter():
        for k, f in enumerate(model.factors):
            t, n = passed.around(cluster[k], k)
            scope, rest = sum_out(t, [v for v in t[0] if v not in f.scope])
            on = [v for v in f.scope if v in scope]
            rest = rest.withColumnRenamed("w", "_d")
            joined = f.table.join(rest, on, "left") if on else f.table.crossJoin(F.broadcast(rest))  # one row
            yield joined.select(F.lit(k).alias("factor"), F.array(*(F.col(v).cast("int") for v in f.scope)).alias("states"), F.coalesce("_d", F.lit(0.0)).alias("d")), n + 1

    def by_indicator():
        free = [v.name for v in model.variables if v.name not in cond]
        if free:
            yield _state_sums(passed, free, most_joins).withColumnRenamed("w", "d"), 0
        for k, v in enumerate(cond):
            (scope, t), n = passed.around(cluster[first + k], first + k)
            yield t.groupBy(F.lit(v).alias("variable"), F.col(v).alias("state")).agg(F.sum("w").alias("d")), n

    each = reduce(DataFrame.unionByName, (state_space(spark, [v]).select(F.lit(v.name).alias("variable"), F.col(v.name).alias("state")) for v in model.variables))
    indicators = each.join(_gathered(by_indicator(), most_joins, "derivatives"), ["variable", "state"], "left").select("variable", "state", F.coalesce("d", F.lit(0.0)).alias("d"))
    return _gathered(by_parameter(), most_joins, "derivatives"), indicators


def mpe(model: Model, cond: Condition | None = None, most_joins: int = 8) -> DataFrame:
    """The most probable instance and its weight ``w``, the smallest states on ties.

    Each elimination keeps, for every instance of the rest, the best state; the
    instance is then read off these tables in the opposite order. A table whose
    plan has more than ``most_joins`` joins is written, as it is read twice.
    """
    parts = [(p, 0) for p in tables(model, cond)]
    best: list[tuple[str, tuple[str, ...], DataFrame]] = []
    for v in best_order([s for (s, _), _ in parts], model.sizes):
        mine = [p for p in parts if v in p[0][0]]
        parts = [p for p in parts if v not in p[0][0]]
        (scope, t), joins = _times(mine)
        rest = tuple(x for x in scope if x != v)
        t = t.groupBy(*rest).agg(F.max("w").alias("w"), F.max_by(F.col(v), F.struct("w", -F.col(v))).alias(v))
        (_, t), joins = _kept(scope, t, joins, most_joins)
        best.append((v, rest, t.select(*rest, v)))
        parts.append(((rest, t.select(*rest, "w")), joins))
    found = reduce(product, (p for p, _ in parts))[1]
    for v, rest, t in reversed(best):
        found = found.join(t, list(rest)) if rest else found.crossJoin(F.broadcast(t))  # one row
    return found.select(*(v.name for v in model.variables), "w").where(F.col("w").isNotNull())


def gradient(model: Model, factor: int, cond: Condition | None = None, times_parameter: bool = False) -> DataFrame:
    """``d``: the derivative of the weight of all instances by each parameter of a factor, grouped by its instances."""
    f = model.factors[factor]
    scope, rest = eliminate(tables(model, cond, skip=[factor]), model.sizes, [v for v in f.scope])
    joined = f.table.join(rest.withColumnRenamed("w", "_d"), [v for v in f.scope if v in scope], "left")
    d = F.coalesce("_d", F.lit(0.0))
    return joined.select(*f.scope, (d * F.col("w") if times_parameter else d).alias("d"))


def batch_evidence(model: Model, evidence: DataFrame, observed: Sequence[str], target: str | None = None) -> DataFrame:
    """The evidence rows with ``wmc``, or with a row per state of ``target`` and ``p``.

    One elimination keeps the observed variables; every row of evidence is then
    a join away. Rows hold state indexes; nulls are not observed. The patterns
    of observed variables that occur, not all ``2 ** len(observed)``, are
    grouping sets of one scan of the message. Its groups hold the weights of all
    states of the target, so evidence rows, repeated ones too, are not shuffled
    to normalise them; states of probability 0 have rows as well. Evidence
    without weight has ``wmc`` 0, or one row with a null state and NaN.
    """
    keep = [*observed, *([target] if target else [])]
    _, message = eliminate(tables(model), model.sizes, keep)
    bits = (F.when(F.col(v).isNotNull(), F.lit(1 << k).cast("long")).otherwise(0) for k, v in enumerate(observed))
    rows = evidence.withColumn("_pattern", reduce(lambda a, b: a + b, bits, F.lit(0).cast("long")))
    patterns = sorted(r["_pattern"] for r in rows.select("_pattern").distinct().collect())  # one row for each pattern
    if not patterns:  # no evidence
        out = rows.drop("_pattern")
        return out.select("*", F.lit(None).cast("int").alias(target), F.lit(None).cast("double").alias("p")) if target else out.withColumn("wmc", F.lit(0.0))
    sets = [[F.col(v) for k, v in enumerate(observed) if m >> k & 1] + ([F.col(target)] if target else []) for m in patterns]
    grouped = message.groupingSets(sets, *(F.col(v) for v in keep)) if keep else message.groupBy()
    of = reduce(lambda a, b: a + b, ((1 - F.grouping(v)).cast("long") * (1 << k) for k, v in enumerate(observed)), F.lit(0).cast("long"))
    sums = grouped.agg(F.sum("w").alias("_w"), *([of.alias("_p")] if observed else [])).where(F.col("_w").isNotNull())
    sums = sums.select(*(F.col(v).alias(f"_e_{v}") for v in observed), (F.col("_p") if observed else F.lit(0).cast("long")).alias("_p"), *([F.col(target).alias("_target")] if target else []), "_w")
    if target:
        each = F.map_from_entries(F.collect_list(F.struct("_target", "_w")))  # the states of one variable
        sums = sums.groupBy("_p", *(f"_e_{v}" for v in observed)).agg(each.alias("_each"), F.sum("_w").alias("_w")).where(F.col("_w") > 0)
    match = reduce(lambda a, b: a & b, (F.coalesce(rows[v], F.lit(-1)) == F.coalesce(sums[f"_e_{v}"], F.lit(-1)) for v in observed), rows["_pattern"] == sums["_p"])
    joined = rows.join(sums, match, "left")
    if not target:
        return joined.select(*evidence.columns, F.coalesce("_w", F.lit(0.0)).alias("wmc"))
    states = F.when(F.col("_w").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(model.sizes[target] - 1)))
    spread = joined.withColumn("_state", F.explode(states))
    p = F.when(F.col("_w").isNull(), F.lit(float("nan"))).otherwise(F.coalesce(F.try_element_at("_each", F.col("_state")), F.lit(0.0)) / F.col("_w"))
    return spread.select(*evidence.columns, F.col("_state").alias(target), p.alias("p"))


def target_marginals(model: Model, target: str, cond: Condition | None = None) -> DataFrame:
    """``state, p`` of one variable under the condition, states without weight too; a condition on the target itself is left out."""
    rest = {k: v for k, v in condition(cond).items() if k != target}
    found = marginal(model, [target], rest)
    states = state_space(found.sparkSession, [model.variable(target)])
    joined = states.join(found, target, "left")
    some = F.count("p").over(Window.partitionBy())  # over the states of one variable
    return joined.select(F.col(target).alias("state"), F.when(some > 0, F.coalesce("p", F.lit(0.0))).otherwise(F.lit(float("nan"))).alias("p"))


def target_map(model: Model, target: str, cond: Condition | None = None) -> DataFrame:
    """``state, p``: the most likely state of one variable under the condition, the smallest on ties; no row without weight."""
    best = F.max_by(F.struct("state", "p"), F.struct("p", -F.col("state")))
    found = target_marginals(model, target, cond).where(~F.isnan("p")).agg(best.alias("b"))
    return found.where(F.col("b").isNotNull()).select("b.state", "b.p")


def gradients(model: Model, cond: Condition | None = None) -> DataFrame:
    """``factor, states, d``: the derivatives of the weight by the parameters of all factors."""
    return derivatives(model, cond)[0]


def wmc_by_enumeration(model: Model, cond: Condition | None = None) -> DataFrame:
    """``wmc`` from every instance that meets the condition: the plain definition, for small models and for tests of other ways."""
    spark = model.factors[0].table.sparkSession
    rows = state_space(spark, model.variables).where(holds(condition(cond)))
    weight = F.lit(1.0)
    for k, f in enumerate(model.factors):
        rows = rows.join(f.table.withColumnRenamed("w", f"_w{k}"), list(f.scope), "left")
        weight = weight * F.coalesce(F.col(f"_w{k}"), F.lit(0.0))
    return rows.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("wmc"))


def value_of(model: Model, instance: Mapping[str, int]) -> DataFrame:
    """``wmc``: the weight of one complete instance."""
    if set(instance) != set(model.sizes):
        raise ValueError("the instance has every variable of the model")
    return wmc(model, dict(instance))


def soft_evidence(model: Model, evidence: DataFrame, observed: Sequence[str], row: str, most_states: int = 100_000) -> DataFrame:
    """``row, wmc`` for evidence given as vectors of state weights.

    The message of one elimination has at most the state space of the observed
    variables. Up to ``most_states`` instances it is broadcast; a larger one
    and the evidence are shuffled. The evidence, a row for each combination of
    states, is never broadcast, however small the planner takes it for.
    """
    _, message = eliminate(tables(model), model.sizes, list(observed))
    small = reduce(lambda n, v: n * model.sizes[v], observed, 1) <= most_states
    out = evidence.select(row, *observed)
    weight = F.lit(1.0)
    for v in observed:
        out = out.select(*[c for c in out.columns if c != v], F.posexplode(v).alias(v, f"_w_{v}"))
        weight = weight * F.col(f"_w_{v}")
    return out.join(F.broadcast(message) if small else message.hint("merge"), list(observed)).groupBy(row).agg(F.sum(weight * F.col("w")).alias("wmc"))
