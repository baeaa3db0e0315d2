"""Samples as DataFrames: independent rows from ``range``, chains by ``applyInPandas``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.catalog import Condition, Variable, condition, holds
from marginalia.operators.crosstab import WEIGHT
from marginalia.operators.factors import Factor, Model
from marginalia.folders import written
from marginalia.operators.inference import eliminate, product, tables, wmc
from marginalia.plans.elimination import best_order

Draw = Callable[[int], Column]  # the uniform number of a row for the k-th variable


def random_draw(seed: int) -> Draw:
    """A number that depends on the seed, the variable and the row alone, so a repeated task draws the same."""
    return lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("row")), F.lit(1 << 53)) / F.lit(2.0**53)


def cdf(table: DataFrame, child: str, parents: Sequence[str], w: str = "w") -> DataFrame:
    """``parents, cdf``: per parent instance the states with weight and the cumulated fractions up to each."""
    one = F.sort_array(F.collect_list(F.struct(child, F.col(w).alias("w"))))  # the states of one variable
    listed = table.where(F.col(w) > 0).groupBy(*parents).agg(one.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"])
    upto = F.transform("s", lambda x, i: F.struct(x[child].alias("state"), (F.aggregate(F.slice("s", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["w"]) / total).alias("hi")))
    return listed.where(F.size("s") > 0).select(*parents, upto.alias("cdf"))


def pick(u: Column, column: str = "cdf") -> Column:
    """The first state whose cumulated fraction exceeds u; the last if rounding leaves none."""
    over = F.filter(column, lambda x: x["hi"] > u)
    return F.when(F.size(over) > 0, over[0]["state"]).otherwise(F.element_at(column, -1)["state"])


def until(n: int, propose: Callable[[int, int], DataFrame], buckets: int = 1024, most_rounds: int = 64) -> DataFrame:
    """The first ``n`` accepted rows: ``propose(start, size)`` gives those accepted among so many proposals, ``row`` their number.

    Proposals go on in rounds sized by the share accepted so far. Rows are cut
    at the ``n``-th by counts of buckets of proposals, so only one bucket is sorted.
    It is an error if ``most_rounds`` rounds do not give ``n`` rows, as where next
    to nothing is accepted or a fixed draw repeats itself.
    """
    done = 0
    start, size, got, rounds = 0, max(1000, 2 * n), 0, None
    while got < n:
        done += 1
        if done > most_rounds:
            raise RuntimeError(f"{start} proposals gave {got} of {n} rows")
        new = written(propose(start, size), "accepted")
        width = max(1, -(-size // buckets))
        counts = sorted((r["b"], r["count"]) for r in new.groupBy(F.floor((F.col("row") - start) / width).alias("b")).count().collect())  # ``buckets`` rows
        total = sum(c for _, c in counts)
        if got + total >= n:
            before = 0
            for b, c in counts:
                if got + before + c >= n:
                    break
                before += c
            low = start + b * width
            last = new.where((F.col("row") >= low) & (F.col("row") < low + width)).orderBy("row").limit(n - got - before)
            new = new.where(F.col("row") < low).unionByName(last)
        rounds = new if rounds is None else rounds.unionByName(new)
        start, got = start + size, got + total
        size = min(max(size, math.ceil(1.2 * (n - got) * start / max(got, 1))), 100 * size)
    return rounds


def forward(model: Model, n: int, draw: Draw | None = None, cond: Condition | None = None, seed: int = 1) -> DataFrame:
    """``n`` ancestral samples of a Bayesian network, ``row`` and the variables; under a condition, the first ``n`` proposals that meet it.

    Without an instance that meets the condition there are no rows.
    """
    if not cond:
        return ancestral(model, 0, n, draw or random_draw(seed))
    proposals = lambda start, size: ancestral(model, start, size, draw or random_draw(seed)).where(holds(condition(cond)))
    if n == 0 or wmc(model, cond).first()["wmc"] <= 0:
        return proposals(0, 0)
    return until(n, proposals)


def ancestral(model: Model, start: int, n: int, draw: Draw) -> DataFrame:
    """Samples ``start`` to ``start + n``, each variable given its parents."""
    rows = model.factors[0].table.sparkSession.range(start, start + n).withColumnRenamed("id", "row")
    return stepped(rows, ["row"], [(f.scope[0], f.scope[1:], cdf(f.table, f.scope[0], f.scope[1:]), k) for k, f in enumerate(families(model))], draw).select("row", *(v.name for v in model.variables))


def families(model: Model) -> list[Factor]:
    """The factors of a Bayesian network, each after those of its child's parents."""
    left, found = list(model.factors), []
    while left:
        known = {f.scope[0] for f in found}
        ready = [f for f in left if set(f.scope[1:]) <= known]
        if not ready:
            raise ValueError("the model is not a Bayesian network")
        found += ready
        left = [f for f in left if f not in ready]
    return found


Step = tuple[str, Sequence[str], DataFrame, int]  # a variable, those it depends on, its cumulated fractions given these, and the number of its draw


def stepped(rows: DataFrame, known: Sequence[str], steps: Sequence[Step], draw: Draw) -> DataFrame:
    """The rows, of which the known columns stay, with one variable drawn after the other."""
    known = list(known)
    for name, given, table, k in steps:
        joined = rows.join(table, list(given)) if given else rows.crossJoin(F.broadcast(table))  # one row
        rows = joined.withColumn("_u", draw(k)).select(*known, pick(F.col("_u")).alias(name))
        known.append(name)
    return rows


def direct(model: Model, n: int, variables: Sequence[str] | None = None, cond: Condition | None = None, draw: Draw | None = None, seed: int = 1, order: Sequence[str] | None = None, most_joins: int = 8) -> DataFrame:
    """``n`` exact samples of any model under a condition, ``row`` and the variables; no rows where nothing meets the condition.

    Variables are eliminated in the given or the best order, and each product
    met on the way is kept; then they are drawn in the opposite order, each
    given the variables it meets in its product. So no table is larger than
    those of an elimination; those whose plans have more than ``most_joins``
    joins are written. The ``k``-th variable of the model uses ``draw(k)``.
    """
    draw = draw or random_draw(seed)
    names = [v.name for v in model.variables]
    rows = model.factors[0].table.sparkSession.range(n).withColumnRenamed("id", "row")
    kept = _products(model, cond, (), order, most_joins)
    return _drawn(rows, ["row"], kept, names, draw).select("row", *(variables or names))


def _products(model: Model, cond: Condition | None, given: Sequence[str], order: Sequence[str] | None, most_joins: int) -> list[tuple[str, list[str], DataFrame]]:
    """Each variable but the given ones as it is eliminated, the others it meets then, and their product."""
    parts = tables(model, cond)
    kept, joins = [], [0] * len(parts)
    for v in order or best_order([s for s, _ in parts], model.sizes, given):
        mine = sorted((k for k, p in enumerate(parts) if v in p[0]), key=lambda k: math.prod(model.sizes[x] for x in parts[k][0]))
        scope, t = reduce(product, (parts[k] for k in mine))
        n = sum(joins[k] for k in mine) + len(mine) - 1
        if n > most_joins:  # it is read twice
            t, n = written(t, "product"), 0
        rest = [x for x in scope if x != v]
        kept.append((v, rest, t))
        left = [k for k in range(len(parts)) if k not in mine]
        parts, joins = [*(parts[k] for k in left), (tuple(rest), t.groupBy(*rest).agg(F.sum("w").alias("w")))], [*(joins[k] for k in left), n]
    return kept


def _drawn(rows: DataFrame, known: Sequence[str], kept: Sequence[tuple[str, list[str], DataFrame]], names: Sequence[str], draw: Draw) -> DataFrame:
    """The rows, of which the known columns stay, with the eliminated variables drawn in the opposite order."""
    return stepped(rows, known, [(v, rest, cdf(t, v, rest), names.index(v)) for v, rest, t in reversed(kept)], draw)


def uniform(spark: SparkSession, variables: Sequence[Variable], n: int, cond: Condition | None = None, draw: Draw | None = None, seed: int = 1, start: int = 0) -> DataFrame:
    """``n`` rows, numbered from ``start``, with every variable uniform over its allowed states."""
    return uniform_rows(spark.range(start, start + n).withColumnRenamed("id", "row"), variables, cond, draw or random_draw(seed))


def uniform_rows(rows: DataFrame, variables: Sequence[Variable], cond: Condition | None, draw: Draw) -> DataFrame:
    """The rows with every variable uniform over its allowed states."""
    cond = condition(cond)
    for k, v in enumerate(variables):
        allowed = cond.get(v.name, tuple(range(len(v))))
        if not allowed:
            raise ValueError(f"no state of {v.name} is allowed")
        rows = rows.withColumn(v.name, F.element_at(F.array(*(F.lit(s) for s in allowed)), (F.floor(draw(k) * len(allowed)) + 1).cast("int")))
    return rows


def from_table(table: DataFrame, n: int, draw: Draw | None = None, seed: int = 1) -> DataFrame:
    """``n`` instances of a cross-table, each with a probability in proportion to its weight.

    The cumulated weights go by natural order, within each state of the first
    variable and over the totals of these states, and a row meets its interval
    by an equi-join on its bucket of [0, 1).
    """
    draw = draw or random_draw(seed)
    by = [c for c in table.columns if c != WEIGHT]
    spark = table.sparkSession
    table = table.where(F.col(WEIGHT) > 0)
    firsts = table.groupBy(by[0]).agg(F.sum(WEIGHT).alias("_sum"))
    whole = Window.orderBy(by[0])  # over the states of one variable
    before = F.coalesce(F.sum("_sum").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    firsts = firsts.select(by[0], "_sum", before.alias("_before")).withColumn("_z", F.max(F.col("_before") + F.col("_sum")).over(Window.partitionBy()))
    inside = Window.partitionBy(by[0]).orderBy(*by)
    upto = (F.col("_before") + F.sum(WEIGHT).over(inside)) / F.col("_z")
    ends = F.lead(F.lit(1)).over(inside).isNull()  # a state's last interval ends where the next state's first begins
    close = F.when(F.col("_after") >= F.col("_z"), F.lit(1.0)).otherwise(F.col("_after") / F.col("_z"))
    rows = table.join(firsts.withColumn("_after", F.col("_before") + F.col("_sum")), by[0]).withColumn("_hi", F.when(ends, close).otherwise(upto))
    rows = rows.withColumn("_lo", F.coalesce(F.lag("_hi").over(inside), F.col("_before") / F.col("_z")))
    buckets = 1024
    bucket = F.explode(F.sequence(F.floor(F.greatest(F.col("_lo"), F.lit(0.0)) * buckets), F.least(F.floor(F.col("_hi") * buckets), F.lit(buckets - 1))))
    spans = rows.select(*by, "_lo", "_hi", bucket.alias("_bucket"))
    drawn = spark.range(n).withColumnRenamed("id", "row").withColumn("_u", draw(0))
    drawn = drawn.withColumn("_bucket", F.floor(F.col("_u") * buckets))
    hit = drawn.join(spans, "_bucket").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    best = hit.groupBy("row").agg(F.min_by(F.struct(*by), "_lo").alias("_i"))  # rounding can make intervals overlap
    return best.select("row", *(F.col(f"_i.{c}").alias(c) for c in by))


def rejection(model: Model, n: int, cond: Condition | None = None, seed: int = 1, draw: Draw | None = None) -> DataFrame:
    """``n`` samples: the first accepted uniform proposals, ``row`` their number; none where nothing meets the condition.

    A proposal is accepted with its weight over a bound, the product of the
    factors' largest weights under the condition, so accepted rows follow the
    model exactly. The acceptance uses the draw after those of the variables.
    """
    draw = draw or random_draw(seed)
    parts = tables(model, cond)
    spark = parts[0][1].sparkSession
    tops = [t.agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("w")).first()["w"] for _, t in parts]
    bound = math.prod(tops)

    def propose(start: int, size: int) -> DataFrame:
        rows = uniform(spark, model.variables, size, cond, draw, start=start)
        weight = F.lit(1.0)
        for k, (scope, t) in enumerate(parts):
            rows = rows.join(t.withColumnRenamed("w", f"_w{k}"), list(scope))
            weight = weight * F.col(f"_w{k}")
        accepted = rows.withColumn("_u", draw(len(model.variables))).where(F.col("_u") * bound < weight)
        return accepted.select("row", *(v.name for v in model.variables))

    if n == 0 or wmc(model, cond).first()["wmc"] <= 0:
        return propose(0, 0)
    return until(n, propose)


def markov_chains(
    model: Model, chains: int, length: int, method: str = "gibbs", cond: Condition | None = None, burn_in: int = 100, skip: int = 0, pr_restart: float = 0.0, seed: int = 1, most_cells: int = 1_000_000
) -> DataFrame:
    """``chain, step`` and the variables: ``length`` states of each of ``chains`` independent chains.

    Chains run in parallel, one group each, from exact samples as starts. The
    model's cells are broadcast and must number at most ``most_cells``; larger
    models have to use :func:`direct`. Gibbs sweeps all free variables in random
    order; Metropolis changes one at a time. Under a condition that nothing
    meets there are no chains.
    """
    if skip < 0 or burn_in < 0:
        raise ValueError("skip and burn_in are not negative")
    if method not in ("gibbs", "metropolis"):
        raise ValueError(f"unknown method {method}")
    parts = tables(model, cond)
    spark = parts[0][1].sparkSession
    names = [v.name for v in model.variables]
    cells = sum(int(np.prod([model.sizes[x] for x in s])) for s, _ in parts)
    if cells > most_cells:
        raise ValueError(f"the model has {cells} cells, over {most_cells}")
    held = []
    for scope, t in parts:
        dense = np.zeros([model.sizes[v] for v in scope])
        for r in t.select(*scope, "w").collect():  # most_cells at most
            dense[tuple(r)[:-1]] = r[-1]
        held.append(([names.index(v) for v in scope], dense))
    allowed = [list(condition(cond).get(v.name, range(len(v)))) for v in model.variables]
    shared = spark.sparkContext.broadcast(held)  # most_cells numbers
    places = list(range(len(names)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        rng = np.random.default_rng((seed, chain))
        start = [int(s) for s in pdf[names].iloc[0]]
        x = list(start)
        touching = [[f for f in shared.value if k in f[0]] for k in places]

        def weights(k):
            out = np.ones(len(allowed[k]))
            for scope, dense in touching[k]:
                at = tuple(allowed[k] if j == k else x[j] for j in scope)
                out = out * dense[at]
            return out

        def step():
            if method == "gibbs":
                for k in rng.permutation(len(names)):
                    w = weights(k)
                    x[k] = allowed[k][int(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), side="right"))]
                return
            k = int(rng.integers(len(names)))
            w = weights(k)
            now, new = w[allowed[k].index(x[k])], int(rng.integers(len(allowed[k])))
            if rng.random() * now < w[new]:
                x[k] = allowed[k][new]

        for _ in range(burn_in):
            step()
        rows = []
        for t in range(length):
            rows.append((chain, t, *x))
            if pr_restart and rng.random() < pr_restart:
                x[:] = start
                for _ in range(burn_in):
                    step()
            for _ in range(skip + 1):
                step()
        return pd.DataFrame(rows, columns=["chain", "step", *names])

    schema = "chain long, step long, " + ", ".join(f"`{v}` int" for v in names)
    starts = direct(model, chains, names, cond, seed=seed).withColumnRenamed("row", "chain")
    return starts.groupBy("chain").applyInPandas(run, schema)


def chained(
    model: Model, pairs: dict[str, str], chains: int, length: int, initial: Condition | None = None, cond: Condition | None = None, draw: Draw | None = None, seed: int = 1, segment: int = 1 << 16, most_cells: int = 1_000_000
) -> DataFrame:
    """``chain, step`` and the variables: samples in which each ``pairs`` value copies its key's state of the step before.

    The first step follows the model under ``initial``, the others under the
    copied states; ``cond`` holds throughout. A chain ends early where the
    copied states have no weight.

    An elimination keeps the variables of the pairs alone; their table, of at
    most ``most_cells`` rows, says how copied states go on. Chains are cut into
    segments of ``segment`` steps. A segment is first run from every state at
    once, with the same numbers, which makes it a map of states; maps follow
    each other in any grouping, so each segment learns its first state from
    the maps before it and all are run at the same time. The other variables
    are drawn last, for all steps together. The ``k``-th variable of the model
    uses ``draw(k)``, and steps after the first ``draw(-1)``, at row ``chain *
    length + step``.
    """
    names = [v.name for v in model.variables]
    keys, copies = list(pairs), list(pairs.values())
    if {*keys, *copies} - set(names) or len(set(copies)) != len(copies):
        raise ValueError(f"inconsistent pairs {pairs}")
    draw = draw or random_draw(seed)
    spark = model.factors[0].table.sparkSession
    first = _drawn(spark.range(chains).select((F.col("id") * length).alias("row")), ["row"], _products(model, _both(cond, initial), (), None, 8), names, draw)
    first = written(first.select("row", *names), "first-steps")
    number = F.floor(F.col("row") / length)
    whole = first.select(number.alias("chain"), F.lit(0).cast("long").alias("step"), *names)
    if length < 2 or not pairs:
        rest = _drawn(_steps(spark, chains, 1, length).select("row"), ["row"], _products(model, cond, (), None, 8), names, draw)
        going = rest.join(first.select(number.alias("_c")), F.floor(rest["row"] / length) == F.col("_c"), "left_semi") if length > 1 else rest.limit(0)
        return whole.unionByName(going.select(number.alias("chain"), (F.col("row") % length).alias("step"), *names))

    held = [v for v in names if v in {*keys, *copies}]
    _, table = eliminate(tables(model, cond), model.sizes, held)
    cells = table.select(*held, "w").where(F.col("w") > 0).limit(most_cells + 1).collect()  # most_cells at most
    if len(cells) > most_cells:
        raise ValueError(f"the table of {', '.join(held)} has over {most_cells} rows")
    shared = spark.sparkContext.broadcast(_Steps.of([tuple(r) for r in cells], [held.index(v) for v in keys], [held.index(v) for v in copies], [model.sizes[v] for v in keys]))
    steps = _steps(spark, chains, 1, length).select("row", number.alias("chain"), F.floor(F.col("row") % length / segment).alias("segment"), draw(-1).alias("_u"))

    def as_map(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # states that have met stay together, so only distinct ones go on
        at, place = np.arange(shared.value.states), np.arange(shared.value.states)
        for u in pdf.sort_values("row")["_u"].to_numpy():
            at = shared.value.after(shared.value.cell(at, u))
            if len(at) > 1:
                at, met = np.unique(at, return_inverse=True)
                place = met[place]
        return pd.DataFrame([(k[0], k[1], at[place].tolist())], columns=["chain", "segment", "map"])

    state = sum((F.col(v) * stride for v, stride in zip(keys, _strides([model.sizes[v] for v in keys]))), F.lit(0)).cast("int")
    maps = steps.groupBy("chain", "segment").applyInPandas(as_map, "chain long, segment long, map array<int>")
    maps = maps.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("segment", "map"))).alias("m"))  # length / segment maps
    # the state each segment begins with
    go = lambda acc, x: F.concat(acc, F.array(F.when(F.element_at(acc, -1) < 0, -1).otherwise(F.get(x["map"], F.element_at(acc, -1)))))
    begins = first.select(number.alias("chain"), state.alias("s0")).join(maps, "chain").select("chain", "m", F.aggregate("m", F.array("s0"), go).alias("b"))
    begins = begins.select("chain", F.explode(F.zip_with(F.transform("m", lambda x: x["segment"]), "b", lambda a, b: F.struct(a.alias("segment"), b.alias("begin")))).alias("x")).select("chain", "x.*")
    begins = begins.where(F.col("segment").isNotNull() & (F.col("begin") >= 0))

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        found, at = [], np.array([int(pdf["begin"].iloc[0])])
        for row, u in zip(pdf["row"].to_numpy(), pdf["_u"].to_numpy()):
            cell = shared.value.cell(at, u)
            at = shared.value.after(cell)
            if at[0] < 0:
                break
            found.append((row, *shared.value.rows[cell[0]].tolist()))
        return pd.DataFrame(found, columns=["row", *held])

    ints = ", ".join(f"`{v}` int" for v in held)
    skeleton = steps.join(begins, ["chain", "segment"]).groupBy("chain", "segment").applyInPandas(run, f"row long, {ints}")
    rest = _drawn(skeleton, ["row", *held], _products(model, cond, held, None, 8), names, draw)
    return whole.unionByName(rest.select(number.alias("chain"), (F.col("row") % length).alias("step"), *names))


def _both(a: Condition | None, b: Condition | None) -> Condition:
    """The condition that both hold."""
    a, b = condition(a), condition(b)
    return {v: tuple(s for s in a.get(v, b.get(v)) if s in b.get(v, a.get(v))) for v in {**a, **b}}


def _strides(sizes: Sequence[int]) -> list[int]:
    return [math.prod(sizes[k + 1 :]) for k in range(len(sizes))]


def _steps(spark: SparkSession, chains: int, begin: int, length: int) -> DataFrame:
    """``row``: a number for every chain and every step from ``begin``."""
    n = length - begin
    return spark.range(chains * n).select((F.floor(F.col("id") / n) * length + F.col("id") % n + begin).alias("row"))


class _Steps:
    """How copied states go on: for each, the rows of the pairs' table it can lead to, with cumulated fractions."""

    @classmethod
    def of(cls, cells: list[tuple], keys: list[int], copies: list[int], sizes: list[int]) -> _Steps:
        self = cls()
        rows = np.array([c[:-1] for c in cells], dtype=np.int64).reshape(len(cells), -1)
        strides, weights = np.array(_strides(sizes)), np.array([c[-1] for c in cells])
        self.states = math.prod(sizes)
        # a copied state outside the key's states is never asked for
        fits = (rows[:, copies] < np.array(sizes)).all(axis=1) if len(rows) else np.zeros(0, dtype=bool)
        rows, weights = rows[fits], weights[fits]
        source = rows[:, copies] @ strides
        order = np.lexsort((*rows.T[::-1], source))
        self.rows, source, weights = rows[order], source[order], weights[order]
        self.next = self.rows[:, keys] @ strides
        self.first = np.searchsorted(source, np.arange(self.states))
        self.end = np.searchsorted(source, np.arange(self.states), side="right")
        total = np.bincount(source, weights, self.states) if len(source) else np.zeros(self.states)
        upto = np.concatenate([np.cumsum(weights[a:b]) / t for a, b, t in zip(self.first, self.end, total) if b > a] or [np.empty(0)])
        upto[self.end[self.end > self.first] - 1] = 1.0
        self.place = source + upto  # within its state's unit interval
        return self

    def cell(self, states: np.ndarray, u: float) -> np.ndarray:
        """The row each state goes to; -1 where none has weight, or for the state -1."""
        alive = (states >= 0) & (self.end[states] > self.first[states])
        found = np.clip(np.searchsorted(self.place, states + u, side="right"), self.first[states], np.maximum(self.end[states] - 1, 0))
        return np.where(alive, found, -1)

    def after(self, cells: np.ndarray) -> np.ndarray:
        return np.where(cells < 0, -1, self.next[cells] if len(self.next) else -1)
