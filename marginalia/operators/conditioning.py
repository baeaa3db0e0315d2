"""Recursive conditioning: elimination under a bound on the rows of every join.

A binary tree of joins takes the product of a model's tables apart. A node's
message is a table over its context, the variables that tables outside it share.
Where a join could have more rows than the bound, states of its variables are
gone through in batches, one after the other, and only the batches' sums are
kept. Messages are remembered by the states that their own variables may have,
so a part without the split variables is worked out once for all batches.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.catalog import Condition, condition
from marginalia.folders import shared_folder, written
from marginalia.functions.scalar import ratio
from marginalia.operators.factors import Model
from marginalia.operators.inference import Table, _kept, product, sum_out, tables
from marginalia.plans.products import Tree, best_tree

Allowed = Mapping[str, tuple[int, ...]]  # the states of each variable that a message is about


@dataclass
class Conditioning:
    """One run over a model's tables; ``largest`` is the bound that its joins kept to, ``batches`` how many were gone through."""

    parts: Sequence[Table]
    most_rows: int
    most_batches: int = 10_000
    most_joins: int = 8
    largest: int = 0
    batches: int = 0
    known: dict = field(default_factory=dict)

    def variables(self, tree: Tree) -> frozenset:
        return frozenset(self.parts[tree][0]) if isinstance(tree, int) else self.variables(tree[0]) | self.variables(tree[1])

    def message(self, tree: Tree, needed: frozenset, allowed: Allowed) -> tuple[Table, int]:
        """The product below a node, summed over all variables but the needed ones, and the number of joins in its plan."""
        key = (tree, tuple((v, allowed[v]) for v in sorted(self.variables(tree))))
        if key in self.known:
            (scope, rows), joins = self.known[key]
            if joins:  # another batch reads it
                self.known[key] = (scope, written(rows, "message")), 0
        else:
            self.known[key] = self._leaf(tree, needed, allowed) if isinstance(tree, int) else self._node(tree, needed, allowed)
        return self.known[key]

    def _leaf(self, number: int, needed: frozenset, allowed: Allowed) -> tuple[Table, int]:
        scope, rows = self.parts[number]
        for v in scope:  # batches are runs of the states that the condition leaves
            rows = rows.where(F.col(v).between(allowed[v][0], allowed[v][-1]) if allowed[v] else F.lit(False))
        gone = [v for v in scope if v not in needed]
        return (sum_out((scope, rows), gone) if gone else (scope, rows)), 0

    def _node(self, tree: tuple, needed: frozenset, allowed: Allowed) -> tuple[Table, int]:
        left, right = tree
        a, b = self.variables(left), self.variables(right)
        scope = (a & (needed | b)) | (b & (needed | a))
        split = self._split(scope, allowed)
        if len(split) > 1:
            return self._in_batches(tree, needed, allowed, split)
        self.largest = max(self.largest, math.prod(len(allowed[v]) for v in scope))
        (x, n), (y, m) = self.message(left, needed | b, allowed), self.message(right, needed | a, allowed)
        found = product(x, y)
        gone = [v for v in found[0] if v not in needed]
        return _kept(*(sum_out(found, gone) if gone else found), n + m + 1, self.most_joins)

    def _in_batches(self, tree: tuple, needed: frozenset, allowed: Allowed, split: Sequence[Allowed]) -> tuple[Table, int]:
        self.batches += len(split)
        if self.batches > self.most_batches:
            raise ValueError(f"over {self.most_batches} batches; allow more rows")
        path = None
        for states in split:
            (scope, rows), _ = self.message(tree, needed, {**allowed, **states})
            path = path or f"{shared_folder(rows.sparkSession)}/batches-{uuid.uuid4().hex}"
            rows.write.mode("append").parquet(path)
        together = rows.sparkSession.read.schema(rows.schema).parquet(path)
        if set(split[0]) - needed:  # batches with the same instances
            return sum_out((scope, together), []), 0
        return (scope, together), 0

    def _split(self, scope: frozenset, allowed: Allowed) -> list[dict]:
        """States of some variables that make the instances of a scope come in batches of at most ``most_rows``; variables of few tables first."""
        size, found = math.prod(len(allowed[v]) for v in scope), [{}]
        for v in sorted(scope, key=lambda v: (sum(v in s for s, _ in self.parts), v)):
            if size <= self.most_rows:
                break
            rest = size // len(allowed[v])
            take = max(1, min(len(allowed[v]), self.most_rows // rest))
            runs = [allowed[v][k : k + take] for k in range(0, len(allowed[v]), take)]
            if len(found) * len(runs) > self.most_batches:
                raise ValueError(f"over {self.most_batches} batches; allow more rows")
            found = [{**f, v: r} for f in found for r in runs]
            size = rest * take
        return found


def conditioning(model: Model, keep: Sequence[str] = (), cond: Condition | None = None, most_rows: int = 1_000_000, most_batches: int = 10_000) -> tuple[DataFrame, Conditioning]:
    """``keep`` and ``w``, the weight of the kept variables' instances under the condition, and the run that found it.

    Joins and messages have at most ``most_rows`` rows, whatever the model's
    width; the price is time, as batches follow each other. It is an error if
    more than ``most_batches`` would be needed. Without kept variables there is
    one row, 0 where no instance meets the condition; with them, instances
    without weight have none.
    """
    if most_rows < 1 or not model.factors:
        raise ValueError("a factor and a bound of at least one row are needed")
    cond = condition(cond)
    parts = tables(model, cond)
    allowed = {v.name: tuple(s for s in range(len(v)) if v.name not in cond or s in cond[v.name]) for v in model.variables}
    tree, _ = best_tree([s for s, _ in parts], model.sizes, keep)
    run = Conditioning(parts, most_rows, most_batches)
    (_, rows), _ = run.message(tree, frozenset(keep), allowed)
    if keep:
        return rows.where(F.col("w") != 0).select(*keep, "w"), run
    return rows.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")), run


def conditioned_marginal(model: Model, variables: Sequence[str], cond: Condition | None = None, most_rows: int = 1_000_000) -> DataFrame:
    """``p`` of every instance of the variables that has weight, by :func:`conditioning`."""
    rows, _ = conditioning(model, variables, cond, most_rows)
    z = rows.agg(F.sum("w").alias("_z"))
    return rows.crossJoin(F.broadcast(z)).select(*variables, ratio(F.col("w"), F.col("_z")).alias("p"))  # z is one row
