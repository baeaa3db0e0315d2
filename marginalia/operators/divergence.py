"""Divergences between two probability spaces over the same variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.folders import written
from marginalia.functions.scalar import NAN, ratio
from marginalia.operators.space import Space


def paired(p: Space, q: Space, by: Sequence[str], space: DataFrame | None = None) -> DataFrame:
    """``p, q`` of every instance that either has, or of the whole ``space``; absent is 0."""
    if sorted(set(by)) != sorted(by):
        raise ValueError("repeated variables")
    a, b = p.marginal(by), q.marginal(by).withColumnRenamed("p", "q")
    joined = a.join(b, list(by), "full") if space is None else space.select(*by).join(a, list(by), "left").join(b, list(by), "left")
    return joined.select(*by, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def kl(p: Space, q: Space, by: Sequence[str], space: DataFrame | None = None) -> DataFrame:
    """``kl``: the sum of ``p log2(p / q)`` over the state space; NaN as soon as any instance lacks probability in either.

    The state space is ``space``, or else all combinations of the values met in
    either; so an instance that neither has gives NaN too. Whether there is one
    is told by counting: without any, the instances met are as many as the
    product of the numbers of values.
    """
    bad = (F.col("p") <= 0) | (F.col("q") <= 0) | F.isnan("p") | F.isnan("q")
    term = F.when(~bad, F.col("p") * F.log2(F.col("p") / F.when(~bad, F.col("q"))))
    pairs = paired(p, q, by, space)
    if space is not None:
        return pairs.agg(F.when(F.coalesce(F.bool_or(bad), F.lit(True)), F.lit(NAN)).otherwise(F.sum(term)).alias("kl"))
    pairs = written(pairs, "pairs")  # counted and summed
    sums = pairs.agg(F.coalesce(F.bool_or(bad), F.lit(True)).alias("_bad"), F.sum(term).alias("_kl"), F.count(F.lit(1)).alias("_n"))
    values = pairs.agg(reduce(lambda a, b: a * b, (F.count_distinct(v).cast("double") for v in by), F.lit(1.0)).alias("_all"))
    return sums.crossJoin(F.broadcast(values)).select(F.when(F.col("_bad") | (F.col("_n") < F.col("_all")), F.lit(NAN)).otherwise(F.col("_kl")).alias("kl"))  # one row each


def pseudo_kl(p: Space, q: Space, factors: Mapping[str, Sequence[str]], space: DataFrame | None = None, conditional: bool = False) -> DataFrame:
    """``pseudo_kl``: the KL divergences of the families' joint distributions, summed over p's structure ``child -> parents``.

    ``conditional`` takes the divergence of the parents off each, which leaves
    that of the conditional distributions.
    """
    found = None
    for child, parents in factors.items():
        one = kl(p, q, [child, *parents], space.select(child, *parents).distinct() if space is not None else None).withColumnRenamed("kl", "v")
        if parents and conditional:
            one = one.crossJoin(F.broadcast(kl(p, q, list(parents)))).select((F.col("v") - F.col("kl")).alias("v"))  # one row each
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("a structure has variables")
    return found.agg(F.sum("v").alias("pseudo_kl"))


def histogram_intersection(p: Space, q: Space, by: Sequence[str]) -> DataFrame:
    """``hi``: the sum of the smaller probabilities."""
    return paired(p, q, by).agg(F.coalesce(F.sum(F.least("p", "q")), F.lit(0.0)).alias("hi"))


def factored_histogram_intersection(p: Space, q: Space, factors: Mapping[str, Sequence[str]]) -> DataFrame:
    """``fhi``: the mean over variables of the intersections of their conditionals, weighed by p's parents."""
    terms = None
    for child, parents in factors.items():
        joint = paired(p, q, [child, *parents])
        sums = joint.groupBy(*parents).agg(F.sum("p").alias("_pp"), F.sum("q").alias("_qq"))
        joined = joint.join(sums, list(parents)) if parents else joint.crossJoin(F.broadcast(sums))  # one row
        low = F.least(ratio(F.col("p"), F.col("_pp"), 0.0), ratio(F.col("q"), F.col("_qq"), 0.0)) * F.col("_pp")
        one = joined.agg(F.coalesce(F.sum(low), F.lit(0.0)).alias("v"))
        terms = one if terms is None else terms.unionByName(one)
    return terms.agg((F.sum("v") / len(factors)).alias("fhi"))
