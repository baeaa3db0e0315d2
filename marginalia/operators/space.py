"""Probability spaces over a table of weighted instances.

Every measure is a DataFrame of one row (or of one row per state), from one
aggregation of the table. Logarithms are base 2 and ``0 log 0`` is 0; what has
no probability is NaN.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.catalog import Condition, Variable, condition, holds, names
from marginalia.functions.scalar import NAN, plogp, ratio
from marginalia.operators.crosstab import WEIGHT


class ProbabilitySpace(ABC):
    """Probabilities of anything that gives the weighted rows that meet a condition: ``given`` is all that a space defines."""

    @abstractmethod
    def given(self, cond: Condition | None = None) -> DataFrame:
        """Rows of state indexes that meet the condition, with ``weight``; an instance may have several."""

    def wmc(self, cond: Condition | None = None) -> DataFrame:
        """``wmc``: the weight of all instances that meet the condition, 0 for none."""
        return self.given(cond).agg(F.coalesce(F.sum(WEIGHT), F.lit(0.0)).alias("wmc"))

    def probability(self, event: Condition, cond: Condition | None = None) -> DataFrame:
        """``p`` of the event under the condition."""
        rows = self.given(cond)
        hit = F.coalesce(F.sum(F.when(holds(condition(event)), F.col(WEIGHT))), F.lit(0.0))
        return rows.agg(ratio(hit, F.coalesce(F.sum(WEIGHT), F.lit(0.0))).alias("p"))

    def marginal(self, variables: Sequence[str | Variable], cond: Condition | None = None, space: DataFrame | None = None) -> DataFrame:
        """``p`` of each instance; with ``space`` also of those without weight. NaN where all weight is 0."""
        by = names(variables)
        sums = self.given(cond).groupBy(*by).agg(F.sum(WEIGHT).alias(WEIGHT))
        if space is not None:
            sums = space.select(*by).join(sums, by, "left").withColumn(WEIGHT, F.coalesce(WEIGHT, F.lit(0.0)))
        z = sums.agg(F.sum(WEIGHT).alias("_z"))
        return sums.crossJoin(F.broadcast(z)).select(*by, ratio(F.col(WEIGHT), F.col("_z")).alias("p"))  # z is one row

    def most_likely(self, variables: Sequence[str | Variable], cond: Condition | None = None) -> DataFrame:
        """The most probable instance and its ``p``, the first in order on ties."""
        return self.marginal(variables, cond).orderBy(F.desc("p"), *names(variables)).limit(1)

    def correlation(self, a: tuple[str, int], b: tuple[str, int], cond: Condition | None = None) -> DataFrame:
        """``correlation`` of two indicators; 0 without variance, NaN without weight.

        Of one variable: 1 for the same state, 0 for others, NaN if the
        condition excludes either.
        """
        if a[0] == b[0]:
            allowed = condition(cond).get(a[0])
            value = NAN if allowed is not None and not {a[1], b[1]} <= set(allowed) else float(a[1] == b[1])
            return self.given(None).sparkSession.range(1).select(F.lit(value).alias("correlation"))
        w, ia, ib = F.col(WEIGHT), F.col(a[0]) == a[1], F.col(b[0]) == b[1]
        sums = self.given(cond).agg(*(F.coalesce(F.sum(x), F.lit(0.0)).alias(k) for k, x in {"z": w, "a": F.when(ia, w), "b": F.when(ib, w), "ab": F.when(ia & ib, w)}.items()))
        p = {k: ratio(F.col(k), F.col("z")) for k in ("a", "b", "ab")}
        spread = p["a"] * (1 - p["a"]) * p["b"] * (1 - p["b"])
        return sums.select(F.when(F.isnan(spread), F.lit(NAN)).when(spread > 0, (p["ab"] - p["a"] * p["b"]) / F.sqrt(spread)).otherwise(F.lit(0.0)).alias("correlation"))

    def joint(self, x: Sequence[str], y: Sequence[str], cond: Condition | None = None) -> DataFrame:
        """Weights of the joint instances with ``_x`` and ``_y`` as structs."""
        sums = self.given(cond).groupBy(*dict.fromkeys([*x, *y])).agg(F.sum(WEIGHT).alias(WEIGHT))
        return sums.select(F.struct(*x).alias("_x"), F.struct(*y).alias("_y"), WEIGHT)

    def entropies(self, x: str, y: str, cond: Condition | None = None) -> DataFrame:
        """``hx, hy, hxy``: entropies of two variables and of their pair, from one grouped pass."""
        rows = self.joint([x], [y], cond)
        parts = rows.groupingSets([[F.col("_x"), F.col("_y")], [F.col("_x")], [F.col("_y")], []], "_x", "_y").agg(F.sum(WEIGHT).alias(WEIGHT), F.grouping_id("_x", "_y").alias("_g"))
        z = parts.where(F.col("_g") == 3).select(F.col(WEIGHT).alias("_z"))
        p = plogp(ratio(F.col(WEIGHT), F.col("_z")))
        one = {"hxy": 0, "hx": 1, "hy": 2}
        return parts.crossJoin(F.broadcast(z)).agg(*(F.coalesce(-F.sum(F.when(F.col("_g") == g, p)), F.lit(0.0)).alias(k) for k, g in one.items()))  # z is one row

    def entropy(self, variables: Sequence[str] | str, cond: Condition | None = None) -> DataFrame:
        by = [variables] if isinstance(variables, str) else list(variables)
        return self.marginal(by, cond).agg(F.coalesce(-F.sum(plogp(F.col("p"))), F.lit(0.0)).alias("entropy"))

    def measures(self, x: str, y: str, cond: Condition | None = None, unconditioned_x: bool = False) -> DataFrame:
        """All information measures of two variables in one row.

        ``entropy_x, entropy_y, joint_entropy, conditional_entropy`` (x given
        y), ``mutual_information``, and its normalised forms, which are 0 where
        their denominator is 0: ``total_correlation`` (by the smaller entropy),
        ``uncertainty`` (by y's), ``symmetric_uncertainty``, ``iqr`` (by the
        joint), ``covariant_nmi`` (by the geometric mean). ``unconditioned_x``
        takes x's entropy without the condition in total correlation and
        symmetric uncertainty.
        """
        h = self.entropies(x, y, cond)
        hx, hy, hxy = (F.col(c) for c in ("hx", "hy", "hxy"))
        free = hx
        if unconditioned_x and cond:
            h = h.crossJoin(F.broadcast(self.entropy(x).withColumnRenamed("entropy", "_free")))  # one row
            free = F.col("_free")
        mi = hx + hy - hxy

        def over(d: Column) -> Column:
            return ratio(mi, d, 0.0)

        columns = {
            "entropy_x": hx, "entropy_y": hy, "joint_entropy": hxy, "conditional_entropy": hxy - hy, "mutual_information": mi, "total_correlation": over(F.least(free, hy)),
            "uncertainty": over(hy), "symmetric_uncertainty": over((free + hy) / 2), "iqr": over(hxy), "covariant_nmi": over(F.sqrt(hx * hy)),
        }
        return h.select(*(v.alias(k) for k, v in columns.items()))


class Space(ProbabilitySpace):
    """A table with a column per variable and ``weight``, as probabilities in proportion to the weights."""

    def __init__(self, table: DataFrame):
        self.table = table

    def given(self, cond: Condition | None = None) -> DataFrame:
        return self.table.where(holds(condition(cond))) if cond else self.table


class SampleSpace(ProbabilitySpace):
    """Samples, each of the same weight: the weight of a condition is the number of samples that meet it."""

    def __init__(self, samples: DataFrame, variables: Sequence[str | Variable]):
        self.samples = samples.select(*names(variables))

    def given(self, cond: Condition | None = None) -> DataFrame:
        rows = self.samples.where(holds(condition(cond))) if cond else self.samples
        return rows.withColumn(WEIGHT, F.lit(1.0))
