"""Alias tables for cross-tables: a draw is two joins on a number, without cumulated weights.

Instances of equal weight form a group, an interval of the instances' numbers
by weight. Each slot of the alias table belongs to a group and may pass on to
one other; slots are equally likely. Groups below the mean mass are filled up
by those above: both are laid end to end, by what they lack and what they have
to spare, so where a group begins tells who fills it. These are running sums
over sorted rows, which many tasks share.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.folders import written
from marginalia.operators.crosstab import WEIGHT

SLOT = "slot long, keep double, first long, n long, other_first long, other_n long"


def accumulated(rows: DataFrame, order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Each row with the sums over all rows before it; the order must be total.

    Rows are sorted over all tasks and written; sums go within a partition and
    over the totals of the partitions, a row for each.
    """
    placed = written(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.call_function("shiftright", "_id", F.lit(33)))
    totals = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions
    starts = F.broadcast(totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(parts), F.lit(0)).alias(f"_{n}") for n in sums)))
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = [(F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()]
    return placed.join(starts, "_part").select(*rows.columns, *upto)


def numbered(table: DataFrame) -> DataFrame:
    """The instances with weight and their numbers ``index`` by weight, from 0; ties go by the variables."""
    by = [c for c in table.columns if c != WEIGHT]
    rows = table.where(F.col(WEIGHT) > 0).select(*by, F.col(WEIGHT).cast("double").alias(WEIGHT))
    return accumulated(rows, [WEIGHT, *by], {"index": F.lit(1)})


def weight_groups(instances: DataFrame) -> DataFrame:
    """``weight, first, n``: the instances of equal weight, which have the numbers from ``first``."""
    return instances.groupBy(WEIGHT).agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("n"))


def slots(groups: DataFrame) -> DataFrame:
    """The alias table: slot, the share it keeps for its own group, that group, and the group that has the rest.

    A group that lacks mass is filled by the one that has some to spare where
    it begins; one that has spent more than it could is filled by the next. So
    no slot has more than two groups. Without groups there are no slots.
    """
    mass = groups.withColumn("mass", F.col(WEIGHT) * F.col("n"))
    k, total, most = mass.agg(F.count(F.lit(1)), F.sum("mass"), F.max("mass")).first()
    if not k:
        return groups.sparkSession.createDataFrame([], SLOT)
    if not math.isfinite(total):
        raise ValueError("weights must be finite")
    mean = min(total / k, most)  # rounding may not put it above all
    mass = written(mass.select("first", "n", "mass"), "groups")
    few = accumulated(mass.where(F.col("mass") < mean).withColumn("lack", mean - F.col("mass")), ["first"], {"place": F.lit(1), "start": F.col("lack")})
    many = accumulated(mass.where(F.col("mass") >= mean).withColumn("spare", F.col("mass") - mean), ["first"], {"place": F.lit(1), "start": F.col("spare")})
    few, many = written(few, "few"), written(many, "many")
    none, zero = F.lit(0), F.lit(0.0)
    # at one point ends come first, then those who begin to give, then those who begin to take
    ends = many.select((F.col("start") + F.col("spare")).alias("at"), none.alias("kind"), "place", none.alias("gives"), zero.alias("takes"))
    begins = many.select(F.col("start").alias("at"), F.lit(1).alias("kind"), "place", F.lit(1).alias("gives"), zero.alias("takes"))
    takers = few.select(F.col("start").alias("at"), F.lit(2).alias("kind"), "place", none.alias("gives"), F.col("lack").alias("takes"))
    line = accumulated(ends.unionByName(begins).unionByName(takers), ["at", "kind", "place"], {"givers": F.col("gives"), "taken": F.col("takes")})
    line = written(line, "line")
    count = many.count()  # at least one: the largest is not below the mean
    giver = many.select(F.col("place").alias("giver"), F.col("first").alias("other_first"), F.col("n").alias("other_n"))
    at = F.greatest(F.least(F.col("givers") - 1, F.lit(count - 1)), F.lit(0))
    filled = few.join(line.where("kind = 2").select("place", at.alias("giver")), "place").join(giver, "giver")
    over = F.least(F.greatest(F.col("taken") - F.col("at"), zero), F.lit(mean))
    spent = many.join(line.where("kind = 0").select("place", over.alias("over"), (F.col("place") + 1).alias("giver")), "place").join(giver, "giver", "left")
    own = F.when(F.col("other_n").isNull(), 1.0).otherwise(1 - F.col("over") / mean)  # nobody after the last: what is over is rounding
    light = filled.select((F.col("place") + count).alias("slot"), (F.col("mass") / mean).alias("keep"), "first", "n", "other_first", "other_n")
    return light.unionByName(spent.select(F.col("place").alias("slot"), own.alias("keep"), "first", "n", "other_first", "other_n"))


def law(table: DataFrame, instances: DataFrame) -> DataFrame:
    """The instances and ``p``, the probability that draws from the alias table give each."""
    one = table.crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias("_k"))))  # one row
    own = one.select("first", (F.col("keep") / F.col("_k") / F.col("n")).alias("p"))
    rest = one.where("other_n is not null").select(F.col("other_first").alias("first"), ((1 - F.col("keep")) / F.col("_k") / F.col("other_n")).alias("p"))
    groups = own.unionByName(rest).groupBy("first").agg(F.sum("p").alias("p"))
    by = [c for c in instances.columns if c not in (WEIGHT, "index")]
    return instances.join(weight_groups(instances).join(groups, "first").select(WEIGHT, "p"), WEIGHT).select(*by, "p")
