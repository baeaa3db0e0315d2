"""Random permutations and pairs, the same whenever the seed is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.alias import accumulated
from marginalia.operators.sampling import Draw


def permuted(rows: DataFrame, keys: Sequence[str], u: Column | None = None, seed: int = 1, name: str = "place") -> DataFrame:
    """The rows with their places, from 0, in a random order.

    Rows go by ``u``, or else by a hash of the seed and the keys; the keys
    break ties. Rows with equal keys take neighbouring places. The sort is that of
    all tasks, and places follow from the partitions' sizes, so no task sees all rows.
    """
    order = F.xxhash64(F.lit(seed), *keys) if u is None else u
    return accumulated(rows.withColumn("_u", order), ["_u", *keys], {name: F.lit(1)}).drop("_u")


def distinct_pair(size: Column | int, draw: Draw) -> tuple[Column, Column]:
    """Two different numbers below ``size``, all ordered pairs alike; null where there are not two."""
    n = F.lit(size) if isinstance(size, int) else size
    first = F.least(F.floor(draw(0) * n), n - 1)
    other = F.least(F.floor(draw(1) * (n - 1)), n - 2)
    return F.when(n > 1, first), F.when(n > 1, other + (other >= first).cast("long"))
