"""Random variables: finite, ordered, unique states, indexed from 0."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.folders import written
from marginalia.functions.scalar import natural_index


@dataclass(frozen=True)
class Variable:
    """A random variable; its name is the name of its column."""

    name: str
    states: tuple

    def __post_init__(self):
        object.__setattr__(self, "states", tuple(self.states))
        if len({(type(s), s) for s in self.states}) != len(self.states):
            raise ValueError(f"states of {self.name} are not unique")

    def __len__(self) -> int:
        return len(self.states)

    def index(self, state) -> int:
        """The index of a state; KeyError for one that is unknown."""
        for k, s in enumerate(self.states):
            if type(s) is type(state) and s == state:
                return k
        raise KeyError(state)

    def of_labels(self, column: Column, strict: bool = True) -> Column:
        """State indexes of labels. An unknown label is an error, or null if not ``strict``; null stays null."""
        texts = [str(s) for s in self.states if s is not None]
        if len(set(texts)) != len(texts):
            raise ValueError(f"states of {self.name} print alike; give their indexes instead")
        cases = F.create_map(*(x for k, s in enumerate(self.states) if s is not None for x in (F.lit(str(s)), F.lit(k))))
        label = column.cast("string")
        found = cases[label]
        if not strict:
            return found
        return F.when(label.isNull(), F.lit(None).cast("int")).when(found.isNull(), F.raise_error(F.concat(F.lit(f"unknown state of {self.name}: "), label)).cast("int")).otherwise(found)

    def labels(self, column: Column) -> Column:
        """Labels of state indexes, as text; null stays null."""
        label = F.element_at(F.array(*(F.lit(None if s is None else str(s)).cast("string") for s in self.states)), column + 1)
        return F.when(column.isNotNull(), label)  # a null place alone does not make element_at nullable


def variables_of(df: DataFrame, columns: Sequence[str], most: int = 10_000) -> list[Variable]:
    """Variables with the distinct values of columns as states, in order. Nulls are no state. Columns of more than ``most`` values are an error."""
    counts = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()  # so that no large set is gathered
    for c in columns:
        if counts[c] > 1.2 * most:
            raise ValueError(f"{c} has about {counts[c]} states, over {most}")
    sets = df.agg(*(F.sort_array(F.collect_set(F.col(c))).alias(c) for c in columns)).first()
    found = [Variable(c, tuple(sets[c])) for c in columns]
    for v in found:
        if len(v) > most:
            raise ValueError(f"{v.name} has {len(v)} states, over {most}")
    return found


def state_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the index of each value of ``column`` among its distinct values.

    The distinct values are sorted over all tasks and written with their places
    in their partitions; the partitions' sizes, a row for each, make the places
    dense. So no task sees the table, nor all values.
    """
    from pyspark.sql import Window

    values = df.select(F.col(column).alias("_value")).where(F.col("_value").isNotNull()).distinct()
    placed = written(values.orderBy("_value").withColumn("_id", F.monotonically_increasing_id()), "states")  # partition and place
    part = F.call_function("shiftright", "_id", F.lit(33))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over partitions
    starts = F.broadcast(sizes.select("_part", "_first", before.alias("_before")))  # a row for each partition
    ranked = placed.withColumn("_part", part).join(starts, "_part").select(F.col("_value").alias(column), (F.col("_id") - F.col("_first") + F.col("_before")).cast("int").alias(name))
    return df.join(ranked, column, "left")


def state_space(spark: SparkSession, variables: Sequence[Variable], index: str | None = None) -> DataFrame:
    """All instances of the variables as state indexes; optionally with their natural index."""
    size = reduce(lambda a, v: a * len(v), variables, 1)
    n = F.col("id")
    columns, stride = [], size
    for v in variables:
        stride //= max(1, len(v))
        columns.append((F.floor(n / stride) % len(v)).cast("int").alias(v.name))
    return spark.range(size).select(*columns, *([n.alias(index)] if index else []))


def natural(variables: Sequence[Variable]) -> Column:
    return natural_index([F.col(v.name) for v in variables], [len(v) for v in variables])


Condition = dict  # variable name -> allowed state indexes


def condition(*given: tuple | dict | None) -> Condition:
    """Conditions as allowed states by variable: states of one variable are alternatives, variables must all hold.

    Takes ``(name, state)`` or ``(name, states)`` pairs, dictionaries and None.
    """
    found: dict[str, set[int]] = {}
    for g in given:
        for name, states in (g.items() if isinstance(g, dict) else [] if g is None else [g]):
            found.setdefault(name, set()).update([states] if isinstance(states, int) else states)
    return {k: tuple(sorted(v)) for k, v in found.items()}


def holds(cond: Condition) -> Column:
    """A predicate on state-index columns."""
    return reduce(lambda a, b: a & b, (F.col(k).isin(*v) if v else F.lit(False) for k, v in cond.items()), F.lit(True))


def names(variables: Iterable[Variable | str]) -> list[str]:
    return [v if isinstance(v, str) else v.name for v in variables]
