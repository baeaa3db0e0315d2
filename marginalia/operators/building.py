"""Building data sets: checked columns, appended rows and appended data sets.

A data set is a DataFrame with a column of state indexes (hard) or of vectors
of state weights (soft) for each variable, and ``weight``. A null cell is
missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.operators.crosstab import WEIGHT


def _absent(data: DataFrame, variables: Iterable[Variable]) -> None:
    there = [v.name for v in variables if v.name in data.columns]
    if there:
        raise ValueError(f"there are columns {there} already")


def checked_index(column: Column, variable: Variable) -> Column:
    """A state index; one out of range is an error, null stays null."""
    bad = (column < 0) | (column >= len(variable))
    return F.when(bad, F.raise_error(F.lit(f"no such state of {variable.name}")).cast("int")).otherwise(column.cast("int"))


def checked_weights(column: Column, variable: Variable) -> Column:
    """A vector of state weights; one of another length is an error, null stays null."""
    bad = F.size(column) != len(variable)
    return F.when(column.isNotNull() & bad, F.raise_error(F.lit(f"{len(variable)} weights are needed for {variable.name}")).cast("array<double>")).otherwise(column.cast("array<double>"))


def with_indexes(data: DataFrame, variable: Variable, column: Column) -> DataFrame:
    """A new hard column from state indexes."""
    _absent(data, [variable])
    return data.withColumn(variable.name, checked_index(column, variable))


def with_labels(data: DataFrame, variable: Variable, column: Column) -> DataFrame:
    """A new hard column from states; an unknown state is an error."""
    _absent(data, [variable])
    return data.withColumn(variable.name, variable.of_labels(column))


def with_weights(data: DataFrame, variable: Variable, column: Column) -> DataFrame:
    """A new soft column from vectors."""
    _absent(data, [variable])
    return data.withColumn(variable.name, checked_weights(column, variable))


def new_columns(data: DataFrame, variables: Sequence[Variable], soft: bool = False) -> DataFrame:
    """New columns of missing cells; one that is there already is an error."""
    _absent(data, variables)
    return ensure_columns(data, variables, soft)


def ensure_columns(data: DataFrame, variables: Sequence[Variable], soft: bool = False) -> DataFrame:
    """Columns of missing cells for the variables that have none."""
    kind = "array<double>" if soft else "int"
    return data.withColumns({v.name: F.lit(None).cast(kind) for v in variables if v.name not in data.columns})


def delete_columns(data: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """The data set without the variables; one that is not there is an error."""
    missing = [v.name for v in variables if v.name not in data.columns]
    if missing:
        raise ValueError(f"there are no columns {missing}")
    return data.drop(*(v.name for v in variables))


def append(data: DataFrame, records: Sequence[Sequence], variables: Sequence[Variable], weight: float = 1.0) -> DataFrame:
    """Some given records at the end, each with a state index or None for every variable."""
    for r in records:
        if len(r) != len(variables):
            raise ValueError(f"a record has {len(variables)} values")
        for x, v in zip(r, variables):
            if x is not None and not 0 <= x < len(v):
                raise ValueError(f"no such state of {v.name}: {x}")
    schema = ", ".join(f"`{v.name}` int" for v in variables) + f", {WEIGHT} double"
    new = data.sparkSession.createDataFrame([(*r, weight) for r in records], schema)
    return data.unionByName(new, allowMissingColumns=True)


def insert(data: DataFrame, order: str, at: int, records: Sequence[Sequence], variables: Sequence[Variable], weight: float = 1.0) -> DataFrame:
    """Records before the row whose ``order`` is ``at``; later rows move on, so no row is sorted or numbered."""
    moved = data.withColumn(order, F.when(F.col(order) >= at, F.col(order) + len(records)).otherwise(F.col(order)).cast("long"))
    schema = f"`{order}` long, " + ", ".join(f"`{v.name}` int" for v in variables) + f", {WEIGHT} double"
    new = data.sparkSession.createDataFrame([(at + k, *r, weight) for k, r in enumerate(records)], schema)
    return moved.unionByName(new, allowMissingColumns=True)


def append_dataset(data: DataFrame, other: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """The rows of both, matched by variable; cells of variables that ``other`` lacks are missing, its further columns are left out.

    Hard cells become vectors where the first data set has vectors.
    """
    from marginalia.functions.scalar import one_hot

    soft = {c for c, kind in data.dtypes if kind.startswith("array")}
    soft_there = {c for c, kind in other.dtypes if kind.startswith("array")}
    columns = []
    for v in variables:
        if v.name not in other.columns:
            columns.append(F.lit(None).cast(data.schema[v.name].dataType).alias(v.name))
        elif v.name in soft and v.name not in soft_there:
            columns.append(one_hot(F.col(v.name), len(v)).alias(v.name))
        elif v.name in soft_there and v.name not in soft:
            raise ValueError(f"{v.name} has vectors only in the second data set")
        else:
            columns.append(F.col(v.name).cast(data.schema[v.name].dataType).alias(v.name))
    weight = F.col(WEIGHT) if WEIGHT in other.columns else F.lit(1.0)
    return data.select(*(v.name for v in variables), WEIGHT).unionByName(other.select(*columns, weight.cast("double").alias(WEIGHT)))


def dump(data: DataFrame, variables: Sequence[Variable], states: bool = True) -> DataFrame:
    """``line``: a text of each row, with states or their indexes, and its weight."""
    cells = [F.coalesce(v.labels(F.col(v.name)) if states else F.col(v.name).cast("string"), F.lit("?")) for v in variables]
    return data.select(F.concat_ws(", ", *cells, F.concat(F.lit("x "), F.col(WEIGHT).cast("string"))).alias("line"))
