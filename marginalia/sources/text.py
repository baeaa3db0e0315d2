"""Hard data sets from delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.operators.crosstab import WEIGHT


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def hard_dataset(spark: SparkSession, path: str, variables: Sequence[Variable], sep: str | None = ",", weights: str | int | None = None) -> DataFrame:
    """State indexes of the variables and ``weight`` from lines of numbers.

    What follows ``#`` is a comment. A first line that is not all numbers is a
    header, whose names give the columns' order; other columns are ignored.
    Without one, columns are the variables in order. ``sep`` None splits at
    white space. ``weights`` names or numbers a weight column; a negative
    number counts from the end. A state out of range is an error.
    """
    body = F.trim(F.regexp_replace("value", "#.*$", ""))
    lines = spark.read.text(path).select(body.alias("value")).where(F.col("value") != "")

    def cells(value):
        return F.transform(F.split(value, _quoted(sep)), lambda x: F.trim(x))

    top = lines.select(cells(F.col("value")).alias("c"), "value").take(1)
    if not top:
        return spark.createDataFrame([], ", ".join(f"`{v.name}` int" for v in variables) + f", {WEIGHT} double")
    first = top[0]["c"]
    header = None if all(map(_is_number, first)) else first
    if header is not None:
        lines = lines.where(F.col("value") != top[0]["value"])
        missing = [v.name for v in variables if v.name not in header]
        if missing:
            raise ValueError(f"no column for {missing}")
    width = len(first)
    weight_at = None
    if weights is not None:
        weight_at = header.index(weights) if isinstance(weights, str) else weights % width
    names = header or [v.name for v in variables]
    places = [k for k in range(width) if header is not None or k != weight_at]
    at = {n: places[k] if header is None else k for k, n in enumerate(names) if k < len(places)}
    row = cells(F.col("value"))

    def state(v: Variable):
        x = row[at[v.name]].cast("int")
        bad = x.isNull() | (x < 0) | (x >= len(v))
        return F.when(bad, F.raise_error(F.lit(f"bad state of {v.name}")).cast("int")).otherwise(x).alias(v.name)

    weight = F.lit(1.0) if weight_at is None else row[weight_at].cast("double")
    return lines.select(*(state(v) for v in variables), weight.alias(WEIGHT))


def _quoted(sep: str | None) -> str:
    return r"\s+" if sep is None else "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in sep)
