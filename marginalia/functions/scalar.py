"""Column functions for probabilities, soft evidence and names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def ratio(num: Column, den: Column, otherwise: float = NAN) -> Column:
    """``num / den`` where ``den`` is positive, else NaN (or the given value)."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise))


def plogp(p: Column) -> Column:
    """``p * log2(p)``, 0 for p that is 0, negative, null or NaN."""
    return F.when((p > 0) & ~F.isnan(p), p * F.log2(p)).otherwise(F.lit(0.0))


def natural_index(columns: Sequence[Column], sizes: Sequence[int]) -> Column:
    """The place of an instance in natural order, the last variable fastest."""
    return reduce(lambda acc, cn: acc * cn[1] + cn[0], zip(columns, sizes), F.lit(0).cast("long"))


def one_hot(state: Column, n: int) -> Column:
    """A vector of ``n`` with 1 at the state; null for a null state."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == state, 1.0).otherwise(0.0))
    return F.when(state.isNotNull(), vector)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def arg_max(vector: Column) -> Column:
    """The first place, from 0, of the largest element."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def clean_name(name: Column, valid: str = "[a-zA-Z0-9_]", other: str = "_") -> Column:
    """The name with every character outside of ``valid`` replaced."""
    return F.regexp_replace(name, "[^" + valid[1:-1] + "]", other)


def escape(text: Column, single: bool = False, double: bool = False) -> Column:
    """Backslashes, line ends, tabs and the chosen quotes written as escapes."""
    pairs = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")] + [("'", "\\'")] * single + [('"', '\\"')] * double
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def instance_text(names: Sequence[str], columns: Sequence[Column]) -> Column:
    """``name=state, name=state`` of a row."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in zip(names, columns)))


def uniform_of(row: Column, multiplier: int = 1103515245, step: int = 12345) -> Column:
    """A fixed number in [0, 1) for a row number: reproducible anywhere, for tests of samplers."""
    return ((row * multiplier + step) % 2147483648) / F.lit(2147483648.0)
