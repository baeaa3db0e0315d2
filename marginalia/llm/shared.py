"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.folders import written as materialise

__all__ = ["materialise", "plain_names", "salted_rank", "table", "written_order"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(docs: DataFrame, added: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``docs`` with columns ``c0, c1, …``, so that no name clashes with an operator's own.

    Columns named like those an operator adds are dropped first. Also returns
    the old names in order, and the new name of each.
    """
    kept = docs.drop(*added)
    plain = kept.toDF(*(f"c{k}" for k in range(len(kept.columns))))
    return plain, kept.columns, dict(zip(kept.columns, plain.columns))


def salted_rank(df: DataFrame, group: list[str], order: list, rank: str, salts: int = 128) -> tuple[DataFrame, DataFrame]:
    """Number rows within each sub-group ``(group, salt)`` from 0.

    A group may hold a third of all rows, so it is dealt over ``salts``
    sub-groups by a hash of the order columns. The second result counts the
    rows of each sub-group; the caller turns the counts into offsets, which
    makes the ranks dense over the whole group. Rows equal in all order
    columns are interchangeable.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    window = Window.partitionBy(*group, "_salt").orderBy(*order)
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    return salted.withColumn(rank, F.row_number().over(window).cast("long") - 1), counts


def written_order(docs: DataFrame, place: str) -> DataFrame:
    """``docs`` with ``place``, which counts the rows from 0 in the order in which they were written.

    Spark numbers the files of a sorted table in its order, but reads them in
    another. So a row's place is its number within its Parquet file, after the
    rows of the files before; the driver gets one row for each file. A table
    that doesn't come from files is written first.
    """
    plain, names, _ = plain_names(docs, (place,))
    try:
        plain.metadataColumn("_metadata")
    except AnalysisException:
        plain = materialise(plain, "ordered")
    at = plain.metadataColumn("_metadata")
    read = plain.select(*plain.columns, at["file_path"].alias("_file"), at["row_index"].alias("_row"))
    files = [tuple(r) for r in read.groupBy("_file").agg(F.max("_row") + 1).collect()]
    starts, total = [], 0
    for path, n in sorted(files, key=lambda x: [int(s) if k % 2 else s for k, s in enumerate(re.split("([0-9]+)", x[0]))]):  # part-100000 follows part-99999
        starts.append((path, total))
        total += n
    begin = docs.sparkSession.createDataFrame(starts, "_file string, _start long")
    return read.join(F.broadcast(begin), "_file").select(*plain.columns, F.col("_start") + F.col("_row")).toDF(*names, place)
