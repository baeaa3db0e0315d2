"""Arithmetic circuits in negative normal form, and their literal maps, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.folders import written


def read_nnf(spark: SparkSession, path: str) -> DataFrame:
    """``node, op, literal, args``: ``op`` is lit, add or mul; nodes are numbered by line, and args are earlier nodes.

    Lines of comments (``c``), the header and what follows ``%`` are left out.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"(?m)^\s*%")[0].alias("value"))
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).withColumn("value", F.trim("value"))
    nodes = lines.where((F.col("value") != "") & ~F.col("value").rlike(r"^(?:c\b|nnf\b)"))
    from pyspark.sql import Window

    part = F.split("value", r"\s+")
    code = part[0]
    op = F.when(code.isin("L", "l"), "lit").when(code.isin("A", "*"), "mul").when(code.isin("O", "+"), "add").otherwise(F.raise_error(F.concat(F.lit("unexpected line: "), F.col("value"))))
    skip = F.when(code == "O", 4).otherwise(3)
    args = F.when(code.isin("L", "l"), F.array().cast("array<int>")).otherwise(F.slice(part, skip, F.greatest(F.size(part) - skip + 1, F.lit(0))).cast("array<int>"))
    node = F.row_number().over(Window.orderBy("line")) - 1  # lines of one file
    return nodes.select(node.alias("node"), op.alias("op"), F.when(op == "lit", part[1].cast("int")).alias("literal"), args.alias("args"))


def read_literal_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Indicators ``literal, variable, state`` and parameters ``literal, value``."""
    part = F.split(F.trim("value"), r"\$")
    lines = spark.read.text(path).where(F.trim("value").startswith("cc$")).select(part.alias("p"))
    indicators = lines.where(F.col("p")[1] == "I").select(F.col("p")[2].cast("int").alias("literal"), F.col("p")[5].alias("variable"), F.col("p")[6].cast("int").alias("state"))
    parameters = lines.where(F.col("p")[1] == "C").select(F.col("p")[2].cast("int").alias("literal"), F.col("p")[3].cast("double").alias("value"))
    return indicators, parameters


def evaluate(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """``node, value`` of all nodes, from ``literal, value`` (literals without a value count 1).

    Each round values the nodes whose arguments are known, so there are as many
    rounds as the circuit is deep.
    """
    known = nodes.where("op = 'lit'").join(values, "literal", "left").select("node", F.coalesce("value", F.lit(1.0)).cast("double").alias("value"))
    left = nodes.where("op <> 'lit'").select("node", "op", "args")
    empty = left.where(F.size("args") == 0).select("node", F.when(F.col("op") == "add", 0.0).otherwise(1.0).alias("value"))
    known = written(known.unionByName(empty), "circuit")
    left = left.where(F.size("args") > 0)
    count = left.count()
    while count:
        arcs = left.join(known.select("node"), "node", "left_anti").select("node", "op", F.size("args").alias("n"), F.explode("args").alias("arg"))
        met = arcs.join(known.withColumnRenamed("node", "arg"), "arg")
        sums = met.groupBy("node", "op", "n").agg(F.sum("value").alias("s"), F.product("value").alias("p"), F.count(F.lit(1)).alias("k")).where(F.col("k") == F.col("n"))
        new = written(sums.select("node", F.when(F.col("op") == "add", F.col("s")).otherwise(F.col("p")).alias("value")), "circuit")
        done = new.count()
        if not done:
            raise ValueError("arguments form a cycle or are missing")
        known, count = known.unionByName(new), count - done
    return known
