"""Coalescing reads its tables once, however many rounds it takes."""

import warnings

from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.operators import learning

A, B, C = (Variable(n, (0, 1)) for n in "abc")


def test_tables_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def read(w):
        seen.add(1)
        return w

    def tables():
        rows = [(0, 0, 3.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 5.0)]
        return [spark.createDataFrame(rows, f"{x} int, {y} int, weight double").withColumn("weight", read("weight")) for x, y in ("ab", "bc")]

    reads = []
    for rounds in (1, 4):
        before = seen.value
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            out = learning.coalesce_tables(tables(), [A, B, C], rounds=rounds, tolerance=0, change=-1)
        assert out.count() == 8
        reads.append(seen.value - before)
    assert reads[0] == reads[1] <= 16
