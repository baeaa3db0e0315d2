"""Evidence of many rows goes by tasks, whatever the planner takes its size for."""

import pytest
from pyspark.sql import functions as F

from marginalia import examples
from marginalia.operators import inference


def test_soft_evidence_is_never_broadcast(spark):
    model = examples.network(spark, "student")
    pair = F.array(F.col("id") * 0 + 0.25, F.lit(0.75))
    rows = spark.range(500).select("id", pair.alias("sat"), pair.alias("letter"))
    results = []
    for given, kind in (({}, "BroadcastHashJoin [sat"), ({"most_states": 3}, "SortMergeJoin [sat")):
        out = inference.soft_evidence(model, rows, ["sat", "letter"], "id", **given)
        joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [sat" in x and "letter" in x]
        assert len(joins) == 1 and kind in joins[0] and "BuildLeft" not in joins[0]
        results.append(sorted(tuple(r) for r in out.collect()))
    assert len(results[0]) == 500 and results[0] == [pytest.approx(r) for r in results[1]]
