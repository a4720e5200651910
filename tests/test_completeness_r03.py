"""Expected keys are made distinct after their exchange."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import corpus as K


def test_expected_keys_move_before_they_are_compared(spark):
    seven = F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))
    cells = F.explode(F.concat(seven, seven)).alias("c")
    expected = spark.range(300).select(F.col("id").alias("g"), cells)
    rows = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, 9), (None, 1)], "g long, c long")
    d = K.key_completeness(expected.unionByName(spark.createDataFrame([(None, 1)], "g long, c long")), rows, ["g", "c"])
    got = sorted(((r.g, r.c, r.problem, r.copies) for r in d.filter("problem != 'missing' or g is null").collect()), key=str)
    assert got == [(2, 2, "duplicate", 2), (3, 9, "unexpected", 1), (None, 1, "missing", 0), (None, 1, "unexpected", 1)]
    assert d.filter("problem = 'missing'").count() == 2100 - 2 + 1
    assert "REPARTITION_BY_COL" in d._jdf.queryExecution().executedPlan().toString()  # no task compares what it multiplies
