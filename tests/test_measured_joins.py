"""Joins go by the size of rows, not by the size of the files that hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import chains as H
from rasterlake.session import cut


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_small_files_and_many_rows_is_not_broadcast(spark):
    # two million equal pixels are a file of less than 10 MB
    flat = cut(spark.range(2_000_000).select((F.col("id") % 64).alias("x"), F.col("id"), F.lit(1).alias("label")))
    again = cut(flat.select("id", F.lit(2).alias("other")))
    assert "BroadcastHashJoin" not in planned(flat.join(again, "id"))


def test_resample_broadcasts_neither_side(spark):
    points = spark.createDataFrame([(c, k, float(k), 0.0) for c in range(3) for k in range(5)], "chain_id long, k long, px double, py double")
    d = H.resample(points)
    assert "SortMergeJoin" in planned(d)
    assert d.count() == 3 * 8
