"""Polygon areas and partition truth from ordered point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterlake.operators.prefix import neighbour


def signed_area(points: DataFrame, keys: list[str], index: str, x: str = "px", y: str = "py") -> DataFrame:
    """Shoelace area of the closed polygon of each key; ``index`` is dense from 0.

    The successor comes from a join on (key, index), and the closing edge from
    the two extreme points, so no polygon has to fit one task.
    """
    nxt = neighbour(points, keys, index, [x, y], 1, "_n")
    cross = F.col(x) * F.col(y + "_n") - F.col(x + "_n") * F.col(y)
    ends = lambda pick: pick(F.struct(x, y), index)
    sums = nxt.groupBy(*keys).agg(
        F.sum(cross).alias("open_sum"), ends(F.min_by).alias("first"), ends(F.max_by).alias("last"), F.count("*").alias("points")
    )
    closing = F.col(f"last.{x}") * F.col(f"first.{y}") - F.col(f"first.{x}") * F.col(f"last.{y}")
    area = (F.coalesce(F.col("open_sum"), F.lit(0.0)) + closing) * 0.5
    return sums.filter(F.col("points") > 1).select(*keys, area.alias("area"), "points")
