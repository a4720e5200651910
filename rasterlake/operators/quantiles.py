"""Exact index quantiles of groups of any size.

Two index rules are used: ``floor`` takes position min(floor(n*q), n-1) and
``ceil`` takes position ceil((n-1)*q); neither interpolates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.operators.prefix import running


def quantile_index(n: Column, rule: str, q: float) -> Column:
    if rule == "floor":
        return F.least(F.floor(n * q), n - 1)
    if rule == "ceil":
        return F.ceil((n - 1) * q)
    raise ValueError(f"unknown quantile rule {rule}")


def index_quantiles(df: DataFrame, keys: list[str], value: str, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per key with ``n`` and the named quantiles of ``value``.

    Equal values are counted before anything is sorted, so a value held by most
    rows costs one row; the rank then comes from a sliced running count, so a key
    held by most rows is spread over the tasks.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranked = running(counts, keys, [value], {"__upto": "__n"})
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("n"))
    joined = ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))
    picks = [
        F.min(F.when(F.col("__upto") > quantile_index(F.col("n"), rule, q), F.col(value))).alias(name)
        for name, (rule, q) in specs.items()
    ]
    return joined.groupBy(*keys, "n").agg(*picks)


def unpivot(df: DataFrame, keep: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Long form of several numeric columns, so one pass ranks them all."""
    cast = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select(*keep, *cast).unpivot(keep, metrics, name, value)


def metric_quantiles(df: DataFrame, keys: list[str], metrics: dict[str, dict[str, tuple[str, float]]]) -> DataFrame:
    """Quantiles of several columns per key, back in wide form.

    ``metrics`` maps a column to ``{output name: (rule, q)}``.
    """
    specs = {f"{rule}_{q}": (rule, q) for outs in metrics.values() for rule, q in outs.values()}
    flat = unpivot(df, keys, list(metrics), "__metric", "__value")
    long = index_quantiles(flat, [*keys, "__metric"], "__value", specs)
    wide = [
        F.max(F.when(F.col("__metric") == m, F.col(f"`{rule}_{q}`"))).alias(out)
        for m, outs in metrics.items()
        for out, (rule, q) in outs.items()
    ]
    return long.groupBy(*keys).agg(*wide) if keys else long.agg(*wide)
