"""Corridor coverage of boundary samples, overall and per axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterlake.functions.codes import Z_TABLE
from rasterlake.operators.courts import by_axes
from rasterlake.operators.quantiles import metric_quantiles

CONTROL_MARGIN_PX = 1.0
LEVELS = tuple(Z_TABLE)
JUDGED_LEVEL = 0.95


def coverage_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Arclength-weighted coverage of samples whose half-width is z * sigma.

    Sums and exact index quantiles per key; both combine before the shuffle.
    """
    w, dist = F.col("weight_ds"), F.col("distance_px")
    half = {p: F.col("sigma_px") * z for p, z in Z_TABLE.items()}
    within = lambda cond: F.sum(F.when(cond, w).otherwise(F.lit(0.0)))
    rows = samples.withColumn("halfwidth_px", half[JUDGED_LEVEL])
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.sum(w).alias("ds_px"),
        *[within(dist <= half[p]).alias(f"__in_{int(p * 100)}") for p in LEVELS],
        within(dist + CONTROL_MARGIN_PX <= half[JUDGED_LEVEL]).alias("__margin"),
        F.sum(F.col("bias_px") * w).alias("__bias"),
        F.count_if("capped").alias("__capped"),
        F.max(dist).alias("max_distance_px"),
    )
    tails = metric_quantiles(
        rows,
        keys,
        {
            "halfwidth_px": {"median_halfwidth_px": ("floor", 0.5), "p95_halfwidth_px": ("floor", 0.95)},
            "distance_px": {"median_distance_px": ("floor", 0.5), "p95_distance_px": ("floor", 0.95)},
        },
    )
    norm = F.when(F.col("ds_px") > 0, F.col("ds_px")).otherwise(F.lit(1.0))
    d = sums.join(tails, keys) if keys else sums.crossJoin(F.broadcast(tails))  # one row each
    return d.select(
        *keys,
        "samples",
        "ds_px",
        *[(F.col(f"__in_{int(p * 100)}") / norm).alias(f"coverage_{int(p * 100)}") for p in LEVELS],
        "median_halfwidth_px",
        "p95_halfwidth_px",
        "median_distance_px",
        "p95_distance_px",
        "max_distance_px",
        (F.col("__bias") / norm).alias("bias_px"),
        (F.col("__capped") / F.col("samples")).alias("capped_fraction"),
        (F.col("__margin") / norm).alias("margin_survival"),
    )


def coverage_by_axis(samples: DataFrame, axes: list[str]) -> DataFrame:
    return coverage_summary(by_axes(samples, axes), ["axis", "value"])


def recovery_counts(arms: DataFrame, keys: list[str]) -> DataFrame:
    """Correct / identifiable / wrong counters with conditional denominators.

    Only supported arms (``recovered`` present) count at all.
    """
    d = arms.filter(F.col("recovered").isNotNull())
    hit = F.col("recovered") == F.col("truth")
    return d.groupBy(*keys).agg(
        F.count("*").alias("supported"),
        F.count_if(hit).alias("correct"),
        F.count_if(~hit).alias("wrong"),
        F.count_if("identifiable").alias("identifiable"),
        F.count_if(~F.col("identifiable")).alias("unidentifiable"),
        F.count_if(hit & F.col("identifiable")).alias("correct_where_identifiable"),
    )
