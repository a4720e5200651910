"""Factorial arms, contrasts, ladders, leaderboards and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.operators.digests import ordered_digest

ARMS = ("PF00", "PF01", "PF10", "PF11")
COMPONENTS = ("backend", "config", "budget", "schema")

# Coefficient of each arm in each effect of the 2x2 design.
EFFECTS = {
    "partition_main_effect": {"PF00": -0.5, "PF01": -0.5, "PF10": 0.5, "PF11": 0.5},
    "formation_main_effect": {"PF00": -0.5, "PF01": 0.5, "PF10": -0.5, "PF11": 0.5},
    "interaction": {"PF00": 0.5, "PF01": -0.5, "PF10": -0.5, "PF11": 0.5},
}


def arm_aggregate(members: DataFrame, keys: list[str], reduce: str) -> DataFrame:
    """One row per (keys, arm): reduced value, contamination, fixture digest.

    All members must agree on every key component but the fixture; ``refusal``
    names the first component that differs, and no value is given then.
    """
    how = {"max": F.max, "min": F.min, "mean": F.avg}[reduce]
    d = members.filter(F.col("arm").isNotNull()).groupBy(*keys, "arm").agg(
        how("value").alias("__value"),
        F.count("*").alias("members"),
        F.bool_or("contaminated").alias("contaminated"),
        *[F.min(c).alias(f"__lo_{c}") for c in COMPONENTS],
        *[F.max(c).alias(f"__hi_{c}") for c in COMPONENTS],
    )
    differs = lambda c: ~F.col(f"__lo_{c}").eqNullSafe(F.col(f"__hi_{c}"))
    refusal = F.lit(None).cast("string")
    for c in reversed(COMPONENTS):
        refusal = F.when(differs(c), F.lit(f"key_mismatch:{c}")).otherwise(refusal)
    refusal = F.when(F.col("__value").isNull(), "no_measurements").otherwise(refusal)
    fixtures = members.filter(F.col("arm").isNotNull()).select(*keys, "arm", "fixture").distinct()
    digest = ordered_digest(fixtures, [*keys, "arm"], ["fixture"], F.col("fixture"), "fixture_hash")
    out = d.withColumn("refusal", refusal).withColumn("value", F.when(F.col("refusal").isNull(), F.col("__value")))
    return out.join(digest, [*keys, "arm"]).select(*keys, "arm", "value", "members", "contaminated", "fixture_hash", "refusal")


def arms_wide(arms: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    pick = lambda a: F.max(F.when(F.col("arm") == a, F.col(value))).alias(a)
    return arms.groupBy(*keys).agg(*[pick(a) for a in ARMS], F.bool_or("contaminated").alias("contaminated"))


def effects(arms: DataFrame, keys: list[str]) -> DataFrame:
    """Main effects and interaction; any absent arm makes all three a refusal."""
    wide = arms_wide(arms, keys)
    absent = F.filter(F.array(*[F.when(F.col(a).isNull(), F.lit(a)) for a in ARMS]), lambda a: a.isNotNull())
    wide = wide.withColumn("absent", F.array_join(absent, ","))

    def contrast(weights: dict[str, float]) -> Column:
        total = F.lit(0.0)
        for arm, k in weights.items():
            total = total + F.col(arm) * k
        return F.when(F.col("absent") == "", total)

    refusal = F.when(F.col("absent") != "", F.concat(F.lit("absent arms: "), F.col("absent")))
    return wide.select(*keys, "contaminated", *[contrast(w).alias(n) for n, w in EFFECTS.items()], refusal.alias("refusal"))


def ladder(arms: DataFrame, keys: list[str], steps: list[tuple[str, str]]) -> DataFrame:
    """Arm differences; a missing side is a refusal row."""
    wide = arms_wide(arms, keys)
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{a}-{b}").alias("step"),
                (F.col(a) - F.col(b)).alias("delta"),
                F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit("missing_arm")).alias("refusal"),
            )
            for a, b in steps
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")


def leaderboard(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Worst disagreement with the scene it came from, and the other extremes.

    Equal maxima resolve to the lowest scene id.
    """
    return rows.groupBy(*keys).agg(
        F.count("*").alias("arms"),
        F.max("max_abs_code").alias("max_abs_code"),
        F.max_by("scene_id", F.struct("max_abs_code", -F.col("scene_id"))).alias("worst_scene_id"),
        F.avg("edge_mean").alias("edge_mean_mean"),
        F.max("edge_mean").alias("edge_mean_max"),
        F.min("identical").alias("identical_min"),
        F.bool_and("serialization_identical").alias("all_serialization_identical"),
    )


def recall(arms: DataFrame, populations: dict[str, Column], flags: list[str]) -> DataFrame:
    """Recall of each flag over each sub-population, in long form."""
    cells = [
        F.struct(F.lit(p).alias("population"), F.lit(f).alias("flag"), F.when(cond, F.col(f).cast("int")).alias("hit"))
        for p, cond in populations.items()
        for f in flags
    ]
    e = arms.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    d = e.groupBy("population", "flag").agg(F.count("hit").alias("arms"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return d.withColumn("recall", F.when(F.col("arms") > 0, F.col("hits") / F.nullif(F.col("arms"), F.lit(0))))


def field_contribution(arms: DataFrame, fields: str, names: list[str]) -> DataFrame:
    """Arms matched by each field, and arms only that field matched."""
    e = arms.select(F.explode(fields).alias("field"), (F.size(fields) == 1).alias("sole"))
    counted = e.groupBy("field").agg(F.count("*").alias("matched"), F.count_if("sole").alias("sole_source"))
    every = arms.sparkSession.createDataFrame([(n,) for n in names], "field string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return F.broadcast(every).join(counted, "field", "left").select("field", zero("matched"), zero("sole_source"))


def pruning_totals(arms: DataFrame, keys: list[str]) -> DataFrame:
    return arms.groupBy(*keys).agg(
        F.count("*").alias("arms"),
        F.count_if(F.col("budget_removed") > 0).alias("arms_with_budget_pruning"),
        F.sum("budget_removed").alias("budget_removed"),
        F.sum("dominated_removed").alias("dominated_removed"),
        F.count_if(F.col("budget_removed_truth") > 0).alias("arms_losing_a_true_candidate"),
        F.count_if((F.col("budget_removed_truth") > 0) & ~F.col("truth_kept")).alias("arms_losing_the_last_true_candidate"),
    )
