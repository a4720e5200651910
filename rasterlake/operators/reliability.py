"""Group verdicts, risk-coverage certificates and threshold sweeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.functions.stats import clopper_pearson_upper, required_groups
from rasterlake.operators.prefix import running


@dataclass(frozen=True)
class RiskTarget:
    confidence: float = 0.99
    risk: float = 0.01
    contaminated_profile: str = "R"


def scored(rows: DataFrame, target: RiskTarget) -> DataFrame:
    """Rows that may enter the reliability sample."""
    return rows.filter(F.col("profile") != target.contaminated_profile)


def group_flags(rows: DataFrame, keys: list[str], target: RiskTarget) -> DataFrame:
    """Per (keys, group) counts and flags; combines map-side, so a group that
    holds most rows is no hot spot."""
    must = F.col("mandatory")
    return (
        scored(rows, target)
        .groupBy(*keys, "group_id")
        .agg(
            F.bool_or(must).alias("seen"),
            F.bool_or(must & F.col("accepted")).alias("group_accepted"),
            F.bool_or(must & F.col("accepted") & F.col("catastrophic")).alias("group_catastrophic"),
            F.count("*").alias("renders"),
            F.count_if("accepted").alias("renders_accepted"),
        )
    )


def verdict() -> Column:
    return (
        F.when(F.col("group_catastrophic"), "accepted_catastrophic")
        .when(F.col("group_accepted"), "accepted_clean")
        .otherwise("abstained")
    )


def group_verdicts(rows: DataFrame, target: RiskTarget = RiskTarget()) -> DataFrame:
    """Verdict of every group with at least one mandatory, uncontaminated row."""
    return group_flags(rows, [], target).filter("seen").select("group_id", verdict().alias("verdict"))


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / F.nullif(den, F.lit(0))).otherwise(F.lit(0.0))


def certificate(counts: DataFrame, target: RiskTarget, refusal: Column) -> DataFrame:
    """Add coverage, the exact bound, the sample deficit and ``contract_met``
    to rows that carry group and render counts."""
    c = F.col
    d = counts.withColumn("required_groups", required_groups(F.lit(target.confidence), F.lit(target.risk)))
    d = d.withColumn("catastrophic_risk_upper", clopper_pearson_upper(c("groups_catastrophic"), c("groups_accepted"), target.confidence))
    return d.select(
        "*",
        ratio(c("groups_accepted"), c("groups_total")).alias("coverage_per_source"),
        ratio(c("renders_accepted"), c("renders_total")).alias("coverage_per_render"),
        F.greatest(c("required_groups") - c("groups_accepted"), F.lit(0)).cast("bigint").alias("group_deficit"),
        refusal.alias("likelihood_refusal"),
    ).withColumn(
        "contract_met",
        (c("group_deficit") == 0) & (c("catastrophic_risk_upper") < target.risk) & c("likelihood_refusal").isNull(),
    )


def risk_coverage(rows: DataFrame, keys: list[str], model: Column, calibrated: Column, target: RiskTarget = RiskTarget()) -> DataFrame:
    """Risk-coverage certificate of every bucket named by ``keys``.

    ``model`` is the declared residual model (NULL: none declared) and
    ``calibrated`` whether it was calibrated; what the guard refuses gets no
    certificate, whatever the counts say.
    """
    flags = group_flags(rows, keys, target)
    counts = flags.groupBy(*keys).agg(
        F.count_if("seen").alias("groups_total"),
        F.count_if("group_accepted").alias("groups_accepted"),
        F.count_if("group_catastrophic").alias("groups_catastrophic"),
        F.sum("renders").alias("renders_total"),
        F.sum("renders_accepted").alias("renders_accepted"),
    )
    return certificate(counts, target, confidence_guard(model, calibrated))


# Residual models that may carry a confidence claim, and the
# measured factor by which an independent-pixel model over-counts evidence.
ADMISSIBLE_MODELS = ("block", "covariance", "effective_sample_size")
IID_OVERCOUNT = 9.0


def confidence_guard(model: Column, calibrated: Column) -> Column:
    """Refusal text of a confidence claim, NULL when it may be made."""
    return (
        F.when(model.isNull(), "no residual model declared")
        .when(~model.isin(*ADMISSIBLE_MODELS), F.concat(F.lit("diagnostic residual model "), model))
        .when(~F.coalesce(calibrated, F.lit(False)), F.concat(F.lit("uncalibrated residual model "), model))
    )


@dataclass(frozen=True)
class SweepGates:
    min_source_coverage: float
    min_render_coverage: float
    max_px: float


def threshold_sweep(rows: DataFrame, score: str, gates: SweepGates, target: RiskTarget = RiskTarget()) -> DataFrame:
    """Certificate of accepting every row whose score reaches each threshold.

    Every distinct score is a threshold. Each row, and each group at its best
    score, contributes once, at the score where it becomes accepted; running sums
    over the scores then give all thresholds in one pass. ``selected`` marks the
    smallest eligible threshold. Rows without a score are never accepted but count
    in the totals. ``at95`` and ``at99`` are the row's measured samples within the
    two gates.
    """
    every = scored(rows, target).withColumn("__s", F.col(score).cast("double"))
    use = every.filter("__s is not null")
    must = F.col("mandatory")
    groups = use.groupBy("group_id").agg(
        F.bool_or(must).alias("seen"),
        F.max(F.when(must, F.col("__s"))).alias("from"),
        F.max(F.when(must & F.col("catastrophic"), F.col("__s"))).alias("bad_from"),
    )
    zero = F.lit(0).cast("bigint")
    sums = ["groups_accepted", "groups_catastrophic", "renders_accepted", "samples", "at95", "at99", "over"]

    def step(df: DataFrame, at: Column, **given: Column) -> DataFrame:
        return df.filter(at.isNotNull()).groupBy(at.alias("__s")).agg(*[F.sum(given.get(n, zero)).alias(n) for n in sums])

    one = F.lit(1).cast("bigint")
    rows_at = step(
        use, F.col("__s"), renders_accepted=one, samples=F.col("samples"), at95=F.col("at95"), at99=F.col("at99"),
        over=(F.col("max_px") > gates.max_px).cast("bigint"),
    )
    steps = (
        rows_at.unionByName(step(groups, F.col("from"), groups_accepted=one))
        .unionByName(step(groups, F.col("bad_from"), groups_catastrophic=one))
        .groupBy("__s")
        .agg(*[F.sum(n).alias(f"d_{n}") for n in sums])
        .withColumn("__desc", -F.col("__s"))
    )
    swept = running(steps, [], ["__desc"], {n: f"d_{n}" for n in sums})
    by_group = every.groupBy("group_id").agg(F.bool_or(must).alias("seen"), F.count("*").alias("n"))
    totals = by_group.agg(F.sum("n").alias("renders_total"), F.count_if("seen").alias("groups_total"))
    guard = confidence_guard(F.lit("block"), F.lit(True))  # the sweep runs under the calibrated block model
    cert = certificate(swept.crossJoin(F.broadcast(totals)), target, guard)  # totals is one row
    need = lambda q: F.ceil((F.col("samples") - 1) * q) + 1
    eligible = (
        F.col("contract_met")
        & (F.col("coverage_per_source") >= gates.min_source_coverage)
        & (F.col("coverage_per_render") >= gates.min_render_coverage)
        & (F.col("at95") >= need(0.95))
        & (F.col("at99") >= need(0.99))
        & (F.col("over") == 0)
        & (F.col("groups_catastrophic") == 0)
    )
    judged = cert.withColumn("eligible", eligible)
    best = judged.filter("eligible").agg(F.min("__s").alias("__best"))
    return (
        judged.crossJoin(F.broadcast(best))
        .withColumn("selected", F.coalesce(F.col("__s") == F.col("__best"), F.lit(False)))
        .withColumnRenamed("__s", "threshold")
    )
