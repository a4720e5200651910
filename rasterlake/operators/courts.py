"""Strata, tails, calibration tables and paired comparisons of measurements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.functions.codes import ceil_code, ceil_to_step, growth_ratio, next_code
from rasterlake.functions.stats import binomial_tail_half
from rasterlake.operators.quantiles import metric_quantiles


def by_axes(rows: DataFrame, axes: list[str]) -> DataFrame:
    """One copy of each row per axis, with ``axis`` and ``value``.

    Followed by an aggregation this is what GROUPING SETS with one set per axis
    plans to: an expand in front of a map-side combine.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    return rows.withColumn("__a", F.explode(pairs)).select("*", "__a.axis", "__a.value").drop("__a")


def count_map(rows: DataFrame, keys: list[str], label: Column, name: str) -> DataFrame:
    """MAP of label to count per key; labels come from a closed vocabulary."""
    counts = rows.groupBy(*keys, label.alias("__label")).agg(F.count("*").alias("__n"))
    entries = F.sort_array(F.collect_list(F.struct("__label", "__n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def stratified_summary(rows: DataFrame, axes: list[str]) -> DataFrame:
    """Counts, refusal maps and extremes of each value of each axis.

    ``worst_bits`` carries the ``p95_px`` of the row it came from; equal maxima
    are resolved to the larger companion so that the result is a function of the
    rows and not of their order.
    """
    long = by_axes(rows, axes)
    keys = ["axis", "value"]
    main = long.groupBy(*keys).agg(
        F.count("*").alias("renders"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(F.col("accepted") & F.col("catastrophic")).alias("catastrophic"),
        F.min("p99_px").alias("conditioning_min"),
        F.max("p99_px").alias("conditioning_max"),
        F.max(F.struct("bits_per_block", "p95_px")).alias("__worst"),
    )
    refused = long.filter(~F.col("accepted"))
    statuses = count_map(refused, keys, F.col("status"), "refusal_statuses")
    reasons = count_map(refused, keys, F.coalesce(F.col("reason"), F.lit("unclassified")), "refusal_reasons")
    return (
        main.join(statuses, keys, "left")
        .join(reasons, keys, "left")
        .select(
            "*",
            F.col("__worst.bits_per_block").alias("worst_bits"),
            F.col("__worst.p95_px").alias("worst_at_p95_px"),
        )
        .drop("__worst")
    )


def map_text(m: str) -> Column:
    """Stable text of a count map."""
    entries = F.array_sort(F.map_entries(m))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit(""))


def cost_histogram(rows: DataFrame, keys: list[str], refusals: str) -> DataFrame:
    """Sum of the exploded (family, reason, count) refusal entries."""
    e = rows.select(*keys, F.explode(refusals).alias("e"))
    return e.groupBy(*keys, F.concat_ws("/", "e.family", "e.reason").alias("cost")).agg(F.sum("e.count").alias("count"))


@dataclass(frozen=True)
class TailGates:
    p95_px: float
    p99_px: float
    max_px: float


def population_tail(rows: DataFrame, keys: list[str], gates: TailGates) -> DataFrame:
    """Pooled sample gates and render-tail quantiles of each key.

    Rows carry ``samples`` and ``at95``/``at99`` (samples at or below the gates).
    A row without samples, or counting more than it has, voids its key.
    """
    valid = (F.col("samples") > 0) & (F.col("at95") <= F.col("samples")) & (F.col("at99") <= F.col("samples"))
    valid = F.coalesce(valid & F.col("max_px").isNotNull(), F.lit(False))
    sums = rows.groupBy(*keys).agg(
        F.bool_and(valid).alias("complete"),
        F.sum("samples").alias("pooled_samples"),
        F.sum("at95").alias("__95"),
        F.sum("at99").alias("__99"),
        F.max("max_px").alias("max_px"),
    )
    tails = metric_quantiles(rows, keys, {"p95_px": {"render_p95_q95_px": ("ceil", 0.95)}, "p99_px": {"render_p99_q99_px": ("ceil", 0.99)}})
    need = lambda q: F.ceil((F.col("pooled_samples") - 1) * q) + 1
    only = lambda c: F.when(F.col("complete"), c)
    return sums.join(tails, keys).select(
        *keys,
        "complete",
        *[only(F.col(n)).alias(n) for n in ("pooled_samples", "max_px", "render_p95_q95_px", "render_p99_q99_px")],
        only(F.col("__95") >= need(0.95)).alias("p95_gate_met"),
        only(F.col("__99") >= need(0.99)).alias("p99_gate_met"),
        only(F.col("max_px") <= gates.max_px).alias("max_gate_met"),
    )


def supported_classes(rows: DataFrame, minimum: int = 2) -> DataFrame:
    """Classes seen in at least ``minimum`` distinct source groups."""
    return (
        rows.filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.countDistinct("group_id").alias("source_groups"))
        .filter(F.col("source_groups") >= minimum)
    )


def class_calibration(rows: DataFrame, minimum: int = 2) -> DataFrame:
    """Calibrated or excluded state of each class of accepted rows.

    A class with one catastrophic row is excluded as a whole.
    """
    d = (
        rows.filter(F.col("accepted") & F.col("class").isNotNull() & F.col("bits_per_block").isNotNull())
        .groupBy("class")
        .agg(
            F.count_if(~F.col("catastrophic")).alias("clean"),
            F.count_if("catastrophic").alias("catastrophic"),
            F.max(F.when(~F.col("catastrophic"), F.col("bits_per_block"))).alias("maximum_bits_per_block"),
        )
    )
    state = F.when(F.col("catastrophic") > 0, "excluded").when(F.col("clean") >= minimum, "calibrated").otherwise("too_few")
    return d.withColumn("state", state)


def admitted(rows: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Add ``admitted``: accepted and of a calibrated class.

    The class table is joined like any other; Catalyst broadcasts it when its
    measured size allows.
    """
    ok = calibrated.filter(F.col("state") == "calibrated").select("class", F.lit(True).alias("__ok"))
    return rows.join(ok, "class", "left").withColumn("admitted", F.col("accepted") & F.coalesce(F.col("__ok"), F.lit(False))).drop("__ok")


def origin_summary(rows: DataFrame, origin: str, required: list[str], source: str = "group_id", minimum: float = 0.5, total_minimum: float = 0.8) -> DataFrame:
    """Coverage per origin, with the rule of each origin and that of all sources.

    The origin rule wants exactly the ``required`` origins and the minimum in each of them. The total is the coverage of
    sources: the share of them with an admitted row.
    """
    d = rows.groupBy(F.col(origin).alias("origin")).agg(
        F.count("*").alias("groups_total"),
        F.count_if("accepted").alias("pipeline_accepted"),
        F.count_if("admitted").alias("admitted"),
        F.count_if(F.col("admitted") & F.col("catastrophic")).alias("catastrophic"),
    )
    overall = d.agg(
        F.min(F.col("admitted") / F.col("groups_total")).alias("__low"), F.count("*").alias("__n"), F.count_if(F.col("origin").isin(required)).alias("__known")
    )
    sources = rows.groupBy(source).agg(F.bool_or("admitted").alias("a")).agg((F.count_if("a") / F.count("*")).alias("source_coverage"))
    complete = (F.col("__n") == len(set(required))) & (F.col("__known") == F.col("__n"))
    return d.crossJoin(F.broadcast(overall)).crossJoin(F.broadcast(sources)).select(  # one row each
        "origin", "groups_total", "pipeline_accepted", "admitted", "catastrophic",
        (F.col("admitted") / F.col("groups_total")).alias("coverage"), "source_coverage",
        (complete & (F.col("__low") >= minimum)).alias("every_origin_met"),
        (F.col("source_coverage") >= total_minimum).alias("total_met"),
    )


def derive_gates(rows: DataFrame) -> DataFrame:
    """Outward-rounded row maxima over admitted clean rows, and p95 runtime."""
    clean = rows.filter(F.col("admitted") & ~F.col("catastrophic"))
    maxima = clean.agg(
        *[ceil_to_step(F.max(c), 0.25).alias(c) for c in ("p95_px", "p99_px", "max_px")],
        F.max("palette_delta").alias("paint_delta_codes"),
        ceil_code(F.max("channel_delta"), 8, 248).alias("internal_max_channel_delta"),
        ceil_to_step(F.max("bits_per_block"), 1.0 / 256).alias("internal_mean_delta"),
    )
    runtime = metric_quantiles(clean, [], {"runtime_ms": {"runtime_p95_ms": ("ceil", 0.95)}})
    return maxima.crossJoin(F.broadcast(runtime))  # one row each


# Safety caps and rounding steps of delivery calibration.
PROFILE_CHANNEL_CAP = 8
PROFILE_MEAN_CAP = 0.01
INTERNAL_CHANNEL_CAP = 128
INTERNAL_MEAN_CAP = 2.0
PROFILE_MEAN_STEP = 0.0025
INTERNAL_MEAN_STEP = 0.25


def delivery_calibration(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Delivery gates from observed maxima; beyond a safety cap is a refusal.

    Columns: ``profile_max``, ``profile_mean``, and two pairs ``internal_max_*``
    and ``internal_mean_*`` (pure, seam).
    """
    o = rows.groupBy(*keys).agg(
        F.count("*").alias("candidate_rows"),
        F.max("profile_max").alias("o_profile_max"),
        F.max("profile_mean").alias("o_profile_mean"),
        F.max(F.greatest("internal_max_pure", "internal_max_seam")).alias("o_internal_max"),
        F.max(F.greatest("internal_mean_pure", "internal_mean_seam")).alias("o_internal_mean"),
    )
    c = F.col
    missing = c("o_profile_max").isNull() | c("o_profile_mean").isNull() | c("o_internal_max").isNull() | c("o_internal_mean").isNull()
    beyond = (
        (c("o_profile_max") > PROFILE_CHANNEL_CAP)
        | (c("o_profile_mean") > PROFILE_MEAN_CAP)
        | (c("o_internal_max") > INTERNAL_CHANNEL_CAP)
        | (c("o_internal_mean") > INTERNAL_MEAN_CAP)
    )
    refusal = F.when(missing, "no_diagnostics").when(beyond, "exceeds_safety_envelope")
    ok = lambda v: F.when(c("refusal").isNull(), v)
    return o.withColumn("refusal", refusal).select(
        "*",
        ok(next_code(c("o_profile_max"), PROFILE_CHANNEL_CAP)).alias("gate_profile_max"),
        ok(F.least(ceil_to_step(c("o_profile_mean"), PROFILE_MEAN_STEP), F.lit(PROFILE_MEAN_CAP))).alias("gate_profile_mean"),
        ok(ceil_code(c("o_internal_max"), 8, INTERNAL_CHANNEL_CAP)).alias("gate_internal_max"),
        ok(F.least(ceil_to_step(c("o_internal_mean"), INTERNAL_MEAN_STEP), F.lit(INTERNAL_MEAN_CAP))).alias("gate_internal_mean"),
    )


# ---- paired comparison against a baseline ---------------------------------

KEY = ["group_id", "scene_id", "cell_id"]


def paired(selected: DataFrame, baseline: DataFrame) -> DataFrame:
    """Selected rows with their baseline (``b_`` columns) and ``pairing``.

    A row must have exactly one of a measured baseline and a typed refusal.
    """
    d = selected.join(baseline, KEY, "left")
    measured, refused = F.col("b_p95_px").isNotNull(), F.col("b_refusal").isNotNull()
    state = (
        F.when(measured & refused, "contradictory")
        .when(measured, "measured")
        .when(refused, "refused")
        .otherwise("missing")
    )
    return d.withColumn("pairing", state)


def tail_comparison(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """p95/p99/max of selected and baseline, regression and improvement."""
    use = pairs.filter(F.col("pairing") == "measured")
    q = metric_quantiles(
        use,
        keys,
        {
            "p95_px": {"selected_p95": ("ceil", 0.95)},
            "b_p95_px": {"baseline_p95": ("ceil", 0.95)},
            "p99_px": {"selected_p99": ("ceil", 0.99)},
            "b_p99_px": {"baseline_p99": ("ceil", 0.99)},
        },
    )
    m = use.groupBy(*keys).agg(F.max("max_px").alias("selected_max"), F.max("b_max_px").alias("baseline_max"))
    d = q.join(m, keys)
    tails = ("p95", "p99", "max")
    no_worse, better = F.lit(True), F.lit(False)
    for s in tails:
        no_worse = no_worse & (F.col(f"selected_{s}") <= F.col(f"baseline_{s}"))
        better = better | (F.col(f"selected_{s}") < F.col(f"baseline_{s}"))
    return d.select("*", no_worse.alias("no_tail_regression"), better.alias("strict_tail_improvement"))


def complexity_growth(pairs: DataFrame, keys: list[str], metrics: list[str], gate: float) -> DataFrame:
    """Ratio of summed complexity, selected over baseline, and its gate."""
    d = pairs.filter(F.col("pairing") == "measured").groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in metrics], *[F.sum(f"b_{m}").alias(f"b_{m}") for m in metrics]
    )
    ratios = [growth_ratio(F.col(m), F.col(f"b_{m}")).alias(f"{m}_growth") for m in metrics]
    d = d.select(*keys, *ratios)
    worst = F.greatest(*[F.col(f"{m}_growth") for m in metrics]) if len(metrics) > 1 else F.col(f"{metrics[0]}_growth")
    return d.withColumn("max_growth", worst).withColumn("gate_met", F.col("max_growth") <= gate)


@dataclass(frozen=True)
class BlindGates:
    p95_px: float = 0.25
    p99_px: float = 0.30
    max_px: float = 0.40
    palette_delta: int = 8
    min_trials: int = 10
    min_preference: float = 0.5
    max_p_value: float = 0.05


# Fixed value: cost charged per refused baseline row for segments and bytes.
REFUSED_COST = (2**64 - 1) // 1024


def blind_metrics(pairs: DataFrame, gates: BlindGates) -> DataFrame:
    """Per-group metric packets of both sides; refused baselines pay penalties."""
    c, measured = F.col, F.col("pairing") == "measured"
    either = lambda col, penalty: F.when(measured, c(col)).otherwise(F.lit(penalty))
    px = lambda v: F.round(v * 1e6).cast("decimal(38,0)")  # order-free sums of doubles
    big = lambda v: v.cast("decimal(38,0)")
    bad_base = ~measured | (c("b_palette_delta") > gates.palette_delta)
    return pairs.groupBy("group_id").agg(
        F.struct(
            big(F.count_if("catastrophic")).alias("catastrophic"),
            F.sum(px(c("p95_px"))).alias("p95"),
            F.sum(px(c("p99_px"))).alias("p99"),
            F.max(px(c("max_px"))).alias("worst"),
            F.sum(big(c("palette_delta"))).alias("palette"),
            F.sum(big(c("segments"))).alias("segments"),
            F.sum(big(c("bytes"))).alias("bytes"),
        ).alias("selected"),
        F.struct(
            big(F.count_if(bad_base)).alias("catastrophic"),
            F.sum(px(either("b_p95_px", gates.p95_px + 1))).alias("p95"),
            F.sum(px(either("b_p99_px", gates.p99_px + 1))).alias("p99"),
            F.max(px(either("b_max_px", gates.max_px + 1))).alias("worst"),
            F.sum(big(either("b_palette_delta", gates.palette_delta + 1))).alias("palette"),
            F.sum(big(either("b_segments", REFUSED_COST))).alias("segments"),
            F.sum(big(either("b_bytes", REFUSED_COST))).alias("bytes"),
        ).alias("baseline"),
    )


def blind_trials(metrics: DataFrame, label: str) -> DataFrame:
    """Blinded choice per group: the side is a digest bit, the packets are
    compared field by field (smaller wins), the identity is revealed after."""
    commitment = F.sha2(F.concat(F.lit(label + "|"), F.col("group_id").cast("string")), 256)
    d = metrics.withColumn("commitment", commitment)
    on_left = F.conv(F.substring("commitment", 1, 2), 16, 10).cast("int") % 2 == 0
    d = d.withColumn("selected_side", F.when(on_left, "left").otherwise("right"))
    left = F.when(on_left, F.col("selected")).otherwise(F.col("baseline"))
    right = F.when(on_left, F.col("baseline")).otherwise(F.col("selected"))
    d = d.withColumn("choice", F.when(left < right, "left").when(left > right, "right").otherwise("tie"))
    won = F.col("choice") == F.col("selected_side")
    tie = F.col("choice") == "tie"
    return d.select(
        "group_id", "commitment", "selected_side", "choice", won.alias("selected_preferred"), (~won & ~tie).alias("baseline_preferred")
    )


def blind_verdict(trials: DataFrame, gates: BlindGates) -> DataFrame:
    """Wins, ties, preference rate, exact one-sided p-value and the gate."""
    d = trials.agg(
        F.count("*").alias("source_trials"),
        F.count_if("selected_preferred").alias("selected_wins"),
        F.count_if("baseline_preferred").alias("baseline_wins"),
    )
    n = F.col("selected_wins") + F.col("baseline_wins")
    d = d.select("*", n.alias("non_tied_trials"), (F.col("source_trials") - n).alias("ties"))
    rate = F.when(F.col("non_tied_trials") > 0, F.col("selected_wins") / F.nullif(F.col("non_tied_trials"), F.lit(0))).otherwise(F.lit(0.0))
    d = d.select("*", rate.alias("preference_rate"), binomial_tail_half(F.col("selected_wins"), F.col("non_tied_trials")).alias("p_value"))
    met = (
        (F.col("source_trials") >= gates.min_trials)
        & (F.col("preference_rate") >= gates.min_preference)
        & (F.col("p_value") <= gates.max_p_value)
    )
    return d.withColumn("gate_met", met)


# ---- threshold join and verdicts ------------------------------------------


def against_gates(rows: DataFrame, keys: list[str], metrics: list[str], gates: DataFrame) -> DataFrame:
    """Every metric of every row next to its gate; a missing metric fails."""
    long = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "key", "value")
    d = long.join(F.broadcast(gates.select("section", "key", "gate")), "key")  # literal gate rows
    return d.withColumn("met", F.coalesce(F.col("value") <= F.col("gate"), F.lit(False)))


def release_verdict(refusals: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """``gate_met`` per subject: true exactly when no refusal was recorded.

    Refusal texts are a closed vocabulary, so the collected set stays small.
    """
    listed = refusals.groupBy(*keys).agg(F.array_sort(F.collect_set("refusal")).alias("refusals"))
    d = subjects.join(listed, keys, "left")
    return d.select(
        *keys,
        F.col("refusals").isNull().alias("gate_met"),
        F.coalesce(F.col("refusals"), F.array().cast("array<string>")).alias("refusals"),
    )


def recovery_by_mode(rows: DataFrame, minimum_rows: int, minimum_rate: float) -> DataFrame:
    """Recovery rate per mode; refused rows stay in the denominator."""
    d = rows.groupBy("mode").agg(
        F.count("*").alias("attempted"),
        F.count_if("measured").alias("measured"),
        F.count_if(~F.col("measured")).alias("refused"),
        F.count_if("recovered").alias("recovered"),
    )
    rate = F.col("recovered") / F.col("attempted")
    return d.select("*", rate.alias("recovery_rate"), ((F.col("measured") >= minimum_rows) & (rate >= minimum_rate)).alias("gate_met"))
