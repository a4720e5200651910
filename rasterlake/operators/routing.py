"""Lane choice and catastrophic-kind lists as ordered expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the route rule.
MAX_CHAINS = 8
MIN_MODES = 3
MIN_DOMINANT_SHARE = 0.85
MAX_FOREGROUND_SHARE = 0.40
STROKE_WIDTH_SHARE = 0.08
MIN_STROKE_WIDTH_PX = 4.0


def stroke_first(foreground: Column, median_width: Column, width: Column, height: Column) -> Column:
    limit = F.greatest(F.lit(MIN_STROKE_WIDTH_PX), F.least(width, height) * STROKE_WIDTH_SHARE)
    return (foreground <= MAX_FOREGROUND_SHARE) & (median_width <= limit)


def route_decision(facts: DataFrame) -> DataFrame:
    """Add ``lane``, ``reason`` and the ``observations`` made on the way.

    The rules are tried in order; an observation is listed for every rule that
    was looked at before one decided.
    """
    c = F.col
    strokes = stroke_first(c("foreground_share"), c("median_width_px"), c("width"), c("height"))
    simple = c("supported") & (c("chains") <= MAX_CHAINS)
    flat = (c("palette_modes") >= MIN_MODES) & (c("dominant_share") >= MIN_DOMINANT_SHARE)
    smooth = c("opaque") & (c("dominant_share") < MIN_DOMINANT_SHARE)
    ramp = smooth & (c("gradient_margin_bits") > 0)
    regions = c("palette_modes") > 0
    rules = [
        (simple & strokes, "line_art", "thin strokes outrank two-colour evidence"),
        (simple, "two_colour", "supported two-colour evidence"),
        (flat, "multi_region", "concentrated palette"),
        (ramp, "gradient", "smooth gradient"),
        (strokes, "line_art", "thin strokes"),
        (regions, "multi_region", "regions after other refusals"),
    ]
    lane, reason = F.lit("none"), F.lit("no lane")
    for cond, name, why in reversed(rules):
        lane, reason = F.when(cond, name).otherwise(lane), F.when(cond, why).otherwise(reason)

    def seen(when: Column, name: str, accepted: bool, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("lane"), F.lit(accepted).alias("accepted"), detail.alias("detail")))

    past_flat = ~simple & ~flat
    past_ramp = past_flat & ~ramp
    observations = F.array(
        seen(simple & strokes, "two_colour", False, F.lit("thin strokes")),
        seen(simple & ~strokes, "two_colour", True, F.lit("supported")),
        seen(c("supported") & (c("chains") > MAX_CHAINS), "two_colour", False, F.format_string("%s chains exceed the cap", c("chains"))),
        seen(~c("supported"), "two_colour", False, F.lit("not supported")),
        seen(simple & strokes, "line_art", True, F.lit("stroke evidence")),
        seen(~simple & flat, "multi_region", True, F.format_string("%s modes", c("palette_modes"))),
        seen(past_flat & ~smooth, "gradient", False, F.lit("has alpha or concentrated colours")),
        seen(past_flat & smooth, "gradient", False, F.lit("no margin")),
        seen(past_flat & ramp, "gradient", True, F.lit("positive margin")),
        seen(past_ramp & strokes, "line_art", True, F.lit("stroke evidence")),
        seen(past_ramp & ~strokes, "line_art", False, F.lit("too fill-like")),
        seen(past_ramp & ~strokes, "multi_region", True, F.lit("regions found")),
    )
    listed = F.filter(observations, lambda o: o.isNotNull() & ~((o["lane"] == "gradient") & (o["detail"] == "no margin") & (c("gradient_margin_bits") > 0)))
    return facts.select("*", lane.alias("lane"), reason.alias("reason"), listed.alias("observations"))


def catastrophic_kinds(
    available: Column,
    topology_exact: Column,
    verified: Column,
    delivery: list[tuple[Column, Column]],
    palette: tuple[Column, Column],
) -> Column:
    """Kinds of catastrophic failure of a row, empty without a candidate.

    ``delivery`` and ``palette`` are (delta, gate) pairs; a missing delta counts
    as exceeded.
    """
    beyond = lambda pair: pair[0].isNull() | (pair[0] > pair[1])
    mismatch = F.lit(False)
    for pair in delivery:
        mismatch = mismatch | beyond(pair)
    kinds = F.array(
        F.when(~F.coalesce(topology_exact, F.lit(False)), "wrong_visible_topology"),
        F.when(~F.coalesce(verified, F.lit(False)), "verification_failure"),
        F.when(mismatch, "serialized_mismatch"),
        F.when(beyond(palette), "wrong_paint_or_missing_face"),
    )
    return F.when(available, F.filter(kinds, lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))
