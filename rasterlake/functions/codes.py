"""Code lengths, robust losses and small numeric rules as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Geometry code table (bits), reference canvas side (px), the
# level grid, and free parameters / flag bits of each curve family.
BITS_PER_ANCHOR = 31.029146
BITS_PER_SEGMENT_FAMILY = 2.321928
BITS_PER_RELATION = 2.584963
REFERENCE_CANVAS_PX = 16384.0
LEVEL_QUANTA = 512
FAMILY_PARAMETERS = {
    "line": (0, 0.0),
    "circular_arc": (1, 2.0),
    "quadratic_bezier": (2, 0.0),
    "cubic_bezier": (4, 0.0),
}
# Two-sided normal quantile of each reported coverage level.
Z_TABLE = {
    0.50: 0.674489750196082,
    0.90: 1.644853626951472,
    0.95: 1.959963984540054,
    0.99: 2.575829303548901,
}

COORDINATE_PRECISION_PX = REFERENCE_CANVAS_PX / 2 ** (BITS_PER_ANCHOR / 2)


def rho(u: Column) -> Column:
    """Huber loss with unit knee."""
    a = F.abs(u)
    return F.when(a <= 1.0, a * a).otherwise(a * 2.0 - 1.0)


def student_bits(z2: Column, dof: float) -> Column:
    return F.log2(F.lit(1.0) + z2 / dof) * (0.5 * (dof + 1.0))


def residual_bits(deviation: Column, halfwidth: Column, precision: float = COORDINATE_PRECISION_PX) -> Column:
    """Quantised robust residual code of one observation, never negative."""
    loss = rho(deviation / halfwidth) / (2.0 * math.log(2.0))
    scale = F.log2(halfwidth * (math.sqrt(2 * math.pi) / precision))
    usable = halfwidth > 0
    return F.when(usable, F.greatest(loss + scale, F.lit(0.0))).otherwise(F.lit(float("inf")))


def quantize_level(v: Column) -> Column:
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.floor(bounded * LEVEL_QUANTA + 0.5).cast("int")


def dequantize_level(q: Column) -> Column:
    return q / float(LEVEL_QUANTA)


def log2_binomial(n: str, k: str) -> Column:
    """log2 C(n, k) from column names; infinite when k > n."""
    small = f"least({k}, {n} - {k})"
    terms = f"transform(sequence(0, {small} - 1), i -> log2({n} - i) - log2(i + 1.0D))"
    total = F.expr(f"aggregate({terms}, 0.0D, (acc, t) -> acc + t)")
    return (
        F.when(F.expr(f"{k} > {n}"), F.lit(float("inf")))
        .when(F.expr(f"{small} = 0"), F.lit(0.0))
        .otherwise(total)
    )


def gap_bits(n_samples: Column) -> Column:
    return F.log2((n_samples - 1).cast("double"))


def anchor_bits(canvas_px: Column) -> Column:
    return F.greatest(F.log2(canvas_px / REFERENCE_CANVAS_PX) * 2.0 + BITS_PER_ANCHOR, F.lit(0.0))


def coordinate_bits(canvas_px: Column) -> Column:
    return anchor_bits(canvas_px) * 0.5


def segment_bits(family: Column, canvas_px: Column) -> Column:
    params, flags = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (p, f) in FAMILY_PARAMETERS.items():
        params = F.when(family == name, F.lit(float(p))).otherwise(params)
        flags = F.when(family == name, F.lit(f)).otherwise(flags)
    return params * coordinate_bits(canvas_px) + flags + BITS_PER_SEGMENT_FAMILY


def z_for_coverage(level: Column) -> Column:
    """Tabulated only: any other level is NULL."""
    out = F.lit(None).cast("double")
    for p, z in Z_TABLE.items():
        out = F.when(F.abs(level - p) < 1e-9, F.lit(z)).otherwise(out)
    return out


def ceil_to_step(v: Column, step: float) -> Column:
    return F.when(v == 0, F.lit(0.0)).otherwise(F.ceil(v / step) * step)


def ceil_code(v: Column, step: int, cap: int) -> Column:
    """Up to the next multiple of ``step``, at most ``cap``."""
    return F.least(F.expr("0") + F.ceil(v / step) * step, F.lit(cap)).cast("bigint")


def next_code(v: Column, cap: int) -> Column:
    return F.least(v + 1, F.lit(cap)).cast("bigint")


GREATEST_DOUBLE = 1.7976931348623157e308


def growth_ratio(selected: Column, baseline: Column) -> Column:
    return (
        F.when((selected == 0) & (baseline == 0), F.lit(1.0))
        .when(baseline == 0, F.lit(GREATEST_DOUBLE))
        .otherwise(selected / F.nullif(baseline, F.lit(0)))
    )


def finite_entropy_bound(top: Column, classes: Column) -> Column:
    """Largest entropy of ``classes`` classes whose top mass is at least ``top``."""
    n = classes.cast("double")
    rest = F.lit(1.0) - top
    binary = F.when(rest <= 0, F.lit(0.0)).otherwise(-top * F.log2(top) - rest * F.log2(rest))
    tail = F.when(rest <= 0, F.lit(0.0)).otherwise(rest * F.log2(n - 1))
    return (
        F.when((classes <= 0) | (top < 0) | (top > 1) | F.isnan(top), F.lit(None).cast("double"))
        .when(classes == 1, F.lit(0.0))
        .when(top <= F.lit(1.0) / n, F.log2(n))
        .otherwise(binary + tail)
    )


def position_uncertainty(
    quant: Column, mismatch: Column, noise: Column, gradient: Column, curvature: Column, z: Column, cap: float = 4.0
) -> dict[str, Column]:
    """Corridor of one boundary point from its coverage-domain uncertainty."""
    sigma_alpha = F.sqrt(quant * quant / 3.0 + mismatch * mismatch + noise * noise)
    slope = F.greatest(F.abs(gradient), F.lit(1e-9))
    sigma_pos = sigma_alpha / slope
    bias = F.abs(curvature) / (slope * 8.0)
    raw = z * sigma_pos + bias
    return {
        "sigma_pos": sigma_pos,
        "bias": bias,
        "halfwidth": F.least(raw, F.lit(cap)),
        "capped": raw > cap,
        "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - (sigma_pos + bias) / cap)),
    }


def lower_bound_mass(truncated: Column, given: Column, selected: Column, explored: Column, unexplored: Column) -> Column:
    """Effective posterior lower bound: given when the search was complete."""
    total = explored + unexplored
    return F.when(truncated == F.lit(False), given).when((selected >= 0) & (total > 0), selected / F.nullif(total, F.lit(0.0)))


def median_length(rho_: Column) -> Column:
    """Correlation length from a lag-1 correlation, at least one pixel."""
    a = F.abs(rho_)
    return F.when((a > 0) & (a < 1), F.greatest(F.lit(-1.0) / F.ln(a), F.lit(1.0))).otherwise(F.lit(1.0))
