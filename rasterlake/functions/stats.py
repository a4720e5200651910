"""Exact binomial bounds for already aggregated rows.

These run on one row per bucket, never per input row, so an Arrow-batched
scalar UDF is enough.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _lower_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function.

    Numerators and denominators are followed forwards as ratios, each row until
    its own value stands still; rows that have settled leave the loop.
    """
    out = np.empty_like(x)
    left = np.arange(len(x))
    up, down = np.ones(len(x)), np.zeros(len(x))  # ratios of neighbouring numerators and denominators
    value = np.ones(len(x))
    step = 0
    while len(left):
        step += 1
        m = step // 2
        p, q, t = a[left], b[left], x[left]
        if step % 2 == 0:
            d = m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            d = -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
        up = 1.0 + d / np.where(up == 0, 1e-300, up)
        down = 1.0 / np.where((now := 1.0 + d * down) == 0, 1e-300, now)
        factor = up * down
        value = value * factor
        settled = np.abs(factor - 1.0) < 1e-16
        settled |= (np.abs(factor - 1.0) < 4e-16) & (step > 8)
        out[left[settled]] = value[settled]
        keep = ~settled
        left, up, down, value = left[keep], up[keep], down[keep], value[keep]
    return 1.0 / out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised I_x(a, b), elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (x < 1.0)
    if not inside.any():
        return out
    p, q, t = a[inside], b[inside], x[inside]
    flip = t > (p + 1.0) / (p + q + 2.0)
    pp, qq, tt = np.where(flip, q, p), np.where(flip, p, q), np.where(flip, 1.0 - t, t)
    front = np.exp(
        _lgamma(pp + qq) - _lgamma(pp) - _lgamma(qq) + pp * np.log(tt) + qq * np.log1p(-tt)
    )
    value = front * _lower_fraction(pp, qq, tt) / pp
    out = out.copy()
    out[inside] = np.where(flip, 1.0 - value, value)
    return out


def upper_bound(failures, trials, confidence: float) -> np.ndarray:
    """One-sided upper Clopper-Pearson bound; no trials bound nothing (1)."""
    k, n = (np.asarray(v, dtype=float) for v in (failures, trials))
    open_ = (n > 0) & (k < n)
    a, b = np.where(open_, k + 1, 1.0), np.where(open_, n - k, 1.0)
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        below = incomplete_beta(a, b, mid) < confidence
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        if np.all(hi - lo <= 1e-16):
            break
    return np.where(open_, 0.5 * (lo + hi), 1.0)


def clopper_pearson_upper(failures: Column, trials: Column, confidence: float) -> Column:
    """The bound of aggregated counts: a closed form without failures, and the
    search once for each distinct pair of the others."""

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        pairs, back = np.unique(np.stack([k.fillna(0).to_numpy(), n.fillna(0).to_numpy()]), axis=1, return_inverse=True)
        return pd.Series(upper_bound(pairs[0], pairs[1], confidence)[back.ravel()])

    some = failures > 0
    searched = bound(F.when(some, failures).cast("double"), F.when(some, trials).cast("double"))
    return F.when(some, searched).otherwise(zero_failure_bound(trials, confidence))


def incomplete_beta_column(a: Column, b: Column, x: Column) -> Column:
    @F.pandas_udf("double")
    def value(p: pd.Series, q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(incomplete_beta(p.to_numpy(), q.to_numpy(), t.to_numpy()))

    return value(a.cast("double"), b.cast("double"), x.cast("double"))


def log_gamma_column(x: Column) -> Column:
    @F.pandas_udf("double")
    def value(v: pd.Series) -> pd.Series:
        return pd.Series(_lgamma(v.to_numpy(dtype=float)))

    return value(x.cast("double"))


def zero_failure_bound(trials: Column, confidence: float) -> Column:
    """Closed form of the bound for no failures."""
    return F.when(trials > 0, F.lit(1.0) - F.pow(F.lit(1.0 - confidence), F.lit(1.0) / trials)).otherwise(F.lit(1.0))


def required_groups(confidence: Column, risk: Column) -> Column:
    """Least n whose zero-failure bound lies below ``risk``."""
    guess = F.ceil(F.ln(F.lit(1.0) - confidence) / F.ln(F.lit(1.0) - risk))
    met = lambda n: (F.lit(1.0) - F.pow(F.lit(1.0) - confidence, F.lit(1.0) / n)) < risk
    return (
        F.when((guess > 1) & met(guess - 1), guess - 1).when(met(guess), guess).otherwise(guess + 1).cast("bigint")
    )


def binomial_tail_half(wins: Column, trials: Column) -> Column:
    """P(X >= wins) for a fair coin, via the symmetric incomplete beta
    I_1/2(wins, trials - wins + 1): the same cost for any number of trials."""
    safe_wins, safe_trials = F.greatest(wins, F.lit(1)), F.greatest(trials, F.lit(1))
    tail = incomplete_beta_column(safe_wins, safe_trials - safe_wins + 1, F.lit(0.5))
    return F.when((trials == 0) | (wins <= 0), F.lit(1.0)).otherwise(tail)
