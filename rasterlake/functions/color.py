"""Colour and observation expressions (all whole-stage-codegen Columns)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CODE = 1.0 / 255.0


def srgb_to_linear(e: Column) -> Column:
    """IEC 61966-2-1 transfer, encoded [0,1] to linear light."""
    return F.when(e <= 0.04045, e / 12.92).otherwise(F.pow((e + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def clamp(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v))


def code_to_linear(v: Column) -> Column:
    return srgb_to_linear(v / 255.0)


def linear_to_code(v: Column) -> Column:
    return F.floor(linear_to_srgb(clamp(v)) * 255.0 + 0.5).cast("int")


def code_value(v: Column, blend: str) -> Column:
    """Value of an 8-bit code in a blend space."""
    return code_to_linear(v) if blend == "linear_light" else v * CODE


def code_step(v: Column, blend: str) -> Column:
    """The wider of the two code steps around ``v``, saturating at the ends."""
    here = code_value(v, blend)
    low = code_value(F.greatest(v - 1, F.lit(0)), blend)
    high = code_value(F.least(v + 1, F.lit(255)), blend)
    return F.greatest(F.abs(here - low), F.abs(high - here))


def premultiplied(channel: Column, alpha: Column) -> Column:
    return channel * alpha


def unpremultiplied(channel: Column, alpha: Column) -> Column:
    """NULL at zero alpha: the straight colour is not recoverable."""
    return F.when(alpha != 0, channel / alpha)


def observation(r: Column, g: Column, b: Column, a: Column, blend: str) -> dict[str, Column]:
    """Premultiplied vector ``p*`` and quantisation half-width ``q*``."""
    alpha = a * CODE
    out: dict[str, Column] = {}
    for name, v in (("r", r), ("g", g), ("b", b)):
        value = code_value(v, blend)
        out[f"p{name}"] = value * alpha
        out[f"q{name}"] = code_step(v, blend) * 0.5 * alpha + value * (0.5 * CODE)
    out["pa"] = alpha
    out["qa"] = F.lit(0.5 * CODE)
    return out


def alpha_class(alpha: Column) -> Column:
    half = 0.5 * CODE
    return F.when(alpha <= half, "transparent").when(alpha >= 1.0 - half, "opaque").otherwise("partial")


def premultiplied_delta(ca: Column, aa: Column, cb: Column, ab: Column) -> Column:
    """Disagreement of two straight 8-bit colours in premultiplied codes."""
    return F.abs(ca * aa / 255.0 - cb * ab / 255.0)


def paint_observation(channels: list[Column], opaque: Column, blend: str) -> list[Column]:
    """Observation of a linear paint at full coverage; transparent is zero."""
    encode = (lambda c: c) if blend == "linear_light" else (lambda c: linear_to_srgb(clamp(c)))
    return [F.when(opaque, encode(c)).otherwise(F.lit(0.0)) for c in channels] + [
        F.when(opaque, F.lit(1.0)).otherwise(F.lit(0.0))
    ]


# four-vectors as lists of flat columns ------------------------------------


def vec_sub(a: list[Column], b: list[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def vec_dot(a: list[Column], b: list[Column]) -> Column:
    total = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        total = total + p * q
    return total


def vec_norm(a: list[Column]) -> Column:
    return F.sqrt(vec_dot(a, a))


def vec_mix(b: list[Column], a: list[Column], t: Column) -> list[Column]:
    return [q + t * (p - q) for p, q in zip(a, b)]


def soft(x: Column, scale: float) -> Column:
    """Falloff 1 / (1 + (x/scale)^2)."""
    r = x / scale
    return F.lit(1.0) / (F.lit(1.0) + r * r)
