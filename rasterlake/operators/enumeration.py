"""Formation hypotheses, degradation cells and identifiability classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.functions.color import clamp, linear_to_srgb

# Domains of the formation family, degradation axes and floors.
BLENDS = ("linear_light", "encoded_srgb")
FILTERS = ("box", "triangle", "gaussian_0.5", "gaussian_1")
OBSERVABILITY_FLOOR_PX = 0.35
QUANTIZATION_FLOOR_CODES = 1.0


def formations(palettes: DataFrame) -> DataFrame:
    """Blend x filter for every palette hypothesis, under its own exterior.

    The family is eight literal pairs, exploded in place: no join at all.
    """
    pairs = F.array(*[F.struct(F.lit(b).alias("blend"), F.lit(f).alias("filter")) for b in BLENDS for f in FILTERS])
    d = palettes.withColumn("__f", F.explode(pairs))
    ident = F.concat_ws("/", "__f.blend", "__f.filter", "exterior")
    return d.select(*palettes.columns, "__f.blend", "__f.filter", ident.alias("formation_id"))


def cell_id(size: Column, profile: Column, psf: Column, sigma: Column, blend: Column, resize: Column, dx: Column, dy: Column, contrast: Column) -> Column:
    kernel = F.when(psf == "gaussian", F.format_string("gauss%.2f", sigma)).otherwise(psf)
    short = F.when(blend == "linear_light", "lin").otherwise("srgb")
    return F.format_string("s%d_p%s_%s_%s_%s_dx%sdy%s_c%.2f", size, profile, kernel, short, resize, _hundredths(dx), _hundredths(dy), contrast)


def _hundredths(v: Column) -> Column:
    """Two digits, ties to the even one: phases are eighths, which engines print differently."""
    h = F.bround(v * 100, 0).cast("bigint")
    return F.format_string("%s%d.%02d", F.when(h < 0, "-").otherwise(""), F.floor(F.abs(h) / 100), F.abs(h) % 100)


def identifiability(
    scale_px: Column, separation: Column, size: Column, canvas: int, psf: Column, sigma: Column, resize: Column, contrast: Column, members: Column
) -> Column:
    """Lost information outranks equivalence; otherwise identifiable."""
    blur = F.when(psf == "box", 1.0).when(psf == "triangle", 2.0).otherwise(sigma * 2.0 + 1.0)
    penalty = F.when(resize == "up-from-half", 2.0).otherwise(1.0)
    effective = scale_px * size / float(canvas) / (blur * penalty)
    sep = separation * contrast
    codes = (linear_to_srgb(sep / 2.0 + 0.5) - linear_to_srgb(clamp(F.lit(0.5) - sep / 2.0))) * 255.0
    lost = (effective < OBSERVABILITY_FLOOR_PX) | (codes < QUANTIZATION_FLOOR_CODES)
    return F.when(lost, "information_lost").when(members > 1, "equivalent_family").otherwise("identifiable")
