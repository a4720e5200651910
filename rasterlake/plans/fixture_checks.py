"""The derived tables themselves, summarised, against their SQL form."""

from pyspark.sql import functions as F

from rasterlake.registry import query


@query("fx_px8", "px8s", "SELECT image_id, x, y, round(alpha, 6) AS alpha, code FROM px8s")
def px8s(t):
    return t.px8s().select("image_id", "x", "y", F.round("alpha", 6).alias("alpha"), "code")


@query("fx_rgba8", "rgba8", "SELECT image_id, x, y, r, g, b, a FROM rgba8")
def rgba8(t):
    return t.rgba8()


@query("fx_mosaic", "mosaic", "SELECT label, x, y, round(alpha, 6) AS alpha FROM mosaic")
def mosaic(t):
    return t.mosaic().select("label", "x", "y", F.round("alpha", 6).alias("alpha"))


@query("fx_grid", "grid", "SELECT image_id, x, y, round(v, 6) AS v FROM grid")
def grid(t):
    return t.grid().select("image_id", "x", "y", F.round("v", 6).alias("v"))


@query("fx_segments", "segments", "SELECT chain_id, sid, x1, y1, x2, y2 FROM segments")
def segments(t):
    return t.segments()
