"""Two-colour mixtures, residual indicators, kernels and likelihoods."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.functions.codes import median_length, student_bits
from rasterlake.functions.color import CODE, clamp, premultiplied_delta, vec_dot, vec_mix, vec_norm, vec_sub
from rasterlake.operators.contours import contour_summary
from rasterlake.operators.quantiles import index_quantiles
from rasterlake.operators.regions import region_shapes
from rasterlake.operators.stencil import around, core, neighbours, shifted, tiled
from rasterlake.session import cut

KEYS = ["image_id"]
CH = "rgba"
RGB = "rgb"
MIN_CONDITIONING = 0.02
MAX_REGIONS = 16


def mixture(px: DataFrame, pairs: DataFrame) -> DataFrame:
    """Coverage, residual, slope and flatness under a two-colour hypothesis.

    ``pairs``: image_id and the observed vectors f* and b* of foreground and
    background. An ill-conditioned pair is a ``refusal`` and has no coverage.
    """
    d = px.join(pairs, KEYS)
    p, f, b = ([F.col(f"{k}{c}") for c in CH] for k in "pfb")
    axis = vec_sub(f, b)
    den = vec_dot(axis, axis)
    d = d.withColumn("conditioning", F.sqrt(den))
    d = d.withColumn("refusal", F.when(F.col("conditioning") < MIN_CONDITIONING, "ill_conditioned"))
    cover = clamp(vec_dot(vec_sub(p, b), axis) / F.nullif(den, F.lit(0.0)))
    d = d.withColumn("alpha", F.when(F.col("refusal").isNull(), cover))
    rest = vec_sub(p, vec_mix(b, f, F.col("alpha")))
    d = d.withColumns(
        {
            "residual": vec_norm(rest),
            "signed": vec_dot(rest, axis) / F.greatest(F.col("conditioning"), F.lit(1e-12)),
            "alpha_quant": vec_norm([F.col(f"q{c}") for c in CH]) / F.nullif(F.col("conditioning"), F.lit(0.0)),
        }
    )
    keep = [*KEYS, "x", "y", "pa", "alpha", "residual", "signed", "alpha_quant", "conditioning", "refusal"]
    t = around(tiled(d.select(*keep), KEYS), KEYS, ["alpha"], diagonal=False)
    at = lambda n: F.col(f"{n}.alpha")
    here = F.col("alpha")
    hyp = lambda a, c: F.sqrt(a * a + c * c)
    slope = hyp((at("e") - at("w")) * 0.5, (at("s") - at("n")) * 0.5)
    side = lambda a, c: F.least(F.abs(here - at(a)), F.abs(at(c) - here))
    return core(t.withColumns({"gradient": slope, "flatness": hyp(side("w", "e"), side("n", "s"))}).drop("e", "w", "n", "s"))


# Intermediate coverage, flatness in units of the coverage noise, least area and least thickness (px)
# of a semi-transparent interior.
INTERMEDIATE = (0.08, 0.92)
FLAT_RATIO = 8.0
MIN_FLAT_AREA = 24
MIN_THICKNESS = 2.0


def semi_transparent(mix: DataFrame, min_area: int = MIN_FLAT_AREA) -> DataFrame:
    """Largest flat region of intermediate coverage of each image that has one of ``min_area`` pixels.

    Of regions of equal area the first in scan order counts. Returns image_id, largest_region_px, thickness (twice the
    area over the perimeter), regions, coverage, coverage_span and flat_px of all such regions.
    """
    c = F.col
    flat = (c("alpha") > INTERMEDIATE[0]) & (c("alpha") < INTERMEDIATE[1]) & (c("flatness") <= F.greatest("alpha_quant", F.lit(1e-9)) * FLAT_RATIO)
    px = mix.filter(c("refusal").isNull() & flat).select(*KEYS, "x", "y", F.lit(1).alias("label"), "alpha")
    shapes = region_shapes(px, "label", "alpha").withColumn("span", c("high") - c("low"))
    best = F.max_by(F.struct("area", "perimeter", "mean", "span"), F.struct("area", -c("region")))
    d = shapes.groupBy(*KEYS).agg(best.alias("b"), F.count("*").alias("regions"), F.sum("area").alias("flat_px"))
    return d.filter(c("b.area") >= min_area).select(
        *KEYS, c("b.area").alias("largest_region_px"), (c("b.area") * 2.0 / c("b.perimeter")).alias("thickness"), "regions",
        c("b.mean").alias("coverage"), c("b.span").alias("coverage_span"), "flat_px",
    )


def residual_indicators(mix: DataFrame) -> DataFrame:
    """Mean, p95 and max residual in codes, mass on mixed pixels, mean run.

    A run of equal residual sign starts at the row start or where the sign of
    the left neighbour differs, so counting runs needs one neighbour only.
    """
    d = mix.filter("refusal is null").withColumns({"codes": F.col("residual") * 255.0, "sign": F.signum(F.round("signed", 12)).cast("int")})
    near = neighbours(d.select(*KEYS, "x", "y", "codes", "sign", "pa"), KEYS, ["sign"], clamp=False, diagonal=False)
    start = F.col("w.sign").isNull() | (F.col("w.sign") != F.col("sign"))
    mixed = (F.col("pa") > CODE) & (F.col("pa") < 1.0 - CODE)
    s = near.groupBy(*KEYS).agg(
        F.avg("codes").alias("mean_codes"), F.max("codes").alias("max_codes"), F.sum("codes").alias("__t"),
        F.sum(F.when(mixed, F.col("codes")).otherwise(F.lit(0.0))).alias("__m"), (F.count("*") / F.count_if(start)).alias("mean_run_px"),
    )
    q = index_quantiles(near, KEYS, "codes", {"p95_codes": ("floor", 0.95)})
    # an image without a channel has no residual and keeps its row
    share = F.when(F.col("__t") == 0, F.lit(0.0)).otherwise(F.col("__m") / F.nullif(F.col("__t"), F.lit(0.0)))
    return s.join(q, KEYS, "left").select(*KEYS, "mean_codes", "p95_codes", "max_codes", share.alias("mixed_mass"), "mean_run_px")


# Kernel, transition width (px) and its spread, and the rules.
KERNELS = [
    ("box", 0.797, 0.187),
    ("triangle", 1.020, 0.046),
    ("gaussian_0.35", 0.936, 0.100),
    ("gaussian_0.5", 1.197, 0.039),
    ("gaussian_0.75", 1.760, 0.040),
    ("gaussian_1", 2.370, 0.040),
    ("gaussian_1.5", 3.502, 0.046),
    ("gaussian_2", 4.618, 0.040),
]
KERNEL_MARGIN = 2.0
MIN_RESOLVED = 0.25


def transition_width(px: DataFrame, v: str = "alpha") -> DataFrame:
    """Undecided mass per contour length, and the resolved share of coverage."""
    a = F.col(v)
    m = px.groupBy(*KEYS).agg(F.sum(a * 4.0 * (F.lit(1.0) - a)).alias("mass"), F.count_if(a >= 0.98).alias("__full"), F.count_if(a > 0.02).alias("__some"))
    d = m.join(contour_summary(px, 0.5, v).select(*KEYS, "length"), KEYS)
    width = F.when(F.col("length") > 0, F.col("mass") / F.nullif(F.col("length"), F.lit(0.0))).otherwise(F.lit(0.0))
    share = F.when(F.col("__some") > 0, F.col("__full") / F.nullif(F.col("__some"), F.lit(0))).otherwise(F.lit(0.0))
    return d.select(*KEYS, "length", width.alias("width"), share.alias("resolved"))


def kernel_choice(px: DataFrame, v: str = "alpha") -> DataFrame:
    """Kernels within the margin of the best, or the refusal of an image.

    The kernel table is a literal of eight rows carried as one array.
    """
    d = transition_width(px, v)
    z = lambda w, sd: (F.col("width") - w) / sd
    scored = F.array(*[F.struct(F.lit(n).alias("kernel"), (z(w, sd) * z(w, sd) * 0.5).alias("penalty")) for n, w, sd in KERNELS])
    best = F.array_min(F.transform(F.col("k"), lambda k: k["penalty"]))
    refusal = F.when(F.col("resolved") < MIN_RESOLVED, "unresolved").when(F.col("length") <= 0, "no_contour")
    d = d.withColumns({"k": scored, "refusal": refusal}).withColumn("best", best)
    kept = F.when(F.col("refusal").isNull(), F.filter("k", lambda k: k["penalty"] <= F.col("best") + KERNEL_MARGIN))
    out = d.select(*KEYS, "width", "resolved", "refusal", F.explode_outer(kept).alias("e"))
    return out.select(*KEYS, "width", "resolved", "refusal", "e.kernel", "e.penalty")


# Fixed value: scores of opaque readings that are this close are equal.
SCORE_TIE = 1e-9


def two_colour_outcome(evidence: DataFrame, max_p95: float, min_thickness: float = MIN_THICKNESS) -> DataFrame:
    """Outcome per image from scored hypotheses of several mixture classes.

    Columns: image_id, class, id, conditioned (whether the colour pair could be
    separated at all), score, p95, thickness (of a flat semi-transparent interior,
    else NULL), palette_refusal. The best hypothesis of each class counts; of
    opaque ones (class ``opaque:...``) with equal scores that with the least id.
    """
    c = F.col
    low = evidence.filter("conditioned").groupBy(*KEYS, "class").agg(F.min("score").alias("__low"))
    slack = F.when(c("class").startswith("opaque:"), SCORE_TIE).otherwise(0.0)
    near = evidence.filter("conditioned").join(low, [*KEYS, "class"]).filter(c("score") <= c("__low") + slack)
    best = near.groupBy(*KEYS, "class").agg(F.min_by(F.struct("p95", "thickness"), c("id")).alias("b"))
    sums = best.groupBy(*KEYS).agg(
        F.count_if(c("b.thickness").isNull() & (c("b.p95") <= max_p95)).alias("explaining"),
        F.min(F.when(c("b.thickness").isNotNull(), F.struct("class", c("b.thickness").alias("t")))).alias("semi"),
    )
    images = evidence.groupBy(*KEYS).agg(F.max("palette_refusal").alias("palette_refusal"), F.bool_or("conditioned").alias("__any"))
    d = images.join(sums, KEYS, "left").na.fill(0, ["explaining"])
    outcome = (
        F.when(c("palette_refusal").isNotNull(), "unsupported_palette")
        .when(~c("__any"), "unsupported_no_well_conditioned_pair")
        .when((c("explaining") == 0) & (c("semi.t") >= min_thickness), "unsupported_semi_transparent")
        .when((c("explaining") == 0) & c("semi").isNotNull(), "ambiguous_thin")
        .when(c("explaining") == 0, "unsupported_no_explanation")
        .when(c("explaining") == 1, "supported")
        .otherwise("ambiguous")
    )
    return d.select(*KEYS, "explaining", outcome.alias("outcome"))


# Fixed value: spread of residuals of a clean reading, in codes.
CLEAN_SIGMA = 25.57


def mixture_evidence(px: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scored readings for ``two_colour_outcome`` from pixels and colour pairs alone.

    ``px`` as for ``mixture``; ``pairs``: image_id, class, id and the two colours. Every reading is a raster of its own,
    keyed by (image, class, id), so all readings of all images are judged in one pass over the pixels.
    """
    reading = F.struct(*KEYS, "class", "id")
    wide = px.join(pairs.select(*KEYS, "class", "id"), KEYS).withColumn("image_id", reading)
    colours = pairs.withColumn("image_id", reading).drop("class", "id")
    mix = cut(mixture(wide, colours))
    facts = mix.groupBy(*KEYS).agg(F.bool_and(F.col("refusal").isNull()).alias("conditioned"))
    residuals = residual_indicators(mix).select(*KEYS, F.col("p95_codes").alias("p95"))
    d = facts.join(residuals, KEYS, "left").join(semi_transparent(mix).select(*KEYS, "thickness"), KEYS, "left")
    z = F.col("p95") / CLEAN_SIGMA
    return d.select("image_id.*", "conditioned", (z * z * 0.5).alias("score"), "p95", "thickness", F.lit(None).cast("string").alias("palette_refusal"))


def otsu(px: DataFrame, code: str = "code") -> DataFrame:
    """Otsu threshold of a 256-bin histogram; the lowest best bin wins.

    The histogram is at most 256 rows per image, so its running sums are bounded.
    """
    h = px.groupBy(*KEYS, F.col(code).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEYS).orderBy("bin")
    whole = Window.partitionBy(*KEYS)
    d = h.select(
        *KEYS, "bin", F.sum("n").over(w).alias("nb"), F.sum(F.col("bin") * F.col("n")).over(w).alias("sb"), F.sum("n").over(whole).alias("n"),
        F.sum(F.col("bin") * F.col("n")).over(whole).alias("s"),
    )
    nf = F.col("n") - F.col("nb")
    gap = F.col("sb") / F.col("nb") - (F.col("s") - F.col("sb")) / F.nullif(nf, F.lit(0))
    d = d.withColumn("var", F.when((nf > 0) & (F.col("bin") < 255), F.col("nb") * nf * gap * gap))
    return d.groupBy(*KEYS).agg(F.coalesce(F.max_by("bin", F.struct(F.round("var", 6), -F.col("bin"))), F.lit(0)).alias("threshold"))


# ---- image difference, likelihoods ------------------------------------------


def image_difference(pairs: DataFrame, edge: Column) -> DataFrame:
    """Premultiplied code differences of two images: max, frame and edge mean.

    Columns: r, g, b, a and r2, g2, b2, a2.
    """
    deltas = [premultiplied_delta(F.col(c), F.col("a"), F.col(c + "2"), F.col("a2")) for c in "rgb"] + [F.abs(F.col("a") - F.col("a2")).cast("double")]
    d = pairs.withColumns({"__max": F.greatest(*deltas), "__mean": (deltas[0] + deltas[1] + deltas[2] + deltas[3]) / 4.0, "__edge": edge})
    return d.groupBy(*KEYS).agg(
        F.max("__max").alias("max_code"), F.avg("__mean").alias("frame_mean"),
        F.coalesce(F.avg(F.when(F.col("__edge"), F.col("__mean"))), F.lit(0.0)).alias("edge_mean"),
        F.count_if("__edge").alias("edge_pixels"), F.avg((F.col("__max") == 0).cast("double")).alias("identical"),
    )


def dead_zone(diff: Column, q: Column) -> Column:
    return F.signum(diff) * F.greatest(F.abs(diff) - q, F.lit(0.0))


def block_likelihood(res: DataFrame, block: int, sigma: float, dof: float = 4.0) -> DataFrame:
    """Robust bits of per-block mean energy; one block is one observation."""
    b = res.groupBy(*KEYS, F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by")).agg(F.avg(F.col("r") * F.col("r")).alias("e"))
    return b.groupBy(*KEYS).agg(F.sum(student_bits(F.col("e") / sigma**2, dof)).alias("pixel_bits"), F.count("*").alias("blocks"))


@dataclass(frozen=True)
class LikelihoodConfig:
    sigma: tuple[float, float, float, float]
    block: int = 4
    dof: float = 4.0


PRIORS = ("topology_bits", "geometry_bits", "paint_bits", "relation_bits", "formation_bits")


def raster_likelihood(px: DataFrame, cfg: LikelihoodConfig, priors: DataFrame, rois: DataFrame | None = None) -> DataFrame:
    """Code length of an observed raster under a prediction, over all four channels, with its diagnostics.

    ``px``: image_id, x, y and, per channel, the observation p*, its quantisation q* and the prediction m*. ``priors``:
    image_id and the bits of ``PRIORS``. ``rois``: image_id, x0, y0, x1, y1, halo; of images that have one only the blocks
    that meet the grown region are scored, while the diagnostics always cover the whole raster. One observation is a block
    and channel. Columns: pixel_bits, total_bits, blocks, deadzone (components without a residual), iid_bits (every
    pixel as an observation of its own), lag_x, lag_y (pooled over the channels), length_px.
    """
    c = F.col
    d = px.select(*KEYS, "x", "y", *[dead_zone(c(f"p{ch}") - c(f"m{ch}"), c(f"q{ch}")).alias(f"r{ch}") for ch in CH])
    near = neighbours(d, KEYS, [f"r{ch}" for ch in CH], clamp=False, diagonal=False)
    over = lambda f: sum((f(ch) for ch in CH), F.lit(0.0))
    sums = {
        **{f"e{ch}": c(f"r{ch}") ** 2 for ch in CH},
        "deadzone": over(lambda ch: (c(f"r{ch}") == 0).cast("int")).cast("long"),
        "iid_bits": over(lambda ch: student_bits((c(f"r{ch}") / cfg.sigma[CH.index(ch)]) ** 2, cfg.dof)),
    }
    for n, k in (("e", "x"), ("s", "y")):
        has = c(f"{n}.ra").isNotNull()
        sums |= {
            f"dot_{k}": F.when(has, over(lambda ch: c(f"r{ch}") * c(f"{n}.r{ch}"))), f"own_{k}": F.when(has, over(lambda ch: c(f"r{ch}") ** 2)),
            f"far_{k}": F.when(has, over(lambda ch: c(f"{n}.r{ch}") ** 2)),
        }
    low = {a: F.floor(c(a) / cfg.block) * cfg.block for a in "xy"}
    blocks = near.groupBy(*KEYS, low["x"].alias("bx"), low["y"].alias("by")).agg(
        F.count("*").alias("n"), (F.max("x") + 1).alias("ex"), (F.max("y") + 1).alias("ey"), *[F.sum(e).alias(k) for k, e in sums.items()]
    )
    scored = F.lit(True)
    if rois is not None:
        blocks = blocks.join(rois, KEYS, "left")
        meets = (c("bx") < c("x1") + c("halo")) & (c("ex") > c("x0") - c("halo")) & (c("by") < c("y1") + c("halo")) & (c("ey") > c("y0") - c("halo"))
        scored = F.coalesce(meets, F.lit(True))
    bits = over(lambda ch: student_bits(c(f"e{ch}") / c("n") / cfg.sigma[CH.index(ch)] ** 2, cfg.dof))
    rest = [k for k in sums if not (k[0] == "e" and len(k) == 2)]
    s = blocks.groupBy(*KEYS).agg(F.coalesce(F.sum(F.when(scored, bits)), F.lit(0.0)).alias("pixel_bits"), F.count_if(scored).alias("blocks"), *[F.sum(k).alias(k) for k in rest])
    # least and greatest skip NULL, so what has no correlation is 0 before it is clamped
    rho = lambda k: clamp(F.coalesce(c(f"dot_{k}") / F.nullif(F.sqrt(c(f"own_{k}") * c(f"far_{k}")), F.lit(0.0)), F.lit(0.0)), -1.0, 1.0)
    s = s.withColumns({"lag_x": rho("x"), "lag_y": rho("y")}).join(priors, KEYS)
    total = c("pixel_bits")
    for name in PRIORS:
        total = total + c(name)
    return s.select(*KEYS, "pixel_bits", total.alias("total_bits"), "blocks", "deadzone", "iid_bits", "lag_x", "lag_y", median_length(F.greatest(F.abs("lag_x"), F.abs("lag_y"))).alias("length_px"))


def lag_correlation(res: DataFrame) -> DataFrame:
    """Lag-1 correlation along x and y and the implied correlation length."""
    d = neighbours(res.select(*KEYS, "x", "y", "r"), KEYS, ["r"], clamp=False, diagonal=False)
    sums = []
    for n, k in (("e", "x"), ("s", "y")):
        o = F.col(f"{n}.r")
        has = o.isNotNull()
        sums += [F.sum(F.col("r") * o).alias(f"d{k}"), F.sum(F.when(has, F.col("r") ** 2)).alias(f"a{k}"), F.sum(o * o).alias(f"b{k}")]
    s = d.groupBy(*KEYS).agg(*sums)
    rho = lambda k: clamp(F.coalesce(F.col(f"d{k}") / F.nullif(F.sqrt(F.col(f"a{k}") * F.col(f"b{k}")), F.lit(0.0)), F.lit(0.0)), -1.0, 1.0)
    s = s.select(*KEYS, rho("x").alias("lag_x"), rho("y").alias("lag_y"))
    return s.withColumn("length_px", median_length(F.greatest(F.abs("lag_x"), F.abs("lag_y"))))


def basis(kind: str, size: int) -> list[list[float]]:
    """Rows of the orthonormal 1-D transform: cosine, Hadamard or identity."""
    if kind == "cosine":
        norm = lambda u: math.sqrt((1 if u == 0 else 2) / size)
        return [[norm(u) * math.cos((2 * x + 1) * u * math.pi / (2 * size)) for x in range(size)] for u in range(size)]
    if kind == "hadamard":
        return [[0.5 * (-1) ** (bin(u & x).count("1")) for x in range(4)] for u in (0, 1, 2, 3)]
    return [[float(u == x) for x in range(size)] for u in range(size)]


def transform_energy(res: DataFrame, kind: str, size: int) -> DataFrame:
    """DC and AC root mean square of block transforms over the whole table.

    The 1-D basis travels as a literal array; a pixel meets its row coefficients
    first and its column coefficients second, each followed by a combining sum.
    Rasters whose sides are no multiple of the block are expected padded.
    """
    rows = F.array(*[F.array(*[F.lit(c) for c in r]) for r in basis(kind, size)])
    u = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    block = [F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by")]
    coef = lambda k, p: F.element_at(F.element_at(rows, F.col(k) + 1), (F.col(p) % size + 1).cast("int"))
    h = res.withColumn("u", u).groupBy(*KEYS, *block, "y", "u").agg(F.sum(coef("u", "x") * F.col("r")).alias("h"))
    v = h.withColumn("v", u).groupBy(*KEYS, "bx", "by", "u", "v").agg(F.sum(coef("v", "y") * F.col("h")).alias("t"))
    dc = (F.col("u") == 0) & (F.col("v") == 0)
    rms = lambda cond: F.sqrt(F.avg(F.when(cond, F.col("t") * F.col("t"))))
    return v.agg(rms(dc).alias("dc_rms"), rms(~dc).alias("ac_rms"), F.count_if(dc).alias("blocks"))


# Per source format the transform and its block size, the spreads of the first, of the other and of alpha
# coefficients in codes, and the degrees of freedom.
CODECS = {"clean": ("identity", 2, 25.57, 25.57, 25.57), "jpeg": ("cosine", 8, 32.37, 14.84, 1.0), "webp": ("hadamard", 4, 44.17, 13.45, 1.0)}
CODEC_DOF = 4.0


def padded(res: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows for blocks that are not full: the last row and column of a raster stand again beyond its sides."""
    size = res.groupBy(*keys).agg(F.max("x").alias("__x"), F.max("y").alias("__y"))
    more = lambda c: F.when(F.col(c) == F.col(f"__{c}"), block - 1 - F.col(c) % block).otherwise(0).cast("int")
    spread = lambda d, c: d.withColumn(c, F.explode(F.sequence(F.col(c), F.col(c) + more(c))))
    return spread(spread(res.join(size, keys), "x"), "y").drop("__x", "__y")


def block_coefficients(res: DataFrame, keys: list[str], kind: str, block: int) -> DataFrame:
    """(keys, bx, by, u, v, c*): transform of the residuals d* of all four channels, block by block.

    The 1-D basis travels as a literal array; a pixel meets its row coefficients first and its column coefficients
    second, each followed by a combining sum. Channels share both sums.
    """
    rows = F.array(*[F.array(*[F.lit(c) for c in r]) for r in basis(kind, block)])
    u = F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
    at = lambda k, p: F.element_at(F.element_at(rows, F.col(k) + 1), (F.col(p) % block + 1).cast("int"))
    place = [F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by")]
    d = padded(res, keys, block)
    if kind == "identity":
        return d.select(*keys, *place, (F.col("x") % block).alias("u"), (F.col("y") % block).alias("v"), *[F.col(f"d{c}").cast("double").alias(f"c{c}") for c in CH])
    h = d.withColumn("u", u).groupBy(*keys, *place, "y", "u").agg(*[F.sum(at("u", "x") * F.col(f"d{c}")).alias(f"h{c}") for c in CH])
    return h.withColumn("v", u).groupBy(*keys, "bx", "by", "u", "v").agg(*[F.sum(at("v", "y") * F.col(f"h{c}")).alias(f"c{c}") for c in CH])


def codec_bits(res: DataFrame, keys: list[str], codec: str) -> DataFrame:
    """Code length of the residuals of all four channels under a source format: keys, blocks, coefficients, bits."""
    kind, block, first, other, alpha = CODECS[codec]
    d = block_coefficients(res, keys, kind, block)
    sigma = F.when((F.col("u") == 0) & (F.col("v") == 0), first).otherwise(other)
    bits = [student_bits((F.col(f"c{c}") / sigma) ** 2, CODEC_DOF) for c in RGB] + [student_bits((F.col("ca") / alpha) ** 2, CODEC_DOF)]
    return d.groupBy(*keys).agg(
        F.count_if((F.col("u") == 0) & (F.col("v") == 0)).alias("blocks"), (F.count("*") * 4).alias("coefficients"), F.sum(bits[0] + bits[1] + bits[2] + bits[3]).alias("bits")
    )


def codec_spread(res: DataFrame, keys: list[str], codec: str) -> DataFrame:
    """Root mean squares of first, other and alpha coefficients under a source format: keys, dc_rms, ac_rms, alpha_rms."""
    kind, block, *_ = CODECS[codec]
    d = block_coefficients(res, keys, kind, block)
    dc = (F.col("u") == 0) & (F.col("v") == 0)
    square = F.col("cr") ** 2 + F.col("cg") ** 2 + F.col("cb") ** 2
    rms = F.sqrt  # NULL where there is no coefficient to average
    return d.groupBy(*keys).agg(
        rms(F.avg(F.when(dc, square)) / 3).alias("dc_rms"), rms(F.avg(F.when(~dc, square)) / 3).alias("ac_rms"), rms(F.avg(F.col("ca") ** 2)).alias("alpha_rms")
    )


def hard_paints(px: DataFrame, min_support: float) -> DataFrame:
    """Weighted mean colour of each region; weight = evidence / max(q, 1/510)^2."""
    w = F.col("weight") / F.greatest(F.col("q"), F.lit(1 / 510)) ** 2
    d = px.groupBy(*KEYS, "label").agg(F.count("*").alias("support"), (F.sum(w * F.col("v")) / F.sum(w)).alias("__p"))
    refusal = F.when(F.col("support") < min_support, "insufficient_support")
    return d.select(*KEYS, "label", "support", refusal.alias("refusal"), F.when(refusal.isNull(), F.col("__p")).alias("paint"))


def soft_paints(cover: DataFrame, px: DataFrame, min_support: float, ridge: float) -> DataFrame:
    """Colours of regions that share pixels, by weighted least squares in each channel.

    ``cover``: image_id, x, y, label, coverage, at most ``MAX_REGIONS`` labels in an image; a row may be left out where the
    coverage is 0. ``px``: image_id, x, y, weight and, per channel, v* and q*. Sums of the normal equations combine before
    the shuffle, label pairs of a pixel are made from its own short list; each image then solves one small system in a
    group of its own. The ridge is relative to the largest diagonal entry, or to 1. If a region of an image has less
    than ``min_support`` pixels the image is refused. Returns image_id, label, support, refusal, paint_r, paint_g, paint_b.
    """
    c = F.col
    per_pixel = cover.groupBy(*KEYS, "x", "y").agg(F.collect_list(F.struct("label", "coverage")).alias("own"))
    d = px.join(per_pixel, [*KEYS, "x", "y"]).withColumn("j", F.explode("own")).withColumn("k", F.explode("own"))
    d = d.filter(c("j.label") <= c("k.label"))
    diagonal = c("j.label") == c("k.label")
    weight = {ch: c("weight") / F.greatest(c(f"q{ch}"), F.lit(1 / 510)) ** 2 for ch in RGB}
    sums = [F.sum(weight[ch] * c("j.coverage") * c("k.coverage")).alias(f"n{ch}") for ch in RGB]
    sums += [F.sum(F.when(diagonal, weight[ch] * c("j.coverage") * c(f"v{ch}"))).alias(f"t{ch}") for ch in RGB]
    sums += [F.sum(F.when(diagonal, c("j.coverage"))).alias("support")]
    normal = d.groupBy(*KEYS, c("j.label").alias("j"), c("k.label").alias("k")).agg(*sums)
    kinds = {f.name: f.dataType.simpleString() for f in normal.schema}
    schema = f"image_id {kinds['image_id']}, label {kinds['j']}, support double, refusal string, paint_r double, paint_g double, paint_b double"

    def solve(rows):
        import numpy as np
        import pandas as pd

        own = rows[rows.j == rows.k].sort_values("j")
        labels = own.j.to_numpy()
        if len(labels) > MAX_REGIONS:
            raise ValueError(f"an image has {len(labels)} regions, at most {MAX_REGIONS} may share one system")
        out = pd.DataFrame({"image_id": rows.image_id.iloc[0], "label": labels, "support": own.support.to_numpy(), "refusal": None})
        enough = bool((own.support >= min_support).all())
        if not enough:
            out["refusal"] = "insufficient_support"
        a, b = np.searchsorted(labels, rows.j), np.searchsorted(labels, rows.k)
        for ch in RGB:
            system = np.zeros((len(labels), len(labels)))
            system[a, b] = system[b, a] = rows[f"n{ch}"]
            system[np.diag_indices(len(labels))] += ridge * max(1.0, float(system.diagonal().max()))
            out[f"paint_{ch}"] = np.linalg.solve(system, own[f"t{ch}"].to_numpy()) if enough else None
        return out

    return normal.groupBy(*KEYS).applyInPandas(solve, schema)


def soft_paint_score(cover: DataFrame, px: DataFrame, paints: DataFrame) -> DataFrame:
    """Sum of w * ((sum of coverage * paint - observation) / q)^2 over pixels and channels, for images that were solved."""
    known = paints.filter("refusal is null").select(*KEYS, "label", *[f"paint_{ch}" for ch in RGB])
    mixed = cover.join(known, [*KEYS, "label"]).groupBy(*KEYS, "x", "y").agg(*[F.sum(F.col("coverage") * F.col(f"paint_{ch}")).alias(f"m{ch}") for ch in RGB])
    z = [(F.col(f"m{ch}") - F.col(f"v{ch}")) / F.greatest(F.col(f"q{ch}"), F.lit(1 / 510)) for ch in RGB]
    return px.join(mixed, [*KEYS, "x", "y"]).groupBy(*KEYS).agg(F.sum(F.col("weight") * (z[0] ** 2 + z[1] ** 2 + z[2] ** 2)).alias("score"))


def fixed_paint_score(px: DataFrame, paints: DataFrame) -> DataFrame:
    """Sum of w * ((prediction - observation) / q)^2 for given paints."""
    z = (F.col("paint") - F.col("v")) / F.greatest(F.col("q"), F.lit(1 / 510))
    return px.join(paints.select(*KEYS, "label", "paint"), [*KEYS, "label"]).groupBy(*KEYS).agg(F.sum(F.col("weight") * z * z).alias("score"))


def autocorrelation(res: DataFrame, max_lag: int) -> DataFrame:
    """Correlation length along x and y over active pixels, effective sample.

    One tile partitioning with a halo of ``max_lag`` serves every lag.
    """
    active = F.abs("r") > 1e-12
    m = res.filter(active).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.var_pop("r").alias("var"))
    t = tiled(res.select(*KEYS, "x", "y", F.when(active, F.col("r")).alias("r")), KEYS, halo=max_lag)
    names = [(a, k) for a in "xy" for k in range(1, max_lag + 1)]
    # an image without active pixels has an effective size of 1
    t = core(t.withColumns({f"{a}{k}": shifted(t, KEYS, "r", k, a) for a, k in names})).join(m, KEYS, "left").na.fill(0, ["n"])
    acc = [F.avg((F.col("r") - F.col("mean")) * (F.col(f"{a}{k}") - F.col("mean"))).alias(f"{a}{k}") for a, k in names]
    d = t.groupBy(*KEYS, "n", "var").agg(*acc)
    rho = lambda a, k: F.when(F.col("var") > 0, F.coalesce(F.col(f"{a}{k}") / F.nullif(F.col("var"), F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    first = lambda a: F.least(*[F.when(rho(a, k) < 1 / math.e, F.lit(k)) for k in range(1, max_lag + 1)])
    d = d.withColumns({"length_x": first("x"), "length_y": first("y")})
    lx, ly = F.coalesce("length_x", F.lit(max_lag)), F.coalesce("length_y", F.lit(max_lag))
    eff = F.greatest(F.col("n") / ((lx * 2 - 1) * (ly * 2 - 1)), F.lit(1.0))
    return d.select(*KEYS, F.col("n").alias("active"), "length_x", "length_y", eff.alias("effective"), (F.col("n") / eff).alias("overcount"))
