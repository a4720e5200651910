"""Colour modes, palettes, border evidence and two-colour proposals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.functions.color import CODE, clamp, code_to_linear, linear_to_code, vec_norm, vec_sub
from rasterlake.operators.stencil import FOUR, neighbours
from rasterlake.session import cut

KEYS = ["image_id"]
CORE_WEIGHT = 0.5
WEIGHT_UNIT = 2.0**20  # weights are summed as integers, so sums do not depend on order


@dataclass(frozen=True)
class PaletteConfig:
    opaque_alpha_codes: float = 1.0
    transparent_alpha_codes: float = 1.0
    bin_codes: int = 4
    min_separation_codes: float = 6.0
    min_mode_share: float = 0.02
    min_core_weight: float = 8.0
    min_exterior_share: float = 0.002


def is_opaque(cfg: PaletteConfig) -> Column:
    return F.col("a") * CODE >= 1.0 - cfg.opaque_alpha_codes * CODE


def is_transparent(cfg: PaletteConfig) -> Column:
    return F.col("a") * CODE <= cfg.transparent_alpha_codes * CODE


def mark_border(px: DataFrame) -> DataFrame:
    """Flag the frame pixels of each raster."""
    size = px.groupBy(*KEYS).agg(F.max("x").alias("__w"), F.max("y").alias("__h"))
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("__w")) | (F.col("y") == F.col("__h"))
    return px.join(size, KEYS).withColumn("border", edge).drop("__w", "__h")


def bin_key(cfg: PaletteConfig) -> Column:
    return F.struct(*[F.floor(F.col(c) / cfg.bin_codes).cast("int").alias(c) for c in "rgb"])


def colour_histogram(px: DataFrame, cfg: PaletteConfig = PaletteConfig()) -> DataFrame:
    """Weighted colour bins of opaque interior pixels.

    Columns in: r, g, b, a, weight, border. At most 64^3 bins per image.
    """
    d = px.filter(is_opaque(cfg) & (F.col("weight") > 0)).withColumn("fx", F.round(F.col("weight") * WEIGHT_UNIT).cast("bigint"))
    return d.groupBy(*KEYS, bin_key(cfg).alias("bin")).agg(
        F.sum("fx").alias("fx"),
        F.count("*").alias("pixels"),
        F.count_if("border").alias("border_pixels"),
        F.sum(F.when(F.col("weight") >= CORE_WEIGHT, F.col("fx")).otherwise(F.lit(0))).alias("core_fx"),
    )


def separation(a: list[Column], b: list[Column]) -> Column:
    """Largest channel difference in 8-bit codes."""
    return F.greatest(*[F.abs(p - q) for p, q in zip(a, b)])


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a lambda instead of repeating its expression."""
    return F.transform(F.array(value), body)[0]


MODE_TYPE = "array<struct<r:double,g:double,b:double,cr:int,cg:int,cb:int,fx:bigint,pixels:bigint,border_pixels:bigint>>"


def merge_modes(hist: DataFrame, cfg: PaletteConfig = PaletteConfig()) -> DataFrame:
    """Greedy merge of the bins of each image into modes.

    The rule depends on the order (weight down, then key), so it is a fold over
    the sorted bins of an image, at most 64^3 of them, as one SQL aggregate.
    Adds ``modes`` and ``assigned`` (mode number of each bin, from 1).
    """
    mid = lambda k: F.floor(F.least(F.col(f"bin.{k}") * cfg.bin_codes + cfg.bin_codes / 2.0, F.lit(255.0)))
    d = hist.withColumns({k: code_to_linear(mid(k)) for k in "rgb"}).withColumns({f"c{k}": mid(k).cast("int") for k in "rgb"})
    sums = ["fx", "pixels", "border_pixels"]
    item = F.struct((-F.col("fx")).alias("order"), "bin", *[*"rgb"], "cr", "cg", "cb", *sums)
    lists = d.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("bins"), F.sum("core_fx").alias("core_fx"))
    start = F.struct(F.array().cast(MODE_TYPE).alias("modes"), F.array().cast("array<int>").alias("to"))
    codes = lambda m: [m[f"c{k}"] for k in "rgb"]

    def merged(m: Column, e: Column) -> Column:
        total = m["fx"] + e["fx"]
        mean = F.struct(*[((m[k] * m["fx"] + e[k] * e["fx"]) / total).alias(k) for k in "rgb"])
        return let(
            mean,
            lambda c: F.struct(
                *[c[k].alias(k) for k in "rgb"], *[linear_to_code(c[k]).alias(f"c{k}") for k in "rgb"], *[(m[n] + e[n]).alias(n) for n in sums]
            ),
        )

    def step(s: Column, e: Column) -> Column:
        near = F.transform(s["modes"], lambda m: separation(codes(m), codes(e)) < cfg.min_separation_codes)

        def apply(at: Column) -> Column:
            fresh = F.struct(*[e[k].alias(k) for k in [*"rgb", "cr", "cg", "cb", *sums]])
            replaced = F.transform(s["modes"], lambda m, i: F.when(i + 1 == at, merged(m, e)).otherwise(m))
            modes = F.when(at == 0, F.concat(s["modes"], F.array(fresh))).otherwise(replaced)
            to = F.when(at == 0, F.size(s["modes"]) + 1).otherwise(at).cast("int")
            return F.struct(modes.alias("modes"), F.concat(s["to"], F.array(to)).alias("to"))

        return let(F.array_position(near, F.lit(True)), apply)

    folded = lists.withColumn("f", F.aggregate("bins", start, step))
    assigned = F.zip_with("bins", "f.to", lambda b, m: F.struct(b["bin"].alias("bin"), m.alias("mode")))
    return folded.select(*KEYS, "core_fx", F.col("f.modes").alias("modes"), assigned.alias("assigned"))


def find_modes(px: DataFrame, cfg: PaletteConfig = PaletteConfig()) -> DataFrame:
    """Supported modes of each image, ranked by weight and encoded colour.

    A mode stays with a large enough share of the weight, or when its members
    that touch another member carry enough weight.
    """
    merged = cut(merge_modes(colour_histogram(px, cfg), cfg))  # read three times below
    total = F.aggregate("modes", F.lit(0).cast("bigint"), lambda a, m: a + m["fx"])
    listed = merged.select(*KEYS, total.alias("total"), F.posexplode("modes").alias("i", "m")).select(
        *KEYS, "total", (F.col("i") + 1).alias("mode"), "m.*"
    )
    where = merged.select(*KEYS, F.explode("assigned").alias("s")).select(*KEYS, "s.bin", "s.mode")
    members = px.filter(is_opaque(cfg) & (F.col("weight") > 0)).withColumn("bin", bin_key(cfg)).join(where, [*KEYS, "bin"])
    near = neighbours(members.select(*KEYS, "x", "y", "mode", "weight"), KEYS, ["mode"], clamp=False, diagonal=False)
    touches = F.greatest(*[F.coalesce(F.col(f"{n}.mode") == F.col("mode"), F.lit(False)) for n in FOUR])
    support = near.filter(touches).groupBy(*KEYS, "mode").agg(F.sum(F.round(F.col("weight") * WEIGHT_UNIT).cast("bigint")).alias("coherent"))
    d = listed.join(support, [*KEYS, "mode"], "left")
    keep = (F.col("fx") / F.col("total") >= cfg.min_mode_share) | (F.coalesce("coherent", F.lit(0)) >= cfg.min_core_weight * WEIGHT_UNIT)
    d = d.filter(keep)
    # modes of one image: bounded by the bins that were merged
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("fx"), "cr", "cg", "cb", "mode"))
    return d.withColumn("rank", rank)


# ---- border and residual evidence -------------------------------------------


def border_shares(px: DataFrame, colours: DataFrame, cfg: PaletteConfig = PaletteConfig()) -> DataFrame:
    """Share of frame pixels near each named colour (``cr`` NULL: transparent).

    ``colours`` holds a few named colours per image: image_id, name, cr, cg, cb.
    """
    frame = px.filter("border").select(*KEYS, "r", "g", "b", "a")
    hit = F.when(F.col("cr").isNull(), is_transparent(cfg)).otherwise(
        is_opaque(cfg) & (separation([F.col(c) for c in "rgb"], [F.col(f"c{c}") for c in "rgb"]) < cfg.min_separation_codes)
    )
    return frame.join(colours, KEYS).groupBy(*KEYS, "name").agg(F.avg(hit.cast("double")).alias("share"))


def coherent_residual(px: DataFrame, background: DataFrame, cfg: PaletteConfig = PaletteConfig()) -> DataFrame:
    """Opaque pixels unlike the background that touch another such pixel."""
    far = separation([F.col(c) for c in "rgb"], [F.col(f"c{c}") for c in "rgb"]) >= cfg.min_separation_codes
    rest = px.join(background.select(*KEYS, "cr", "cg", "cb"), KEYS).filter(is_opaque(cfg) & far)
    near = neighbours(rest.select(*KEYS, "x", "y", F.lit(True).alias("m")), KEYS, ["m"], clamp=False, diagonal=False)
    touches = F.greatest(*[F.col(f"{n}.m").isNotNull() for n in FOUR])
    n = near.groupBy(*KEYS).agg(F.count_if(touches).alias("coherent"))
    out = background.select(*KEYS).distinct().join(n, KEYS, "left").withColumn("coherent", F.coalesce("coherent", F.lit(0)))
    return out.withColumn("supported", F.col("coherent") >= cfg.min_core_weight)


# ---- bounded colour intervals -----------------------------------------------


def coverage_interval(px: DataFrame, cfg: PaletteConfig = PaletteConfig()) -> DataFrame:
    """Colour of the most opaque visible pixel with its amplified quantisation.

    Columns in: x, y, r, g, b, a and the cells q*. Ties go to the first pixel.
    """
    d = px.filter(~is_transparent(cfg))
    first = F.struct("a", -F.col("y"), -F.col("x"))
    best = d.groupBy(*KEYS).agg(F.max_by(F.struct("r", "g", "b", "a", "qr", "qg", "qb", "qa"), first).alias("p"), F.count("*").alias("support"))
    q = vec_norm([F.col(f"p.q{c}") for c in "rgba"]) / (F.col("p.a") * CODE)
    d = best.select(*KEYS, "support", q.alias("halfwidth"), *[code_to_linear(F.col(f"p.{c}")).alias(c) for c in "rgb"])
    ends = {}
    for c in "rgb":
        ends[f"lo_{c}"], ends[f"hi_{c}"] = clamp(F.col(c) - F.col("halfwidth")), clamp(F.col(c) + F.col("halfwidth"))
    return d.withColumns(ends)


def gamut_interval(px: DataFrame, background: DataFrame) -> DataFrame:
    """Ray from the background through the most distant pixel to the gamut wall.

    ``background``: image_id, br, bg, bb in linear light. Pixels carry p* in the
    encoded space. No row when every pixel equals the background.
    """
    from rasterlake.functions.color import linear_to_srgb

    seen = [linear_to_srgb(clamp(F.col(f"b{c}"))) for c in "rgb"] + [F.lit(1.0)]
    d = px.join(background, KEYS).withColumn("d", vec_norm(vec_sub([F.col(f"p{c}") for c in "rgba"], seen)))
    far = F.max_by(F.struct("d", "r", "g", "b", "br", "bg", "bb"), F.struct(F.round("d", 9), -F.col("y"), -F.col("x")))
    e = d.groupBy(*KEYS).agg(far.alias("e")).select(*KEYS, "e.*").filter(F.col("d") > 0)
    walk = {f"v{c}": code_to_linear(F.col(c)) - F.col(f"b{c}") for c in "rgb"}
    e = e.withColumns(walk)
    wall = lambda c: (
        F.when(F.col(f"v{c}") > 1e-12, (F.lit(1.0) - F.col(f"b{c}")) / F.nullif(F.col(f"v{c}"), F.lit(0.0)))
        .when(F.col(f"v{c}") < -1e-12, -F.col(f"b{c}") / F.nullif(F.col(f"v{c}"), F.lit(0.0)))
        .otherwise(F.lit(1.0))
    )
    e = e.withColumn("t", F.greatest(F.lit(1.0), *[wall(c) for c in "rgb"]))
    at = lambda c, t: clamp(F.col(f"b{c}") + t * F.col(f"v{c}"))
    ends = {}
    for c in "rgb":
        ends[f"lo_{c}"], ends[f"hi_{c}"] = at(c, F.lit(1.0)), at(c, F.col("t"))
    e = e.withColumns(ends)
    span = vec_norm([F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "rgb"]) * 0.5
    mid = [((F.col(f"lo_{c}") + F.col(f"hi_{c}")) * 0.5).alias(f"m{c}") for c in "rgb"]
    return e.select(*KEYS, *[f"lo_{c}" for c in "rgb"], *[f"hi_{c}" for c in "rgb"], *mid, span.alias("halfwidth"))


# ---- two-colour proposals ---------------------------------------------------


def propose_two_colour(px: DataFrame, cfg: PaletteConfig = PaletteConfig()) -> DataFrame:
    """Two-colour hypotheses of each image, or the reason there is none.

    Decided by (has exterior, number of modes). Columns in: those of the interior
    field plus ``border``. One row per hypothesis, or one refusal row.
    """
    keep = [*KEYS, "x", "y", "r", "g", "b", "a", "weight", "border", *[f"{k}{c}" for k in "pq" for c in "rgba"]]
    px = cut(px.select(*keep))  # six branches read it
    modes = cut(find_modes(px, cfg))
    core = colour_histogram(px, cfg).groupBy(*KEYS).agg((F.sum("core_fx") / WEIGHT_UNIT).alias("core_weight"))
    facts = px.groupBy(*KEYS).agg(F.avg(is_transparent(cfg).cast("double")).alias("exterior_share"))
    pick = lambda k, n: F.max(F.when(F.col("rank") == k, F.col(n)))
    m = modes.groupBy(*KEYS).agg(
        F.count("*").alias("modes"), *[pick(k, n).alias(f"{n}{k}") for k in (1, 2) for n in ("r", "g", "b")]
    )
    d = facts.join(core, KEYS, "left").join(m, KEYS, "left").na.fill(0, ["modes"]).na.fill(0.0, ["core_weight"])
    first = modes.filter(F.col("rank") == 1)
    residual = coherent_residual(px, first, cfg).select(*KEYS, F.col("supported").alias("residual"))
    cover = coverage_interval(px, cfg).select(*KEYS, *[F.col(c).alias(f"k{c}") for c in "rgb"])
    ray = lambda k: gamut_interval(px, modes.filter(F.col("rank") == k).select(*KEYS, *[F.col(c).alias(f"b{c}") for c in "rgb"])).select(
        *KEYS, *[F.col(f"m{c}").alias(f"g{k}{c}") for c in "rgb"]
    )
    d = d.join(residual, KEYS, "left").join(cover, KEYS, "left").join(ray(1), KEYS, "left").join(ray(2), KEYS, "left")

    def colour(name: str, cols: list[str]) -> Column:
        return F.when(F.col(cols[0]).isNotNull(), F.struct(F.lit(name).alias("name"), *[linear_to_code(F.col(c)).alias(f"c{k}") for k, c in zip("rgb", cols)]))

    named = {
        "m1": ["r1", "g1", "b1"], "m2": ["r2", "g2", "b2"], "cover": ["kr", "kg", "kb"],
        "ray1": ["g1r", "g1g", "g1b"], "ray2": ["g2r", "g2g", "g2b"],
    }
    none = F.struct(F.lit("transparent").alias("name"), *[F.lit(None).cast("int").alias(f"c{k}") for k in "rgb"])
    colours = d.select(*KEYS, F.explode(F.array(none, *[colour(n, c) for n, c in named.items()])).alias("c")).filter("c is not null").select(*KEYS, "c.*")
    shares = border_shares(px, colours, cfg).join(colours, [*KEYS, "name"])
    entry = F.struct("name", "share", "cr", "cg", "cb")
    d = d.join(shares.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("name", entry))).alias("e")), KEYS, "left")

    e = lambda n: F.col("e")[n]
    has = lambda n: F.col("e")[n].isNotNull()
    exterior = F.col("exterior_share") >= cfg.min_exterior_share
    reliable = F.col("core_weight") >= cfg.min_core_weight
    h = lambda i, fg, bg: F.struct(F.lit(i).alias("hypothesis"), fg.alias("fg"), bg.alias("bg"))
    trio = lambda fg, bg, a, b: F.array(h("border_supported_background", fg, bg), h("full_bleed_two_face", a, b), h("label_swapped", b, a))
    empty = F.array().cast(
        "array<struct<hypothesis:string,fg:struct<name:string,share:double,cr:int,cg:int,cb:int>,bg:struct<name:string,share:double,cr:int,cg:int,cb:int>>>"
    )
    lum = lambda k: F.col(f"r{k}") * 0.2126 + F.col(f"g{k}") * 0.7152 + F.col(f"b{k}") * 0.0722
    second_is_bg = e("m2")["share"] >= e("m1")["share"]
    bg2 = F.when(second_is_bg, e("m2")).otherwise(e("m1"))
    fg_point = F.when(second_is_bg, e("m1")).otherwise(e("m2"))
    fg_ray = F.when(second_is_bg, F.coalesce(e("ray2"), e("m1"))).otherwise(F.coalesce(e("ray1"), e("m2")))
    fg2 = F.when(reliable, fg_point).otherwise(fg_ray)
    dark = F.when(lum(1) <= lum(2), e("m1")).otherwise(e("m2"))
    light = F.when(lum(1) <= lum(2), e("m2")).otherwise(e("m1"))
    n = F.col("modes")
    found = (
        F.when(exterior & (n == 0) & has("cover"), F.array(h("transparent_exterior", e("cover"), e("transparent"))))
        .when(exterior & (n == 1), F.array(h("transparent_exterior", F.when(reliable, e("m1")).otherwise(F.coalesce(e("cover"), e("m1"))), e("transparent"))))
        .when(~exterior & (n == 1) & F.col("residual") & has("ray1"), trio(e("ray1"), e("m1"), e("ray1"), e("m1")))
        .when(~exterior & (n == 2), trio(fg2, bg2, dark, light))
        .otherwise(empty)
    )
    refusal = (
        F.when(F.size(found) > 0, F.lit(None).cast("string"))
        .when(n == 0, "empty")
        .when(~exterior & (n == 1), "single_uniform_face")
        .otherwise("more_than_two_faces")
    )
    rows = d.select(*KEYS, "exterior_share", F.col("modes").alias("mode_count"), refusal.alias("refusal"), F.explode_outer(found).alias("h"))
    out = rows.select(
        *KEYS, "exterior_share", F.col("mode_count").alias("modes_seen"), "refusal", "h.hypothesis",
        *[F.col(f"h.fg.c{c}").alias(f"fg_{c}") for c in "rgb"], *[F.col(f"h.bg.c{c}").alias(f"bg_{c}") for c in "rgb"],
        F.col("h.bg.share").alias("border_background"), F.col("h.fg.share").alias("border_foreground"),
    )
    return out


# ---- given palettes ---------------------------------------------------------


def top_colours(px: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent exact opaque colours of each image, ranked."""
    counts = px.filter(F.col("a") == 255).groupBy(*KEYS, "r", "g", "b").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("n"), "r", "g", "b")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dominant_share(px: DataFrame, k: int = 16) -> DataFrame:
    """Share of opaque pixels held by the ``k`` most frequent colours (1 if none)."""
    total = px.groupBy(*KEYS).agg(F.count_if(F.col("a") == 255).alias("opaque"))
    top = top_colours(px, k).groupBy(*KEYS).agg(F.sum("n").alias("top"))
    share = F.when(F.col("opaque") == 0, F.lit(1.0)).otherwise(F.col("top") / F.nullif(F.col("opaque"), F.lit(0)))
    return total.join(top, KEYS, "left").select(*KEYS, "opaque", share.alias("share"))


def palette_arrays(colours: DataFrame) -> DataFrame:
    """One row per image: its few paints sorted by colour, with label numbers."""
    paints = F.array_sort(F.collect_list(F.struct("r", "g", "b")))
    d = colours.groupBy(*KEYS).agg(paints.alias("p"))
    numbered = F.transform("p", lambda c, i: F.struct(i.alias("label"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b")))
    return d.select(*KEYS, numbered.alias("palette"))


def nearest_paint(px: DataFrame, palettes: DataFrame) -> DataFrame:
    """Nearest palette label by squared code distance, ties to the lower label.

    The palette travels as one small array per image, so a pixel is not
    multiplied. Pixels without colour evidence (alpha at most one code) get NULL.
    """
    sq = lambda p, c: (p[c] - F.col(c)) * (p[c] - F.col(c))
    dist = F.transform("palette", lambda p: F.struct((sq(p, "r") + sq(p, "g") + sq(p, "b")).alias("d2"), p["label"].alias("label")))
    d = px.join(palettes, KEYS).withColumn("__all", dist).withColumn("__best", F.array_min("__all"))
    seen = F.col("a") > 1
    return d.select(
        *px.columns,
        F.when(seen, F.col("__best.label")).alias("label"),
        F.when(seen, F.col("__best.d2")).alias("d2"),
        F.transform("__all", lambda e: F.struct(e["label"].alias("label"), e["d2"].alias("d2"))).alias("options"),
    )


def area_core(px: DataFrame, radius_sq: float, min_core_weight: float) -> DataFrame:
    """Weight of members with both a horizontal and a vertical member neighbour.

    Columns in: label, d2 (from :func:`nearest_paint`) and weight.
    """
    member = F.col("label").isNotNull() & (F.col("weight") > 0) & (F.col("d2") <= radius_sq)
    d = px.withColumn("m", F.when(member, F.col("label"))).select(*KEYS, "x", "y", "m", "weight")
    near = neighbours(d, KEYS, ["m"], clamp=False, diagonal=False)
    same = lambda n: F.coalesce(F.col(f"{n}.m") == F.col("m"), F.lit(False))
    inside = (same("e") | same("w")) & (same("n") | same("s"))
    return (
        near.filter(F.col("m").isNotNull())
        .groupBy(*KEYS, F.col("m").alias("label"))
        .agg(F.sum(F.when(inside, F.col("weight")).otherwise(F.lit(0.0))).alias("core_weight"), F.count("*").alias("members"))
        .withColumn("has_core", F.col("core_weight") >= min_core_weight)
    )


PAINT_BITS = 24.0
EDGE_BITS = 0.25


def palette_score(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """Code length of a palette labelling: paints, reconstruction, coherence.

    ``labelled`` carries label, d2 and weight; ``sizes`` the palette size.
    """
    near = neighbours(labelled.select(*KEYS, "x", "y", "label", "d2", "weight"), KEYS, ["label"], clamp=False, diagonal=False)
    breaks = lambda n: F.coalesce(F.col(f"{n}.label") != F.col("label"), F.lit(False)).cast("int")
    d = near.groupBy(*KEYS).agg(
        F.sum(F.coalesce(F.col("weight") * F.col("d2") / 65025.0, F.lit(0.0))).alias("reconstruction_bits"),
        F.sum(breaks("e") + breaks("s")).alias("edges"),
    )
    k = F.col("k")
    d = d.join(sizes, KEYS).withColumns(
        {"palette_bits": k * PAINT_BITS + F.log2((k + 1).cast("double")), "coherence_bits": F.col("edges") * EDGE_BITS}
    )
    return d.withColumn("total_bits", F.col("palette_bits") + F.col("reconstruction_bits") + F.col("coherence_bits"))


