"""Palettes, modes, border evidence and two-colour proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions.color import alpha_class, CODE
from rasterlake.operators import fields as W, palette as P
from rasterlake.plans.functions_queries import r6
from rasterlake.plans.raster_sql import FOUR, interior_sql, nb
from rasterlake.registry import query


@query(
    "a01_tensor_summary",
    "rgba8",
    """SELECT image_id, count(*) AS pixels, count(*) FILTER (WHERE a = 0) AS transparent, count(*) FILTER (WHERE a = 255) AS opaque, count(*) FILTER (WHERE a > 0 AND a < 255) AS partial FROM rgba8 GROUP BY image_id""",
)
def a01(t):
    d = t.rgba8().withColumn("c", alpha_class(F.col("a") * CODE))
    kinds = [F.count_if(F.col("c") == k).alias(k) for k in ("transparent", "opaque", "partial")]
    return d.groupBy("image_id").agg(F.count("*").alias("pixels"), *kinds)


def evidence(t):
    return P.mark_border(W.interior(W.observed(t.flat32())))


EV_SQL = f"{interior_sql('flat32')}, ev AS (SELECT it.*, x = 0 OR y = 0 OR x = 31 OR y = 31 AS border, round(weight * 1048576)::BIGINT AS fx FROM it)"
HIST_SQL = f"{EV_SQL}, hb AS (SELECT image_id, r // 4 AS br, g // 4 AS bg, b // 4 AS bb, sum(fx)::BIGINT AS fx, count(*) AS px, count(*) FILTER (WHERE border) AS bpx, sum(CASE WHEN weight >= 0.5 THEN fx ELSE 0 END)::BIGINT AS core FROM ev WHERE a >= 254 AND weight > 0 GROUP BY ALL)"


@query("a02_colour_histogram", "flat32", f"{HIST_SQL} SELECT image_id, br, bg, bb, round(fx / 1048576.0, 4) AS weight, px AS pixels, bpx AS border_pixels, round(core / 1048576.0, 4) AS core_weight FROM hb")
def a02(t):
    d = P.colour_histogram(evidence(t))
    return d.select(
        "image_id", F.col("bin.r").alias("br"), F.col("bin.g").alias("bg"), F.col("bin.b").alias("bb"), F.round(F.col("fx") / P.WEIGHT_UNIT, 4).alias("weight"),
        "pixels", "border_pixels", F.round(F.col("core_fx") / P.WEIGHT_UNIT, 4).alias("core_weight"),
    )


DEC = "(CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
ENC = "floor(255 * (CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1.0::DOUBLE / 2.4) - 0.055 END) + 0.5)::INT"
MID = "least(255, {k} * 4 + 2)"


def modes_sql(hist: str = HIST_SQL) -> str:
    dec = lambda k: DEC.format(v=MID.format(k=k))
    sep = "greatest(abs(" + "), abs(".join(f"{ENC.format(v=f'm.{c}')} - {ENC.format(v=f'o.c{c}')}" for c in "rgb") + ")) < 6"
    mean = lambda c: f"(m.{c} * m.fx + o.c{c} * o.fx) / (m.fx + o.fx)"
    return f"""{hist}, o AS (SELECT *, {dec('br')} AS cr, {dec('bg')} AS cg, {dec('bb')} AS cb, row_number() OVER (PARTITION BY image_id ORDER BY fx DESC, br, bg, bb) AS p FROM hb),
    mf(image_id, p, modes, tos) AS (SELECT DISTINCT image_id, 0::BIGINT, []::STRUCT(r DOUBLE, g DOUBLE, b DOUBLE, fx BIGINT, px BIGINT, bpx BIGINT)[], []::BIGINT[] FROM o
      UNION ALL SELECT image_id, p, CASE WHEN at_ = 0 THEN list_append(modes, {{'r': cr, 'g': cg, 'b': cb, 'fx': fx, 'px': px, 'bpx': bpx}})
         ELSE list_transform(modes, lambda m, i: CASE WHEN i = at_ THEN {{'r': {mean('r').replace('o.', '')}, 'g': {mean('g').replace('o.', '')}, 'b': {mean('b').replace('o.', '')}, 'fx': m.fx + fx, 'px': m.px + px, 'bpx': m.bpx + bpx}} ELSE m END) END,
         list_append(tos, CASE WHEN at_ = 0 THEN len(modes) + 1 ELSE at_ END)
      FROM (SELECT f.image_id, o.p, f.modes, f.tos, o.cr, o.cg, o.cb, o.fx, o.px, o.bpx, coalesce(list_position(list_transform(f.modes, lambda m: {sep}), true), 0) AS at_
            FROM mf f JOIN o ON o.image_id = f.image_id AND o.p = f.p + 1)),
    fin AS (SELECT image_id, arg_max(modes, p) AS modes, arg_max(tos, p) AS tos FROM mf GROUP BY 1),
    ml AS (SELECT image_id, unnest(range(1, len(modes) + 1)) AS mode, unnest(modes) AS m, list_sum(list_transform(modes, lambda z: z.fx)) AS total FROM fin),
    mm AS (SELECT ev.image_id, x, y, weight, fin.tos[o.p] AS mode FROM ev JOIN o ON o.image_id = ev.image_id AND br = r // 4 AND bg = g // 4 AND bb = b // 4 JOIN fin ON fin.image_id = ev.image_id WHERE a >= 254 AND weight > 0),
    su AS (SELECT p.image_id, p.mode, sum(round(p.weight * 1048576)::BIGINT) AS coh FROM mm p WHERE EXISTS (SELECT 1 FROM mm q WHERE q.image_id = p.image_id AND q.mode = p.mode AND abs(q.x - p.x) + abs(q.y - p.y) = 1) GROUP BY ALL),
    kept AS (SELECT ml.image_id, mode, m.r AS r, m.g AS g, m.b AS b, m.fx AS fx, m.px AS px, m.bpx AS bpx, {ENC.format(v='m.r')} AS cr, {ENC.format(v='m.g')} AS cg, {ENC.format(v='m.b')} AS cb FROM ml LEFT JOIN su USING (image_id, mode)
       WHERE m.fx / total::DOUBLE >= 0.02 OR coalesce(coh, 0) >= 8 * 1048576),
    md AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY fx DESC, cr, cg, cb, mode)::INT AS rank FROM kept)"""


@query("a03_merged_modes", "flat32", f"RECURSIVE {modes_sql()} SELECT image_id, mode::INT AS mode, {ENC.format(v='m.r')} AS cr, {ENC.format(v='m.g')} AS cg, {ENC.format(v='m.b')} AS cb, m.px AS pixels, m.bpx AS border_pixels FROM ml")
def a03(t):
    d = P.merge_modes(P.colour_histogram(evidence(t))).select("image_id", F.posexplode("modes").alias("i", "m"))
    return d.select("image_id", (F.col("i") + 1).alias("mode"), "m.cr", "m.cg", "m.cb", "m.pixels", "m.border_pixels")


@query("a04_supported_modes", "flat32", f"RECURSIVE {modes_sql()} SELECT image_id, rank, cr, cg, cb, px AS pixels, round(fx / 1048576.0, 4) AS weight FROM md")
def a04(t):
    d = P.find_modes(evidence(t))
    return d.select("image_id", "rank", "cr", "cg", "cb", "pixels", F.round(F.col("fx") / P.WEIGHT_UNIT, 4).alias("weight"))


TOP = "tc AS (SELECT * FROM (SELECT image_id, r, g, b, count(*) AS n, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, r, g, b) AS rank FROM {src} WHERE a = 255 GROUP BY image_id, r, g, b) WHERE rank <= {k})"


@query(
    "a05_border_share",
    "flat32",
    f"""{TOP.format(src='flat32', k=2)}, bp AS (SELECT * FROM flat32 WHERE x IN (0, 31) OR y IN (0, 31))
    SELECT image_id, 'c' || rank AS name, round(avg(CASE WHEN bp.a >= 254 AND greatest(abs(bp.r - tc.r), abs(bp.g - tc.g), abs(bp.b - tc.b)) < 6 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS share FROM bp JOIN tc USING (image_id) GROUP BY ALL
    UNION ALL SELECT image_id, 'transparent', round(avg(CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) FROM bp GROUP BY image_id""",
)
def a05(t):
    px = t.flat32()
    named = P.top_colours(px, 2).select("image_id", F.concat(F.lit("c"), "rank").alias("name"), *[F.col(c).alias(f"c{c}") for c in "rgb"])
    none = px.select("image_id").distinct().select("image_id", F.lit("transparent").alias("name"), *[F.lit(None).cast("int").alias(f"c{c}") for c in "rgb"])
    return P.border_shares(P.mark_border(px), named.unionByName(none)).withColumn("share", F.round("share", 6))


@query(
    "a06_coherent_residual",
    "flat32",
    f"""{TOP.format(src='flat32', k=1)}, rs AS (SELECT f.image_id, x, y FROM flat32 f JOIN tc USING (image_id) WHERE a >= 254 AND greatest(abs(f.r - tc.r), abs(f.g - tc.g), abs(f.b - tc.b)) >= 6),
    n AS (SELECT p.image_id, count(*) AS c FROM rs p WHERE EXISTS (SELECT 1 FROM rs q WHERE q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1) GROUP BY 1)
    SELECT tc.image_id, coalesce(c, 0) AS coherent, coalesce(c, 0) >= 8 AS supported FROM tc LEFT JOIN n USING (image_id)""",
)
def a06(t):
    px = t.flat32()
    background = P.top_colours(px, 1).select("image_id", *[F.col(c).alias(f"c{c}") for c in "rgb"])
    return P.coherent_residual(px, background)


COVER_SQL = f"""cv AS (SELECT image_id, arg_max((r, g, b, a, qr, qg, qb, qa), (a, -y, -x)) AS p, count(*) AS support FROM ev WHERE a > 1 GROUP BY 1),
  ci AS (SELECT image_id, support, sqrt(p[5]**2 + p[6]**2 + p[7]**2 + p[8]**2) / (p[4] / 255.0::DOUBLE) AS hw, {DEC.format(v='p[1]')} AS kr, {DEC.format(v='p[2]')} AS kg, {DEC.format(v='p[3]')} AS kb FROM cv)"""


@query("a63_coverage_interval", "flat32", f"{EV_SQL}, {COVER_SQL} SELECT image_id, support, round(hw, 6) AS halfwidth, round(kr, 6) AS r, round(least(1.0, greatest(0.0, kr - hw)), 6) AS lo_r, round(least(1.0, greatest(0.0, kg + hw)), 6) AS hi_g FROM ci".replace("p[", "p["))
def a63a(t):
    d = P.coverage_interval(W.observed(t.flat32()))
    return d.select("image_id", "support", *[r6(F.col(c), c) for c in ("halfwidth", "r", "lo_r", "hi_g")])


def ray_sql(bg: str, out: str) -> str:
    """CTE ``out``: gamut ray of each row of ``bg(image_id, lr, lg, lb)``."""
    enc = lambda v: f"(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1.0::DOUBLE / 2.4) - 0.055 END)"
    dist = f"sqrt(pow(pr - {enc('lr')}, 2) + pow(pg - {enc('lg')}, 2) + pow(pb - {enc('lb')}, 2) + pow(pa - 1, 2))"
    wall = lambda c: f"CASE WHEN v{c} > 1e-12 THEN (1 - l{c}) / v{c} WHEN v{c} < -1e-12 THEN -l{c} / v{c} ELSE 1 END"
    at = lambda c, tt: f"least(1.0, greatest(0.0, l{c} + {tt} * v{c}))"
    return f"""{out}_d AS (SELECT ev.image_id, x, y, r, g, b, lr, lg, lb, {dist} AS d FROM ev JOIN {bg} USING (image_id)),
    {out}_e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(d, 9) DESC, y, x) AS q FROM {out}_d) WHERE q = 1 AND d > 0),
    {out}_v AS (SELECT *, {DEC.format(v='r')} - lr AS vr, {DEC.format(v='g')} - lg AS vg, {DEC.format(v='b')} - lb AS vb FROM {out}_e),
    {out}_t AS (SELECT *, greatest(1.0, {wall('r')}, {wall('g')}, {wall('b')}) AS t FROM {out}_v),
    {out} AS (SELECT image_id, {', '.join(f"{at(c, '1.0')} AS lo_{c}, {at(c, 't')} AS hi_{c}" for c in 'rgb')} FROM {out}_t)"""


@query(
    "a63_gamut_interval",
    "flat32",
    f"""{EV_SQL}, {TOP.format(src='flat32', k=1)}, bgc AS (SELECT image_id, {DEC.format(v='r')} AS lr, {DEC.format(v='g')} AS lg, {DEC.format(v='b')} AS lb FROM tc), {ray_sql('bgc', 'gi')}
    SELECT image_id, round(lo_r, 6) AS lo_r, round(hi_r, 6) AS hi_r, round(0.5 * (lo_g + hi_g), 6) AS mg, round(0.5 * sqrt(pow(hi_r - lo_r, 2) + pow(hi_g - lo_g, 2) + pow(hi_b - lo_b, 2)), 6) AS halfwidth FROM gi""",
)
def a63b(t):
    from rasterlake.functions.color import code_to_linear

    px = W.observed(t.flat32())
    background = P.top_colours(px, 1).select("image_id", *[code_to_linear(F.col(c)).alias(f"b{c}") for c in "rgb"])
    d = P.gamut_interval(px, background)
    return d.select("image_id", *[r6(F.col(c), c) for c in ("lo_r", "hi_r", "mg", "halfwidth")])


def proposals_sql() -> str:
    share = lambda name: f"sh['{name}']"
    enc = lambda v: ENC.format(v=f"least(1.0, greatest(0.0, {v}))")
    code = lambda p: [enc(f"{p}{c}") for c in "rgb"]
    named = {"m1": code("m1_"), "m2": code("m2_"), "cover": code("k"), "ray1": [enc(f"0.5 * (g1.lo_{c} + g1.hi_{c})") for c in "rgb"], "ray2": [enc(f"0.5 * (g2.lo_{c} + g2.hi_{c})") for c in "rgb"]}
    st = lambda name: f"CASE WHEN {named[name][0].replace('::INT', '')} IS NOT NULL THEN {{'r': {named[name][0]}, 'g': {named[name][1]}, 'b': {named[name][2]}}} END AS {name}"
    bsh = lambda name: f"(SELECT avg(CASE WHEN p.a >= 254 AND greatest(abs(p.r - f.{name}.r), abs(p.g - f.{name}.g), abs(p.b - f.{name}.b)) < 6 THEN 1.0 ELSE 0.0 END::DOUBLE) FROM ev p WHERE p.border AND p.image_id = f.image_id) AS s_{name}"
    row = lambda cond, hyp, fg, sf, bg, sb: f"SELECT image_id, '{hyp}' AS hypothesis, {fg} AS fg, {bg} AS bg, {sf} AS sf, {sb} AS sb FROM g WHERE {cond}"
    null = "NULL::STRUCT(r INT, g INT, b INT)"
    two = "NOT ext AND n = 2"
    one = "NOT ext AND n = 1 AND coh >= 8 AND ray1 IS NOT NULL"
    b2 = "s_m2 >= s_m1"
    fg2 = f"CASE WHEN core >= 8 THEN CASE WHEN {b2} THEN m1 ELSE m2 END WHEN {b2} THEN coalesce(ray2, m1) ELSE coalesce(ray1, m2) END"
    sf2 = f"CASE WHEN core >= 8 THEN CASE WHEN {b2} THEN s_m1 ELSE s_m2 END WHEN {b2} THEN CASE WHEN ray2 IS NULL THEN s_m1 ELSE s_ray2 END ELSE CASE WHEN ray1 IS NULL THEN s_m2 ELSE s_ray1 END END"
    dark, sd = "CASE WHEN l1 <= l2 THEN m1 ELSE m2 END", "CASE WHEN l1 <= l2 THEN s_m1 ELSE s_m2 END"
    light, sl = "CASE WHEN l1 <= l2 THEN m2 ELSE m1 END", "CASE WHEN l1 <= l2 THEN s_m2 ELSE s_m1 END"
    hyps = " UNION ALL ".join(
        [
            row("ext AND n = 0 AND cover IS NOT NULL", "transparent_exterior", "cover", "s_cover", null, "s_none"),
            row("ext AND n = 1", "transparent_exterior", "CASE WHEN core >= 8 THEN m1 ELSE coalesce(cover, m1) END", "CASE WHEN core >= 8 OR cover IS NULL THEN s_m1 ELSE s_cover END", null, "s_none"),
            row(one, "border_supported_background", "ray1", "s_ray1", "m1", "s_m1"), row(one, "full_bleed_two_face", "ray1", "s_ray1", "m1", "s_m1"), row(one, "label_swapped", "m1", "s_m1", "ray1", "s_ray1"),
            row(two, "border_supported_background", fg2, sf2, f"CASE WHEN {b2} THEN m2 ELSE m1 END", f"CASE WHEN {b2} THEN s_m2 ELSE s_m1 END"),
            row(two, "full_bleed_two_face", dark, sd, light, sl), row(two, "label_swapped", light, sl, dark, sd),
        ]
    )
    return f"""{modes_sql()}, {COVER_SQL}, b1 AS (SELECT image_id, r AS lr, g AS lg, b AS lb FROM md WHERE rank = 1), b2 AS (SELECT image_id, r AS lr, g AS lg, b AS lb FROM md WHERE rank = 2), {ray_sql('b1', 'g1')}, {ray_sql('b2', 'g2')},
    im AS (SELECT image_id, avg(CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE) AS share, avg(CASE WHEN border THEN CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END END::DOUBLE) AS s_none FROM ev GROUP BY 1),
    mc AS (SELECT image_id, count(*) AS n, max(CASE WHEN rank = 1 THEN r END) AS m1_r, max(CASE WHEN rank = 1 THEN g END) AS m1_g, max(CASE WHEN rank = 1 THEN b END) AS m1_b, max(CASE WHEN rank = 2 THEN r END) AS m2_r, max(CASE WHEN rank = 2 THEN g END) AS m2_g, max(CASE WHEN rank = 2 THEN b END) AS m2_b FROM md GROUP BY 1),
    rs AS (SELECT e.image_id, x, y FROM ev e JOIN md ON md.image_id = e.image_id AND rank = 1 WHERE a >= 254 AND greatest(abs(e.r - cr), abs(e.g - cg), abs(e.b - cb)) >= 6),
    rc AS (SELECT p.image_id, count(*) AS coh FROM rs p WHERE EXISTS (SELECT 1 FROM rs q WHERE q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1) GROUP BY 1),
    co AS (SELECT image_id, sum(core) / 1048576.0 AS core FROM hb GROUP BY 1),
    f AS (SELECT im.image_id, share, s_none, share >= 0.002 AS ext, coalesce(mc.n, 0) AS n, coalesce(core, 0) AS core, coalesce(coh, 0) AS coh, {', '.join(st(n) for n in named)},
       0.2126 * m1_r + 0.7152 * m1_g + 0.0722 * m1_b AS l1, 0.2126 * m2_r + 0.7152 * m2_g + 0.0722 * m2_b AS l2
      FROM im LEFT JOIN mc USING (image_id) LEFT JOIN co USING (image_id) LEFT JOIN rc USING (image_id) LEFT JOIN ci USING (image_id) LEFT JOIN g1 USING (image_id) LEFT JOIN g2 USING (image_id)),
    g AS (SELECT f.*, {', '.join(bsh(n) for n in named)} FROM f), hy AS ({hyps})
    SELECT g.image_id, round(share, 6) AS exterior_share, n AS modes_seen, CASE WHEN hy.image_id IS NOT NULL THEN NULL WHEN n = 0 THEN 'empty' WHEN NOT ext AND n = 1 THEN 'single_uniform_face' ELSE 'more_than_two_faces' END AS refusal, hypothesis,
      hy.fg.r AS fg_r, hy.fg.g AS fg_g, hy.fg.b AS fg_b, hy.bg.r AS bg_r, hy.bg.g AS bg_g, hy.bg.b AS bg_b, round(sb, 6) AS border_background, round(sf, 6) AS border_foreground FROM g LEFT JOIN hy USING (image_id)"""


@query("a07_two_colour_proposals", "flat32", f"RECURSIVE {proposals_sql()}")
def a07(t):
    d = P.propose_two_colour(evidence(t))
    return d.withColumns({c: F.round(c, 6) for c in ("exterior_share", "border_background", "border_foreground")})


@query(
    "a08_dominant_share",
    "rgba8",
    f"""{TOP.format(src='rgba8', k=16)}, o AS (SELECT image_id, count(*) FILTER (WHERE a = 255) AS opaque FROM rgba8 GROUP BY 1), s AS (SELECT image_id, sum(n) AS top FROM tc GROUP BY 1)
    SELECT image_id, opaque, round(CASE WHEN opaque = 0 THEN 1.0 ELSE top / opaque::DOUBLE END, 6) AS share FROM o LEFT JOIN s USING (image_id)""",
)
def a08(t):
    return P.dominant_share(t.rgba8(), 16).withColumn("share", F.round("share", 6))


PAL = TOP.format(src="flat32", k=3) + ", pal AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) - 1 AS label, r AS pr_, g AS pg_, b AS pb_, count(*) OVER (PARTITION BY image_id) AS k FROM tc)"
NEAR = "np AS (SELECT * FROM (SELECT e.*, label, k, (e.r - pr_) * (e.r - pr_) + (e.g - pg_) * (e.g - pg_) + (e.b - pb_) * (e.b - pb_) AS d2 FROM ev e JOIN pal USING (image_id))), lb AS (SELECT image_id, x, y, any_value(a) AS a, any_value(weight) AS weight, any_value(k) AS k, CASE WHEN any_value(a) > 1 THEN arg_min(label, (d2, label)) END AS label, CASE WHEN any_value(a) > 1 THEN min(d2) END AS d2 FROM np GROUP BY image_id, x, y)"


def labelled(t):
    ev = evidence(t).select("image_id", "x", "y", "r", "g", "b", "a", "weight")
    pal = P.palette_arrays(P.top_colours(t.flat32(), 3))
    return P.nearest_paint(ev, pal), pal


@query("j02_nearest_palette", "flat32", f"{EV_SQL}, {PAL}, {NEAR} SELECT image_id, x, y, label::INT AS label, d2::INT AS d2 FROM lb")
def j02(t):
    d, _ = labelled(t)
    return d.select("image_id", "x", "y", "label", "d2")


@query(
    "a09_area_core",
    "flat32",
    f"""{EV_SQL}, {PAL}, {NEAR}, mk AS (SELECT image_id, x, y, weight, CASE WHEN weight > 0 AND d2 <= 192 THEN label END AS m FROM lb), {nb('mk', 'nm', ['m'], clamp=False)}
    SELECT image_id, m::INT AS label, round(sum(CASE WHEN (coalesce(e_m = m, false) OR coalesce(w_m = m, false)) AND (coalesce(n_m = m, false) OR coalesce(s_m = m, false)) THEN weight ELSE 0 END), 4) AS core_weight, count(*) AS members,
      sum(CASE WHEN (coalesce(e_m = m, false) OR coalesce(w_m = m, false)) AND (coalesce(n_m = m, false) OR coalesce(s_m = m, false)) THEN weight ELSE 0 END) >= 8 AS has_core FROM nm WHERE m IS NOT NULL GROUP BY image_id, m""",
)
def a09(t):
    d, _ = labelled(t)
    return P.area_core(d, 192.0, 8.0).withColumn("core_weight", F.round("core_weight", 4))


@query(
    "a27_palette_score",
    "flat32",
    f"""{EV_SQL}, {PAL}, {NEAR}, {nb('lb', 'nl', ['label'], clamp=False)}, s AS (SELECT image_id, any_value(k) AS k, sum(coalesce(weight * d2 / 65025.0, 0)) AS rec, sum(coalesce(e_label <> label, false)::INT + coalesce(s_label <> label, false)::INT)::BIGINT AS edges FROM nl GROUP BY 1)
    SELECT image_id, k::INT AS k, edges, round(rec, 4) AS reconstruction_bits, round(24 * k + log2(k + 1.0::DOUBLE), 6) AS palette_bits, round(0.25 * edges, 6)::DOUBLE AS coherence_bits, round(24 * k + log2(k + 1.0::DOUBLE) + rec + 0.25 * edges, 4) AS total_bits FROM s""",
)
def a27(t):
    d, pal = labelled(t)
    out = P.palette_score(d, pal.select("image_id", F.size("palette").alias("k")))
    r4 = lambda c: F.round(c, 4).alias(c)
    return out.select("image_id", "k", "edges", r4("reconstruction_bits"), r6(F.col("palette_bits"), "palette_bits"), r6(F.col("coherence_bits"), "coherence_bits"), r4("total_bits"))


@query(
    "p10_smoothed_labels",
    "flat32",
    f"""{EV_SQL}, {PAL}, {NEAR}, {nb('lb', 'nl', ['label'], clamp=False)}, c AS (SELECT nl.image_id, nl.x, nl.y, p.label AS cand, nl.weight * p.d2 / 65025.0 + 0.25 * ({' + '.join(f'coalesce({d}_label <> p.label, false)::INT' for d in FOUR)}) AS cost FROM nl JOIN np p ON p.image_id = nl.image_id AND p.x = nl.x AND p.y = nl.y WHERE nl.label IS NOT NULL)
    SELECT l.image_id, l.x, l.y, l.label::INT AS label, s.sm::INT AS smoothed FROM lb l LEFT JOIN (SELECT image_id, x, y, arg_min(cand, (cost, cand)) AS sm FROM c GROUP BY ALL) s USING (image_id, x, y)""",
)
def p10(t):
    d, _ = labelled(t)
    costs = F.transform("options", lambda o: F.struct(o["label"].alias("label"), (F.col("weight") * o["d2"] / 65025.0).alias("data")))
    return W.smooth_labels(d.withColumn("costs", costs)).select("image_id", "x", "y", "label", "smoothed")
