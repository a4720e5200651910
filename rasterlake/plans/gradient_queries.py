"""Gradient evidence over the opaque raster tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rasterlake.operators import gradients as G
from rasterlake.plans.raster_sql import LINE
from rasterlake.registry import query

LIN = ", ".join(f"{LINE.format(v=c)} AS {c}" for c in "rgb")
TO64 = "floor(({v}) * 64 + 0.5) / 64"
PX_SQL = f"px AS (SELECT image_id, x, y, {LIN} FROM rgba8), sz AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY 1)"
MOMENTS = ", ".join(f"sum((x + 0.5 - w / 2.0) * ({c} - m{c})) / nullif(sum(pow(x + 0.5 - w / 2.0, 2)), 0) AS gx{c}, sum((y + 0.5 - h / 2.0) * ({c} - m{c})) / nullif(sum(pow(y + 0.5 - h / 2.0, 2)), 0) AS gy{c}" for c in "rgb")
DIR_SQL = f"""{PX_SQL}, mn AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY image_id) AS m{c}' for c in 'rgb')} FROM px JOIN sz USING (image_id)),
  mo AS (SELECT image_id, w, h, {MOMENTS} FROM mn GROUP BY image_id, w, h),
  an AS (SELECT *, gxr * gxr + gxg * gxg + gxb * gxb AS a, gxr * gyr + gxg * gyg + gxb * gyb AS b, gyr * gyr + gyg * gyg + gyb * gyb AS d FROM mo),
  ro AS (SELECT *, cos(0.5 * atan2(2 * b, a - d)) AS u, sin(0.5 * atan2(2 * b, a - d)) AS v FROM an),
  di AS (SELECT image_id, w, h, CASE WHEN a + d <= 1e-18 THEN 1.0 WHEN u < 0 OR (u = 0 AND v < 0) THEN -u ELSE u END AS dx, CASE WHEN a + d <= 1e-18 THEN 0.0 WHEN u < 0 OR (u = 0 AND v < 0) THEN -v ELSE v END AS dy FROM ro),
  co AS (SELECT image_id, min(px * dx + py * dy) - any_value(w * 0.5 * dx + h * 0.5 * dy) AS lo, max(px * dx + py * dy) - any_value(w * 0.5 * dx + h * 0.5 * dy) AS hi FROM (SELECT *, unnest([0.5, w - 0.5, 0.5, w - 0.5]) AS px, unnest([0.5, 0.5, h - 0.5, h - 0.5]) AS py FROM di) GROUP BY image_id),
  ax AS (SELECT image_id, w, h, dx, dy, {TO64.format(v='w * 0.5 + dx * lo')} AS x0, {TO64.format(v='h * 0.5 + dy * lo')} AS y0, {TO64.format(v='w * 0.5 + dx * hi')} AS x1, {TO64.format(v='h * 0.5 + dy * hi')} AS y1 FROM di JOIN co USING (image_id))"""
FAR = "greatest(sqrt(pow(greatest({x} - 0.5, w - 0.5 - {x}), 2) + pow(greatest({y} - 0.5, h - 0.5 - {y}), 2)), 1 / 64.0)"
RAD_SQL = f"""ce AS (SELECT px.*, w, h, gy * 5 + gx AS centre, 0.5 + (w - 1) * gx / 4.0 AS cx, 0.5 + (h - 1) * gy / 4.0 AS cy FROM px JOIN sz USING (image_id) CROSS JOIN (SELECT range AS gx FROM range(0, 5)) CROSS JOIN (SELECT range AS gy FROM range(0, 5))),
  ri AS (SELECT *, floor(least(1.0, sqrt(pow(x + 0.5 - cx, 2) + pow(y + 0.5 - cy, 2)) / {FAR.format(x='cx', y='cy')}) * 15 + 0.5) AS ring FROM ce),
  rm AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY image_id, centre, ring) AS m{c}' for c in 'rgb')} FROM ri),
  er AS (SELECT image_id, w, h, centre, cx, cy, round(sum(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2)), 9) AS error FROM rm GROUP BY ALL),
  be AS (SELECT image_id, w, h, arg_min({{'e': error, 'x': cx, 'y': cy}}, (error, centre)) AS k FROM er GROUP BY 1, 2, 3),
  rd AS (SELECT image_id, w, h, k.e AS error, {TO64.format(v='k.x')} AS cx, {TO64.format(v='k.y')} AS cy FROM be), rc AS (SELECT *, {TO64.format(v=FAR.format(x='cx', y='cy'))} AS radius FROM rd)"""


def profile_sql(kind: str) -> str:
    geo, off = {
        "linear": ("ax", "((x + 0.5 - x0) * (x1 - x0) + (y + 0.5 - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2))"),
        "radial": ("rc", "sqrt(pow(x + 0.5 - cx, 2) + pow(y + 0.5 - cy, 2)) / radius"),
    }[kind]
    return f"""bi AS (SELECT image_id, floor(least(1.0, greatest(0.0, {off})) * 63 + 0.5)::INT AS bin, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px JOIN {geo} USING (image_id) GROUP BY 1, 2),
  ev AS (SELECT image_id, range::INT AS bin FROM sz CROSS JOIN range(0, 64)),
  pf AS (SELECT ev.image_id, ev.bin, arg_min({{'r': r, 'g': g, 'b': b}}, (abs(bi.bin - ev.bin), bi.bin)) AS c FROM ev JOIN bi USING (image_id) GROUP BY 1, 2), pr AS (SELECT image_id, bin, c.r AS r, c.g AS g, c.b AS b FROM pf)"""


@query("a15_linear_direction", "rgba8", f"{DIR_SQL} SELECT image_id, w AS width, h AS height, round(dx, 6) AS dx, round(dy, 6) AS dy, x0, y0, x1, y1 FROM ax")
def a15(t):
    return G.direction(t.rgba8()).withColumns({c: F.round(c, 6) for c in ("dx", "dy")})


@query("a16_linear_profile", "rgba8", f"{DIR_SQL}, {profile_sql('linear')} SELECT image_id, bin, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM pr")
def a16(t):
    return linear_profile(t).withColumns({c: F.round(c, 6) for c in "rgb"})


def linear_profile(t):
    return G.profile(t.rgba8(), G.direction(t.rgba8()), G.linear_offset())


@query("a16_radial_profile", "rgba8", f"{PX_SQL}, {RAD_SQL}, {profile_sql('radial')} SELECT image_id, bin, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM pr")
def a16r(t):
    return G.profile(t.rgba8(), G.radial_centre(t.rgba8()), G.radial_offset()).withColumns({c: F.round(c, 6) for c in "rgb"})


JUMP_SQL = """st AS (SELECT image_id, bin, sqrt(pow(r - lag(r) OVER w, 2) + pow(g - lag(g) OVER w, 2) + pow(b - lag(b) OVER w, 2)) AS step FROM pr WINDOW w AS (PARTITION BY image_id ORDER BY bin)),
  th AS (SELECT image_id, greatest(list_sort(list(step))[32] * 6, 0.08) AS threshold FROM st WHERE step IS NOT NULL GROUP BY 1)"""


@query(
    "a17_profile_jumps",
    "rgba8",
    f"""{DIR_SQL}, {profile_sql('linear')}, {JUMP_SQL} SELECT image_id, round(threshold, 6) AS threshold, coalesce(string_agg(bin, ',' ORDER BY bin) FILTER (WHERE step > threshold AND n <= 4), '') AS jumps
    FROM (SELECT st.*, threshold, count(*) FILTER (WHERE step > threshold) OVER (PARTITION BY image_id ORDER BY bin) AS n FROM st JOIN th USING (image_id)) GROUP BY image_id, threshold""",
)
def a17(t):
    d = G.jumps(linear_profile(t))
    return d.select("image_id", F.round("threshold", 6).alias("threshold"), F.array_join(F.col("jumps").cast("array<string>"), ",").alias("jumps"))


def end_sql(c: str, sign: int) -> str:
    return f"round(least(1.0, greatest(0.0, avg({c}) + {sign} * 0.5 * sum((bin / 63.0 - 0.5) * {c}) / sum(pow(bin / 63.0 - 0.5, 2)))), 6) AS {c}{(sign + 1) // 2}"


@query("a18_end_colours", "rgba8", f"{DIR_SQL}, {profile_sql('linear')} SELECT image_id, {', '.join(end_sql(c, s) for s in (-1, 1) for c in 'rgb')} FROM pr GROUP BY image_id")
def a18(t):
    d = G.end_colours(linear_profile(t))
    return d.withColumns({c: F.round(c, 6) for c in d.columns if c != "image_id"})


@query("a19_radial_centre", "rgba8", f"{PX_SQL}, {RAD_SQL} SELECT image_id, w AS width, h AS height, round(error, 6) AS error, cx, cy, radius FROM rc")
def a19(t):
    return G.radial_centre(t.rgba8()).withColumn("error", F.round("error", 6))


@query("a15_gradient_refusal", "flat32", "SELECT image_id, CASE WHEN min(a) <> 255 THEN 'non_opaque_source' WHEN count(*) > 8000000 THEN 'work_limit' END AS refusal FROM flat32 GROUP BY image_id")
def a15_refusal(t):
    return G.refusals(t.flat32())


# ramps, rings, steps and flat images with the texture of the given rasters
RAMP_SQL = """ramp AS (SELECT image_id, x, y, least(255, CASE image_id % 4 WHEN 0 THEN x * 30 + r // 16 WHEN 1 THEN ((x - 3) * (x - 3) + (y - 4) * (y - 4)) * 8 + r // 16 WHEN 2 THEN CASE WHEN y < 3 THEN 220 ELSE 20 END + r // 32 ELSE 90 + r // 32 END)::INT AS r,
  least(255, CASE WHEN image_id % 4 = 0 THEN y * 25 + g // 16 ELSE 40 + g // 16 END)::INT AS g, (200 - b // 16)::INT AS b, CASE WHEN image_id % 10 = 9 AND x = 0 THEN 254 ELSE 255 END AS a FROM rgba8)"""


def ramps(t):
    c = F.col
    kind = c("image_id") % 4
    tone = lambda ch, n: F.expr(f"{ch} div {n}")
    ring = (c("x") - 3) * (c("x") - 3) + (c("y") - 4) * (c("y") - 4)
    red = F.when(kind == 0, c("x") * 30 + tone("r", 16)).when(kind == 1, ring * 8 + tone("r", 16)).when(kind == 2, F.when(c("y") < 3, 220).otherwise(20) + tone("r", 32)).otherwise(tone("r", 32) + 90)
    green = F.when(kind == 0, c("y") * 25 + tone("g", 16)).otherwise(tone("g", 16) + 40)
    top = lambda v: F.least(F.lit(255), v).cast("int")
    clear = (c("image_id") % 10 == 9) & (c("x") == 0)
    return t.rgba8().select("image_id", "x", "y", top(red).alias("r"), top(green).alias("g"), (F.lit(200) - tone("b", 16)).cast("int").alias("b"), F.when(clear, 254).otherwise(255).alias("a"))


def _named(kind: str) -> str:
    return re.sub(r"\b(bi|ev|pf|pr)\b", rf"\1_{kind}", profile_sql(kind))


ENDS = ", ".join(f"least(1.0, greatest(0.0, avg({c}) + {s} * 0.5::DOUBLE * sum((bin / 63.0::DOUBLE - 0.5) * {c}) / sum(pow(bin / 63.0::DOUBLE - 0.5, 2)))) AS {c}{(s + 1) // 2}" for s in (-1, 1) for c in "rgb")
AT = lambda c: f"CASE WHEN u = len(s) THEN s[u].{c} ELSE s[u].{c} + (s[u + 1].{c} - s[u].{c}) * (t - s[u].o) / (s[u + 1].o - s[u].o) END"
ENC = lambda v: f"floor((CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE pow({v}, 1 / 2.4::DOUBLE) * 1.055 - 0.055 END) * 255 + 0.5)"
MODEL_SQL = f"""{RAMP_SQL}, {DIR_SQL.replace('rgba8', '(SELECT * FROM ramp WHERE image_id NOT IN (SELECT image_id FROM ramp WHERE a < 255))')}, {RAD_SQL}, {_named('linear')}, {_named('radial')},
  pp AS (SELECT 'linear' AS kind, * FROM pr_linear UNION ALL SELECT 'radial', * FROM pr_radial),
  stp AS (SELECT kind, image_id, bin, sqrt(pow(r - lag(r) OVER w, 2) + pow(g - lag(g) OVER w, 2) + pow(b - lag(b) OVER w, 2)) AS step FROM pp WINDOW w AS (PARTITION BY kind, image_id ORDER BY bin)),
  thr AS (SELECT kind, image_id, greatest(list_sort(list(step))[32] * 6, 0.08) AS threshold FROM stp WHERE step IS NOT NULL GROUP BY 1, 2),
  jp AS (SELECT kind, image_id, min(bin) FILTER (WHERE step > threshold) AS jump FROM stp JOIN thr USING (kind, image_id) GROUP BY 1, 2), ec AS (SELECT kind, image_id, {ENDS} FROM pp GROUP BY 1, 2),
  sl AS (SELECT kind, image_id, 2 AS budget, 0 AS k, 0.0::DOUBLE AS o, r0 AS r, g0 AS g, b0 AS b FROM ec UNION ALL SELECT kind, image_id, 2, 1, 1.0, r1, g1, b1 FROM ec
    UNION ALL SELECT kind, image_id, n, k, floor(k / (n - 1)::DOUBLE * 4096 + 0.5) / 4096, r, g, b FROM pp JOIN jp USING (kind, image_id) CROSS JOIN (VALUES (4), (8)) v(n) CROSS JOIN (SELECT range AS k FROM range(0, 8)) WHERE k < n AND bin = k * 63 // (n - 1) AND jump IS NULL
    UNION ALL SELECT kind, image_id, 4, CASE bin WHEN 0 THEN 0 WHEN 63 THEN 3 END, bin / 63, r, g, b FROM pp JOIN jp USING (kind, image_id) WHERE jump IS NOT NULL AND bin IN (0, 63)
    UNION ALL SELECT kind, image_id, 4, 2 - (jump - bin), floor((jump - 0.5::DOUBLE) / 63 * 4096 + 0.5) / 4096, r, g, b FROM pp JOIN jp USING (kind, image_id) WHERE bin IN (jump - 1, jump)),
  ls AS (SELECT kind, image_id, budget, list({{'o': o, 'r': r, 'g': g, 'b': b}} ORDER BY k) AS s FROM sl GROUP BY ALL UNION ALL SELECT 'solid', image_id, 1, [{{'o': 0.0::DOUBLE, 'r': avg(r), 'g': avg(g), 'b': avg(b)}}] FROM px GROUP BY image_id),
  of AS (SELECT ramp.*, unnest(['solid', 'linear', 'radial']) AS kind, unnest([0.0, least(1.0, greatest(0.0, ((x + 0.5 - x0) * (x1 - x0) + (y + 0.5 - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))), least(1.0, sqrt(pow(x + 0.5 - cx, 2) + pow(y + 0.5 - cy, 2)) / radius)]) AS t FROM ramp JOIN ax USING (image_id) JOIN rc USING (image_id)),
  uc AS (SELECT o.image_id, o.kind, budget, s, t, o.r AS cr, o.g AS cg, o.b AS cb, len(list_filter(s, lambda z: z.o <= t)) AS u FROM of o JOIN ls ON ls.image_id = o.image_id AND ls.kind = o.kind),
  cc AS (SELECT *, {', '.join(f'{AT(c)} AS v{c}' for c in 'rgb')} FROM uc),
  rb AS (SELECT image_id, kind, budget, any_value(s) AS s, sum({' + '.join(f'2.5 * log2(1 + pow((c{c} - {ENC(f"v{c}")}) / 25.57::DOUBLE, 2) / 4)' for c in 'rgb')}) AS residual FROM cc GROUP BY image_id, kind, budget),
  md AS (SELECT image_id, kind, len(s) AS stop_count, len(s) - len(list_distinct(list_transform(s, lambda z: z.o))) AS discontinuities, residual, CASE kind WHEN 'linear' THEN 4 WHEN 'radial' THEN 3 ELSE 0 END * 0.5 * greatest(0, 31.029146::DOUBLE + 2 * log2(8 / 16384.0::DOUBLE)) AS geometry,
    CASE WHEN kind = 'solid' THEN 24 ELSE len(s) * 36 + log2(factorial(len(s)::INT)::DOUBLE) END AS stop FROM rb), tb AS (SELECT *, residual + geometry + stop + log2(3.0::DOUBLE) AS total FROM md)"""


@query("a68_colour_model_bits", "rgba8", f"{MODEL_SQL} SELECT image_id, kind, stop_count, discontinuities, round(residual, 4) AS residual_bits, round(geometry, 4) AS geometry_bits, round(stop, 4) AS stop_bits, round(total, 4) AS total_bits FROM tb")
def a68(t):
    d = G.colour_models(ramps(t))
    return d.select("image_id", "kind", "stop_count", "discontinuities", *[F.round(c, 4).alias(c) for c in ("residual_bits", "geometry_bits", "stop_bits", "total_bits")])


@query(
    "a68_colour_model_choice",
    "rgba8",
    f"""{MODEL_SQL}, rk AS (SELECT *, row_number() OVER w AS k, lead(total) OVER w AS nx FROM tb WINDOW w AS (PARTITION BY image_id ORDER BY round(total, 6), CASE kind WHEN 'solid' THEN 0 WHEN 'linear' THEN 1 ELSE 2 END, stop_count))
    SELECT image_id, kind, stop_count, discontinuities, round(total, 4) AS total_bits, round(nx, 4) AS runner_up_bits, round(nx - total, 4) AS margin_bits FROM rk WHERE k = 1""",
)
def a68b(t):
    d = G.colour_choice(G.colour_models(ramps(t)))
    return d.select("image_id", "kind", "stop_count", "discontinuities", *[F.round(c, 4).alias(c) for c in ("total_bits", "runner_up_bits", "margin_bits")])
