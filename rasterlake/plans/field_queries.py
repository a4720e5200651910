"""Stencil operators over the raster tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import fields as W
from rasterlake.operators.stencil import EIGHT, neighbours
from rasterlake.plans.functions_queries import r6
from rasterlake.plans.raster_sql import EIGHT as E8, FOUR as F4, interior_sql, nb
from rasterlake.registry import query


@query(
    "j01_neighbour_join",
    "grid",
    f"""{nb('grid', 'nbs', ['v'])} SELECT image_id, x, y, round({' + '.join(f'{d}_v' for d in E8)}, 6) AS ring_sum, round(greatest({', '.join(f'{d}_v' for d in F4)}), 6) AS four_max,
      ({' + '.join(f'({d}_v > v)::INT' for d in E8)})::INT AS higher FROM nbs""",
)
def j01(t):
    d = neighbours(t.grid(), ["image_id"], ["v"])
    near = [F.col(f"{n}.v") for n in EIGHT]
    total, higher = near[0], (near[0] > F.col("v")).cast("int")
    for n in near[1:]:
        total, higher = total + n, higher + (n > F.col("v")).cast("int")
    return d.select("image_id", "x", "y", r6(total, "ring_sum"), r6(F.greatest(*near[:4]), "four_max"), higher.alias("higher"))


def interior(t):
    return W.interior(W.observed(t.rgba8()))


@query(
    "p01_p02_p03_interior",
    "rgba8",
    f"""{interior_sql()} SELECT image_id, x, y, round(gradient, 4) AS gradient, round(spread, 4) AS spread, round(alpha_variation, 4) AS alpha_variation, mixed, round(edge_distance, 4) AS edge_distance,
      gives_rgb, round(weight, 6) AS weight FROM it""",
)
def p01(t):
    d = interior(t)
    r4 = lambda c: F.round(c, 4).alias(c)
    return d.select("image_id", "x", "y", r4("gradient"), r4("spread"), r4("alpha_variation"), "mixed", r4("edge_distance"), "gives_rgb", r6(F.col("weight"), "weight"))


LINE3 = "(({a}) + 2.0 * ({b}) + ({c})) / 4.0"


@query(
    "p05_binomial_denoise",
    "grid",
    f"""{nb('grid', 'nbs', ['v'])} SELECT image_id, x, y, round({LINE3.format(a=LINE3.format(a='nw_v', b='n_v', c='ne_v'), b=LINE3.format(a='w_v', b='v', c='e_v'), c=LINE3.format(a='sw_v', b='s_v', c='se_v'))}, 6) AS v FROM nbs""",
)
def p05(t):
    return W.binomial(t.grid()).select("image_id", "x", "y", r6(F.col("out"), "v"))


RING = ", ".join(f"{d}_v" for d in E8)


@query(
    "p06_detail_preserving",
    "grid",
    f"""{nb('grid', 'nbs', ['v'])} SELECT image_id, x, y, round(CASE WHEN v >= greatest({RING}) OR v <= least({RING}) THEN v ELSE list_sum(list_sort([v, {RING}])[2:8]) / 7 END, 6) AS v FROM nbs""",
)
def p06(t):
    return W.detail_preserving(t.grid()).select("image_id", "x", "y", r6(F.col("out"), "v"))


def conv_sql(src: str, out: str, taps: list[float], col: str = "v") -> str:
    r = len(taps) // 2
    term = lambda axis, tp, c: f"sum({tp!r}::DOUBLE * {c})"
    vals = ", ".join(f"({k}, {t!r}::DOUBLE)" for k, t in zip(range(-r, r + 1), taps))
    return f"""{out}_t(k, w) AS (VALUES {vals}), {out}_m AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM {src} GROUP BY 1),
    {out}_r AS (SELECT a.image_id, a.x, a.y, sum(w * b.{col}) AS v FROM {src} a JOIN {out}_m USING (image_id) CROSS JOIN {out}_t JOIN {src} b ON b.image_id = a.image_id AND b.y = a.y AND b.x = least(mx, greatest(0, a.x + k)) GROUP BY ALL),
    {out} AS (SELECT a.image_id, a.x, a.y, sum(w * b.v) AS v FROM {out}_r a JOIN {out}_m USING (image_id) CROSS JOIN {out}_t JOIN {out}_r b ON b.image_id = a.image_id AND b.x = a.x AND b.y = least(my, greatest(0, a.y + k)) GROUP BY ALL)"""


@query("p07_gaussian_kernel", "px8", f"s AS (SELECT image_id, x, y, alpha AS v FROM px8), {conv_sql('s', 'c', W.kernel_taps('gaussian', 1.0))} SELECT image_id, x, y, round(v, 6) AS v FROM c")
def p07(t):
    return W.convolve(t.px8(), W.kernel_taps("gaussian", 1.0), v="alpha").select("image_id", "x", "y", r6(F.col("out"), "v"))


@query("p07_triangle_kernel", "grid", f"{conv_sql('grid', 'c', W.kernel_taps('triangle'))} SELECT image_id, x, y, round(v, 6) AS v FROM c")
def p07b(t):
    return W.convolve(t.grid(), W.kernel_taps("triangle")).select("image_id", "x", "y", r6(F.col("out"), "v"))


def tv_sql(n: int) -> str:
    hub = lambda d: f"(CASE WHEN abs(v - {d}_v) <= 0.05 THEN v - {d}_v ELSE 0.05 * sign(v - {d}_v) END)"
    out = ["u0 AS (SELECT image_id, x, y, alpha AS v, alpha AS f FROM px8)"]
    for i in range(n):
        out.append(nb(f"u{i}", f"t{i}", ["v"]))
        out.append(f"u{i + 1} AS (SELECT image_id, x, y, least(1.0, greatest(0.0, v - 0.15 * (1.0 * (v - f) + {' + '.join(hub(d) for d in F4)}))) AS v, f FROM t{i})")
    return ", ".join(out)


@query("p08_tv_huber", "px8", f"{tv_sql(30)} SELECT image_id, x, y, round(v, 6) AS v FROM u30")
def p08(t):
    return W.tv_huber(t.px8(), v="alpha").select("image_id", "x", "y", r6(F.col("out"), "v"))


def landweber_sql(n: int) -> str:
    out = ["u0 AS (SELECT image_id, x, y, alpha AS v FROM px8)"]
    for i in range(n):
        out.append(conv_sql(f"u{i}", f"k{i}", W.kernel_taps("triangle")))
        out.append(f"u{i + 1} AS (SELECT u.image_id, u.x, u.y, least(1.0, greatest(0.0, u.v + 0.7 * (f.alpha - k.v))) AS v FROM u{i} u JOIN k{i} k USING (image_id, x, y) JOIN px8 f USING (image_id, x, y))")
    return ", ".join(out)


@query("p08_landweber", "px8", f"{landweber_sql(10)} SELECT image_id, x, y, round(v, 6) AS v FROM u10")
def p08b(t):
    return W.deconvolve(t.px8(), W.kernel_taps("triangle"), v="alpha").select("image_id", "x", "y", r6(F.col("out"), "v"))


CRIT = "coalesce((i AND se_i AND NOT e_i AND NOT s_i) OR (e_i AND s_i AND NOT i AND NOT se_i), false)"


def saddle_sql(on: str) -> str:
    """Critical cells of the snapshot set to ``on``, and the critical cells that are left."""
    return f"""b AS (SELECT image_id, x, y, alpha >= 0.5 AS i FROM px8s), {nb('b', 'n1', ['i'], clamp=False)}, c AS (SELECT image_id, x, y, i AS base, {CRIT} AS critical FROM n1), {nb('c', 'n2', ['critical'], clamp=False)},
    l AS (SELECT image_id, x, y, critical, CASE WHEN critical OR coalesce(w_critical, false) OR coalesce(n_critical, false) OR coalesce(nw_critical, false) THEN {on} ELSE base END AS i FROM n2), {nb('l', 'n3', ['i'], clamp=False)}
    SELECT image_id, x, y, critical, i AS inside, {CRIT} AS residual FROM n3"""


def saddle(t, mode: str):
    d = W.threshold_labelling(t.px8s(), 0.5, mode, v="alpha")
    return d.select("image_id", "x", "y", "critical", "inside", "residual")


@query("p09_saddle_labelling", "px8s", saddle_sql("true"))
def p09(t):
    return saddle(t, "join_diagonal")


@query("p09_saddle_split", "px8s", saddle_sql("false"))
def p09_split(t):
    return saddle(t, "split_diagonal")


@query("p09_saddle_thresholded", "px8s", saddle_sql("base"))
def p09_plain(t):
    return saddle(t, "thresholded")


@query(
    "p11_distance_transform",
    "bin8",
    """d AS (SELECT f.image_id, f.x, f.y, min((f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y)) FILTER (WHERE b.image_id IS NOT NULL) AS d2 FROM bin8 f LEFT JOIN (SELECT * FROM bin8 WHERE NOT inside) b ON b.image_id = f.image_id GROUP BY ALL)
    SELECT image_id, x, y, inside, d2::BIGINT AS d2 FROM bin8 JOIN d USING (image_id, x, y)""",
)
def p11(t):
    return W.distance_transform(t.bin8()).select("image_id", "x", "y", "inside", "d2")


def thin_sql(rounds: int) -> str:
    ring = ["n", "ne", "e", "se", "s", "sw", "w", "nw"]
    p = {d: f"coalesce({d}_i, 0)" for d in ring}
    count = " + ".join(p.values())
    turns = " + ".join(f"(CASE WHEN {p[a]} = 0 AND {p[b]} = 1 THEN 1 ELSE 0 END)" for a, b in zip(ring, ring[1:] + ring[:1]))
    out = ["u0 AS (SELECT image_id, x, y, (v >= 0.45)::INT AS i FROM grid)", "dm AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM u0 GROUP BY 1)"]
    for k in range(2 * rounds):
        n, e, s, w = (p[d] for d in "nesw")
        sides = f"{n} * {e} * {s} = 0 AND {e} * {s} * {w} = 0" if k % 2 == 0 else f"{n} * {e} * {w} = 0 AND {n} * {s} * {w} = 0"
        out.append(nb(f"u{k}", f"t{k}", ["i"], clamp=False))
        out.append(f"u{k + 1} AS (SELECT image_id, x, y, CASE WHEN i = 1 AND {count} BETWEEN 2 AND 6 AND {turns} = 1 AND {sides} AND x BETWEEN 1 AND mx - 1 AND y BETWEEN 1 AND my - 1 THEN 0 ELSE i END AS i FROM t{k} JOIN dm USING (image_id))")
    return ", ".join(out)


# twelve rounds are past the fixpoint of these rasters
@query("p12_thinning", "grid", f"{thin_sql(12)} SELECT image_id, x, y, i = 1 AS inside FROM u24")
def p12(t):
    return W.thin(t.grid().withColumn("inside", F.col("v") >= 0.45))
