"""Ordered chains and spatial joins over the event chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import chains as H
from rasterlake.functions.codes import COORDINATE_PRECISION_PX
from rasterlake.plans.functions_queries import r6
from rasterlake.registry import query

ARC = "st AS (SELECT *, coalesce(sqrt(pow(lead(px) OVER w - px, 2) + pow(lead(py) OVER w - py, 2)), 0) AS step, lead(px) OVER w AS nx, lead(py) OVER w AS ny FROM chain WINDOW w AS (PARTITION BY chain_id ORDER BY k)), ar AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY chain_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM st)"


@query("w01_arclength", "chain", f"{ARC} SELECT chain_id, k, round(s, 4) AS s FROM ar")
def w01(t):
    return H.with_arclength(t.chain()).select("chain_id", "k", F.round("s", 4).alias("s"))


@query(
    "w02_j06_resample",
    "chain",
    f"""{ARC}, tl AS (SELECT chain_id, sum(step) AS len, greatest(1, floor(sum(step) / 0.5 + 0.5))::BIGINT AS n FROM st GROUP BY 1 HAVING sum(step) > 0), sp AS (SELECT chain_id, i, (i + 0.5) * len / n AS "at" FROM (SELECT *, unnest(range(0, n)) AS i FROM tl))
    SELECT sp.chain_id, i, k, round(px + (sp.at - s) / step * (nx - px), 4) AS px, round(py + (sp.at - s) / step * (ny - py), 4) AS py FROM sp JOIN ar ON ar.chain_id = sp.chain_id AND step > 0 AND s <= sp.at AND sp.at < s + step""",
)
def w02(t):
    return H.resample(t.chain()).select("chain_id", "i", "k", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


def turn_sql(s: int, cyclic: bool) -> str:
    j = lambda off: f"((a.k + {off} + n) % n)" if cyclic else f"a.k + {off}"
    ang = "atan2((a.px - b.px) * (f.py - a.py) - (a.py - b.py) * (f.px - a.px), (a.px - b.px) * (f.px - a.px) + (a.py - b.py) * (f.py - a.py))"
    return f"""SELECT a.chain_id, a.k, {s} AS sc, {ang} AS ang FROM cn a JOIN cn b ON b.chain_id = a.chain_id AND b.k = {j(f'- {s}')} JOIN cn f ON f.chain_id = a.chain_id AND f.k = {j(s)}
      WHERE 2 * {s} < a.n AND (a.px <> b.px OR a.py <> b.py) AND (a.px <> f.px OR a.py <> f.py)""".replace("+ n)", "+ a.n)").replace("% n)", "% a.n)")


def turns(cyclic: bool) -> str:
    return "cn AS (SELECT *, count(*) OVER (PARTITION BY chain_id) AS n FROM chain), tu AS (" + " UNION ALL ".join(turn_sql(s, cyclic) for s in (1, 2, 4)) + ")"


TURN_OUT = "SELECT cn.chain_id, cn.k, round(max(CASE WHEN sc = 1 THEN ang END), 6) AS turning, round(min(abs(ang)), 6) AS persistent FROM cn LEFT JOIN tu USING (chain_id, k) GROUP BY ALL"


@query("w03_turning_open", "chain", f"{turns(False)} {TURN_OUT}".replace("GROUP BY ALL", "GROUP BY cn.chain_id, cn.k"))
def w03(t):
    d = H.turning(t.chain(), [1, 2, 4])
    return d.select("chain_id", "k", r6(F.col("turning"), "turning"), r6(F.col("persistent"), "persistent"))


@query("w03_turning_cyclic", "chain", f"{turns(True)} {TURN_OUT}".replace("GROUP BY ALL", "GROUP BY cn.chain_id, cn.k"))
def w03b(t):
    d = H.turning(t.chain(), [1, 2, 4], cyclic=True)
    return d.select("chain_id", "k", r6(F.col("turning"), "turning"), r6(F.col("persistent"), "persistent"))


def fit_sql(frame: str, tag: str) -> str:
    return f"""{tag} AS (SELECT chain_id, k, count(*) OVER w AS n, avg(px * px) OVER w - pow(avg(px) OVER w, 2) AS sxx, var_pop(k) OVER w AS syy, covar_pop(px, py) OVER w AS sxy FROM chain WINDOW w AS (PARTITION BY chain_id ORDER BY k ROWS BETWEEN {frame}))"""


@query(
    "w04_side_fits",
    "chain",
    f"""{fit_sql('4 PRECEDING AND CURRENT ROW', 'l')}, {fit_sql('CURRENT ROW AND 4 FOLLOWING', 'r')}
    SELECT l.chain_id, l.k, l.n AS left_n, r.n AS right_n, CASE WHEN l.n > 1 THEN round(0.5 * atan2(2 * l.sxy, l.sxx - l.syy), 4) END AS left_angle, round(sqrt(greatest(0, (r.sxx + r.syy - sqrt(pow(r.sxx - r.syy, 2) + 4 * r.sxy * r.sxy)) / 2)), 3) AS right_rms FROM l JOIN r USING (chain_id, k)""",
)
def w04(t):
    d = H.side_fits(t.chain(), 4)
    return d.select("chain_id", "k", "left_n", "right_n", F.when(F.col("left_n") > 1, F.round("left_angle", 4)).alias("left_angle"), F.round("right_rms", 3).alias("right_rms"))


def corner_sql(cyclic: bool) -> str:
    """CTE ``co``: corner proposals, each scale and each side of a position by a join of its own rows."""
    at = lambda e: f"((a.k + {e} + a.n) % a.n)" if cyclic else f"a.k + {e}"
    ang = "atan2((a.px - b.px) * (f.py - a.py) - (a.py - b.py) * (f.px - a.px), (a.px - b.px) * (f.px - a.px) + (a.py - b.py) * (f.py - a.py))"
    side = lambda tag, lo, hi: f"""{tag} AS (SELECT a.chain_id, a.k, avg(b.px) AS mx, avg(b.py) AS my, 0.5 * atan2(2 * covar_pop(b.px, b.py), var_pop(b.px) - var_pop(b.py)) AS th,
      sqrt(greatest(0, (var_pop(b.px) + var_pop(b.py) - sqrt(pow(var_pop(b.px) - var_pop(b.py), 2) + 4 * pow(covar_pop(b.px, b.py), 2))) / 2)) AS rms FROM cs a JOIN (SELECT *, unnest({'[-1, 0, 1]' if cyclic else '[0]'}) AS turn FROM cs) b ON b.chain_id = a.chain_id AND b.k + b.turn * a.n BETWEEN a.k + {lo} AND a.k + {hi} GROUP BY a.chain_id, a.k)"""
    return f"""cn AS (SELECT chain_id, k, px, py, CASE WHEN k % 13 = 7 THEN 0.0 ELSE 0.35 + k % 3 END::DOUBLE AS h, count(*) OVER (PARTITION BY chain_id) AS n FROM chain), cs AS (SELECT *, 1 << (length(bin(n - 1)) - 2) AS arm FROM cn WHERE n > 2),
      sc AS (SELECT a.chain_id, a.k, e, {ang} AS ang FROM (SELECT *, unnest(range(0, length(bin(n - 1)) - 1)) AS e FROM cs) a JOIN cs b ON b.chain_id = a.chain_id AND b.k = {at('-(1 << e)')} JOIN cs f ON f.chain_id = a.chain_id AND f.k = {at('(1 << e)')} WHERE (a.px <> b.px OR a.py <> b.py) AND (a.px <> f.px OR a.py <> f.py)),
      tn AS (SELECT chain_id, k, max(ang) FILTER (WHERE e = 0) AS turning, min(abs(ang)) AS persistent FROM sc GROUP BY 1, 2 HAVING max(ang) FILTER (WHERE e = 0) IS NOT NULL), {side('lf', '-a.arm', '0')}, {side('rt', '0', 'a.arm')},
      dt AS (SELECT cs.chain_id, cs.k, cs.h, turning, persistent, (lf.rms + rt.rms) / 2 AS line_rms, cos(lf.th) * sin(rt.th) - sin(lf.th) * cos(rt.th) AS det, lf.th AS ta, rt.th AS tb, lf.mx AS ax, lf.my AS ay, rt.mx AS bx, rt.my AS by_, px, py FROM tn JOIN cs USING (chain_id, k) JOIN lf USING (chain_id, k) JOIN rt USING (chain_id, k)),
      al AS (SELECT *, ((bx - ax) * sin(tb) - (by_ - ay) * cos(tb)) / nullif(det, 0) AS t FROM dt), of AS (SELECT *, CASE WHEN abs(det) > 1e-12 THEN sqrt(pow(ax + cos(ta) * t - px, 2) + pow(ay + sin(ta) * t - py, 2)) END AS o FROM al),
      co AS (SELECT *, least(1.0, persistent / pi()) * CASE WHEN h > 0 AND o IS NOT NULL THEN 1 / (1 + (line_rms + o) / h) ELSE 0 END AS saliency FROM of)"""


def with_halfwidth(t):
    return t.chain().withColumn("halfwidth", F.when(F.col("k") % 13 == 7, 0.0).otherwise(F.col("k") % 3 + 0.35))


def _corners(t, cyclic: bool):
    d = H.corner_proposals(with_halfwidth(t), cyclic)
    return d.select("chain_id", "k", r6(F.col("turning"), "turning"), r6(F.col("persistent"), "persistent"), F.round("line_rms", 4).alias("line_rms"), F.round("saliency", 5).alias("saliency"))


CORNER_OUT = "SELECT chain_id, k, round(turning, 6) AS turning, round(persistent, 6) AS persistent, round(line_rms, 4) AS line_rms, round(saliency, 5) AS saliency FROM co"


@query("w04_corner_proposals", "chain", f"{corner_sql(False)} {CORNER_OUT}")
def w04b(t):
    return _corners(t, False)


@query("w04_corner_proposals_cyclic", "chain", f"{corner_sql(True)} {CORNER_OUT}")
def w04c(t):
    return _corners(t, True)


@query(
    "w06_corner_anchors",
    "chain",
    f"""{corner_sql(False)}, pl AS (SELECT chain_id, k, saliency, max(saliency) OVER (PARTITION BY chain_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, max(saliency) OVER (PARTITION BY chain_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM co)
    SELECT chain_id, k, round(saliency, 5) AS saliency FROM pl WHERE saliency > 0 AND (b IS NULL OR b < saliency) AND (a IS NULL OR a < saliency)""",
)
def w06b(t):
    d = H.corner_anchors(H.corner_proposals(with_halfwidth(t)), 3)
    return d.select("chain_id", "k", F.round("saliency", 5).alias("saliency"))


@query(
    "w06_local_maxima",
    "chain",
    """m AS (SELECT chain_id, k, px, max(px) OVER (PARTITION BY chain_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, max(px) OVER (PARTITION BY chain_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM chain)
    SELECT chain_id, k, px FROM m WHERE px > 0 AND (b IS NULL OR b < px) AND (a IS NULL OR a < px)""",
)
def w06(t):
    return H.local_maxima(t.chain(), "px", 3)


@query(
    "a30_chain_correlation",
    "chain",
    """c AS (SELECT chain_id, k, px - avg(px) OVER w AS v, count(*) OVER w AS n, var_pop(px) OVER w AS var FROM chain WINDOW w AS (PARTITION BY chain_id)),
    h AS (SELECT chain_id, n, CASE WHEN n >= 4 AND any_value(var) > 0 THEN n // 2 ELSE 1 END AS half FROM c GROUP BY chain_id, n),
    l AS (SELECT a.chain_id, b.k - a.k AS lag, sum(a.v * b.v) / (any_value(a.n) * any_value(a.var)) AS rho FROM c a JOIN h USING (chain_id) JOIN c b ON b.chain_id = a.chain_id AND b.k > a.k AND b.k - a.k < h.half GROUP BY a.chain_id, b.k - a.k)
    SELECT h.chain_id, h.n, coalesce(min(CASE WHEN rho < exp(-1.0::DOUBLE) THEN lag END), any_value(half))::INT AS lag, coalesce(min(CASE WHEN rho < exp(-1.0::DOUBLE) THEN lag END), any_value(half)) * 0.5::DOUBLE AS length FROM h LEFT JOIN l USING (chain_id) GROUP BY h.chain_id, h.n""",
)
def a30(t):
    return H.correlation_length(t.chain(), "px", 0.5)


PT = "pt AS (SELECT chain_id, k, px + 0.4 AS px, py + 0.3 AS py, 2.5::DOUBLE AS halfwidth FROM chain), pd AS (SELECT pt.chain_id, pt.k, sid, halfwidth, least(1.0, greatest(0.0, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0))) AS t, px, py, x1, y1, x2, y2 FROM pt JOIN segments s ON s.chain_id = pt.chain_id), dd AS (SELECT chain_id, k, halfwidth, sid, sqrt(pow(x1 + t * (x2 - x1) - px, 2) + pow(y1 + t * (y2 - y1) - py, 2)) AS d FROM pd), nr AS (SELECT chain_id, k, any_value(halfwidth) AS halfwidth, arg_min(sid, (d, sid)) AS sid, min(d) AS d FROM dd GROUP BY ALL)"


def moved(t):
    return t.chain().withColumns({"px": F.col("px") + 0.4, "py": F.col("py") + 0.3, "halfwidth": F.lit(2.5)})


# even chains look across their axis, where every line meets something; the others in twelve directions
RAY = PT.replace("GROUP BY ALL", "GROUP BY chain_id, k").replace(
    "px + 0.4 AS px, py + 0.3 AS py", "px + CASE WHEN chain_id % 2 = 0 THEN 1.7 ELSE 0.4 END AS px, py + CASE WHEN chain_id % 2 = 1 THEN 0.3 WHEN k > 0 THEN -0.3 ELSE 0 END AS py"
).replace(
    "2.5::DOUBLE AS halfwidth FROM chain)",
    "2.5::DOUBLE AS halfwidth, CASE WHEN chain_id % 2 = 0 THEN 1.0 ELSE cos(pi() * (k % 12) / 6) END AS nx, CASE WHEN chain_id % 2 = 0 THEN 0.0 ELSE sin(pi() * (k % 12) / 6) END AS ny, CASE WHEN k % 9 = 4 THEN 0.0 ELSE 0.5 + (k % 4) * 0.25 END::DOUBLE AS weight_ds, CASE WHEN chain_id % 11 = 3 AND k = 5 THEN 0.0 ELSE 2.0 END::DOUBLE AS corr_length FROM chain)",
) + """, cr AS (SELECT pt.chain_id, pt.k, sid, ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) / nullif(nx * (y2 - y1) - ny * (x2 - x1), 0) AS t, (nx * (py - y1) - ny * (px - x1)) / nullif(nx * (y2 - y1) - ny * (x2 - x1), 0) AS s FROM pt JOIN segments USING (chain_id)),
    rc AS (SELECT chain_id, k, arg_min({'sid': sid, 't': t}, (abs(t), sid)) AS b FROM cr WHERE s BETWEEN 0 AND 1 AND t IS NOT NULL GROUP BY chain_id, k),
    ry AS (SELECT pt.*, rc.b.sid AS sid, rc.b.t AS t, nr.d AS de FROM pt LEFT JOIN rc USING (chain_id, k) LEFT JOIN nr USING (chain_id, k))"""


def rays(t):
    k, even = F.col("k"), F.col("chain_id") % 2 == 0
    return t.chain().withColumns({
        "px": F.col("px") + F.when(even, 1.7).otherwise(0.4), "py": F.col("py") + F.when(~even, 0.3).when(k > 0, -0.3).otherwise(0.0), "halfwidth": F.lit(2.5),
        "nx": F.when(even, 1.0).otherwise(F.cos(F.pi() * (k % 12) / 6)), "ny": F.when(even, 0.0).otherwise(F.sin(F.pi() * (k % 12) / 6)), "weight_ds": F.when(k % 9 == 4, 0.0).otherwise(k % 4 * 0.25 + 0.5),
        "corr_length": F.when((F.col("chain_id") % 11 == 3) & (k == 5), 0.0).otherwise(2.0),
    })


@query("j03_nearest_segment", "segments", f"{PT.replace('GROUP BY ALL', 'GROUP BY chain_id, k')} SELECT chain_id, k, sid, round(d, 6) AS distance FROM nr")
def j03(t):
    return H.nearest_segment(moved(t), t.segments()).select("chain_id", "k", "sid", r6(F.col("distance"), "distance"))


@query("j04_normal_crossing", "segments", f"{RAY} SELECT chain_id, k, round(t, 4) AS t FROM ry")
def j04(t):
    return H.normal_crossing(rays(t), t.segments()).select("chain_id", "k", F.round("t", 4).alias("t"))


HUBER = "(CASE WHEN abs(t / halfwidth) <= 1 THEN pow(t / halfwidth, 2) ELSE 2 * abs(t / halfwidth) - 1 END)"


@query(
    "a65_deviation_cost",
    "segments",
    f"""{RAY}, m AS (SELECT *, de >= 0.25 * halfwidth AND de > 0 AS mat FROM ry WHERE weight_ds <> 0), g AS (SELECT chain_id, sum({HUBER} * weight_ds) AS cost, max(abs(t)) AS max_normal, max(de) AS max_euclidean, arg_max({{'r': abs(t) / de, 'd': de}}, (abs(t) / de, -k)) FILTER (WHERE mat AND t IS NOT NULL) AS w, count(*) FILTER (WHERE mat) AS material, bool_or(t IS NULL) AS missed FROM m GROUP BY chain_id)
    SELECT chain_id, CASE WHEN NOT missed THEN round(cost, 4) END AS cost, CASE WHEN NOT missed THEN round(max_normal, 4) END AS max_normal, CASE WHEN NOT missed THEN round(max_euclidean, 4) END AS max_euclidean, CASE WHEN NOT missed THEN round(w.r, 4) END AS worst_ratio, CASE WHEN NOT missed THEN round(w.d, 4) END AS ratio_at, CASE WHEN NOT missed THEN material END AS material, CASE WHEN missed THEN 'normal_line_misses' END AS refusal FROM g""",
)
def a65(t):
    d = H.deviation_cost(rays(t), t.segments())
    return d.withColumns({c: F.round(c, 4) for c in ("cost", "max_normal", "max_euclidean", "worst_ratio", "ratio_at")})


@query(
    "a66_residual_code",
    "segments",
    f"""{RAY}, b AS (SELECT chain_id, CASE WHEN corr_length > 0 AND weight_ds >= 0 THEN weight_ds / corr_length * greatest(0.0, {HUBER.replace('t / halfwidth', 'coalesce(t, de) / halfwidth')} / (2 * ln(2.0::DOUBLE)) + log2(halfwidth * sqrt(2 * pi()) / {COORDINATE_PRECISION_PX!r}::DOUBLE)) ELSE 'inf'::DOUBLE END AS bits FROM ry)
    SELECT chain_id, count(*) AS samples, CASE WHEN isinf(sum(bits)) THEN NULL ELSE round(sum(bits), 4) END AS bits FROM b GROUP BY chain_id""",
)
def a66(t):
    d = H.residual_code(rays(t), t.segments())
    return d.withColumn("bits", F.when(F.col("bits") < float("inf"), F.round("bits", 4)))


@query(
    "a67_corridor_containment",
    "segments",
    f"""{RAY}, pn AS (SELECT chain_id, k, px AS x1, py AS y1, halfwidth * (1 + k % 3) AS h1, lead(px) OVER w AS x2, lead(py) OVER w AS y2, lead(halfwidth * (1 + k % 3)) OVER w AS h2 FROM pt WINDOW w AS (PARTITION BY chain_id ORDER BY k)),
    vx AS (SELECT chain_id, sid AS k, x1 AS px, y1 AS py FROM segments UNION ALL SELECT chain_id, max(sid) + 1, arg_max(x2, sid), arg_max(y2, sid) FROM segments GROUP BY chain_id),
    vq AS (SELECT vx.chain_id, vx.k, px, py, x1, y1, x2, y2, h1, h2, least(1.0, greatest(0.0, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0))) AS q FROM vx JOIN pn USING (chain_id) WHERE x2 IS NOT NULL),
    vd AS (SELECT chain_id, k, sqrt(pow(x1 + q * (x2 - x1) - px, 2) + pow(y1 + q * (y2 - y1) - py, 2)) AS d, h1 + q * (h2 - h1) AS h FROM vq), vb AS (SELECT chain_id, k, min({{'d': d, 'h': h}}) AS b FROM vd GROUP BY chain_id, k),
    rt AS (SELECT chain_id, 'sample' AS side, k, coalesce(abs(t), de) AS dev, 3.0::DOUBLE * halfwidth * (1 + k % 3) AS al FROM ry UNION ALL SELECT chain_id, 'vertex', k, b.d, 3.0::DOUBLE * b.h FROM vb),
    ws AS (SELECT chain_id, arg_min({{'r': round(dev / al, 9), 's': side, 'k': k, 'd': dev}}, (-round(dev / al, 9), side, k)) AS w FROM rt GROUP BY chain_id)
    SELECT chain_id, n AS samples, round(w.r, 6) AS worst_ratio, w.s AS worst_side, w.k AS worst_at, round(w.d, 4) AS deviation, w.r <= 1 AS feasible FROM ws JOIN (SELECT chain_id, count(*) AS n FROM pt GROUP BY 1) USING (chain_id)""",
)
def a67(t):
    samples = rays(t).withColumn("halfwidth", F.col("halfwidth") * (F.col("k") % 3 + 1))
    d = H.corridor_containment(samples, t.segments())
    return d.withColumns({"worst_ratio": F.round("worst_ratio", 6), "deviation": F.round("deviation", 4)})


ZIG = "zs AS (SELECT chain_id, sid, round(x1 * 1000)::BIGINT AS x1, ((sid % 3) * 2000 + (sid // 12) * 9000)::BIGINT AS y1, round(x2 * 1000)::BIGINT AS x2, (((sid + 1) % 3) * 2000 + ((sid + 1) // 12) * 9000)::BIGINT AS y2 FROM segments)"


def sgn(p: str, q: str, r: str) -> str:
    x, y = (lambda v: f"{v[0]}.x{v[1]}"), (lambda v: f"{v[0]}.y{v[1]}")
    return f"sign(({x(q)} - {x(p)}) * ({y(r)} - {y(p)}) - ({y(q)} - {y(p)}) * ({x(r)} - {x(p)}))"


@query(
    "j05_segment_interference",
    "segments",
    f"""{ZIG}, p AS (SELECT a.chain_id, a.sid AS a_sid, b.sid AS b_sid, {sgn('a1', 'a2', 'b1')} AS o1, {sgn('a1', 'a2', 'b2')} AS o2, {sgn('b1', 'b2', 'a1')} AS o3, {sgn('b1', 'b2', 'a2')} AS o4,
      ((a.x1, a.y1) = (b.x1, b.y1))::INT + ((a.x1, a.y1) = (b.x2, b.y2))::INT + ((a.x2, a.y2) = (b.x1, b.y1))::INT + ((a.x2, a.y2) = (b.x2, b.y2))::INT AS sh,
      least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) > greatest(least(a.x1, a.x2), least(b.x1, b.x2)) OR least(greatest(a.y1, a.y2), greatest(b.y1, b.y2)) > greatest(least(a.y1, a.y2), least(b.y1, b.y2)) AS wide
      FROM zs a JOIN zs b ON b.chain_id = a.chain_id AND a.sid < b.sid AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)),
    k AS (SELECT chain_id, a_sid, b_sid, CASE WHEN sh = 0 AND ((o1 = 0 AND o2 = 0) OR (o1 * o2 <= 0 AND o3 * o4 <= 0)) THEN 'boundaries_intersect' WHEN (sh = 1 AND o1 = 0 AND o2 = 0 AND wide) OR sh >= 2 THEN 'collinear_overlap' END AS kind FROM p)
    SELECT chain_id, a_sid, b_sid, kind FROM k WHERE kind IS NOT NULL""",
)
def j05(t):
    sid = F.col("sid")
    y = lambda i: (i % 3 * 2000 + F.floor(i / 12) * 9000).cast("bigint")
    z = t.segments().select(
        "chain_id", "sid", F.round(F.col("x1") * 1000).cast("bigint").alias("x1"), y(sid).alias("y1"), F.round(F.col("x2") * 1000).cast("bigint").alias("x2"), y(sid + 1).alias("y2")
    )
    return H.interference(z, 4000)
