"""Contours, chains and boundary observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import contours as C
from rasterlake.plans.functions_queries import r6
from rasterlake.registry import query


def along(p: str, q: str, level: float) -> str:
    return f"least(1.0, greatest(0.0, CASE WHEN abs({q} - {p}) < 1e-300 THEN 0.5 ELSE ({level} - {p}) / nullif({q} - {p}, 0) END))"


def segments_sql(src: str, level: float) -> str:
    """CTE ``sg(image_id, saddle, xa, ya, xb, yb, ea, eb)`` of ``src(image_id, x, y, v)``."""
    e = lambda dx, dy, k: f"((y + {dy})::BIGINT * 1048576 + x + {dx}) * 2 + {k}"
    pt = {
        "T": (e(0, 0, 0), f"x + 0.5 + {along('a', 'b', level)}", "y + 0.5"), "B": (e(0, 1, 0), f"x + 0.5 + {along('d', 'c', level)}", "y + 1.5"),
        "L": (e(0, 0, 1), "x + 0.5", f"y + 0.5 + {along('a', 'd', level)}"), "R": (e(1, 0, 1), "x + 1.5", f"y + 0.5 + {along('b', 'c', level)}"),
    }
    five = f"((cs = 5) = ((a + b + c + d) * 0.25 >= {level}))"
    rows = [("L", "T", "cs IN (1, 14)"), ("T", "R", "cs IN (2, 13)"), ("L", "R", "cs IN (3, 12)"), ("R", "B", "cs IN (4, 11)"), ("T", "B", "cs IN (6, 9)"), ("L", "B", "cs IN (7, 8)"),
            ("L", "T", f"cs IN (5, 10) AND {five}"), ("R", "B", f"cs IN (5, 10) AND {five}"), ("L", "B", f"cs IN (5, 10) AND NOT {five}"), ("T", "R", f"cs IN (5, 10) AND NOT {five}")]
    sel = " UNION ALL ".join(f"SELECT image_id, cs IN (5, 10) AS saddle, {pt[p][0]} AS ea, {pt[p][1]} AS xa, {pt[p][2]} AS ya, {pt[q][0]} AS eb, {pt[q][1]} AS xb, {pt[q][2]} AS yb FROM cl WHERE {w}" for p, q, w in rows)
    return f"""c0 AS (SELECT *, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS e, lead(v) OVER (PARTITION BY image_id, x ORDER BY y) AS s FROM {src}), c1 AS (SELECT *, lead(e) OVER (PARTITION BY image_id, x ORDER BY y) AS se FROM c0),
    cl AS (SELECT image_id, x, y, v AS a, e AS b, se AS c, s AS d, (v >= {level})::INT + 2 * (e >= {level})::INT + 4 * (se >= {level})::INT + 8 * (s >= {level})::INT AS cs FROM c1 WHERE se IS NOT NULL), sg AS ({sel})"""


LEN = "sqrt(pow(xb - xa, 2) + pow(yb - ya, 2))"


@query("r02_contour_segments", "grid", f"{segments_sql('grid', 0.45)} SELECT image_id, saddle, ea, eb, round(xa, 6) AS xa, round(ya, 6) AS ya, round(xb, 6) AS xb, round(yb, 6) AS yb FROM sg")
def r02(t):
    return C.segments(t.grid(), 0.45).select("image_id", "saddle", "ea", "eb", *[r6(F.col(c), c) for c in ("xa", "ya", "xb", "yb")])


PX = "f AS (SELECT image_id, x, y, alpha AS v FROM px8s)"


@query("r02_contour_length", "px8s", f"{PX}, {segments_sql('f', 0.5)} SELECT i.image_id, round(coalesce(sum({LEN}), 0), 6) AS length, count(ea) AS segments, (count(*) FILTER (WHERE saddle) / 2)::BIGINT AS saddles FROM (SELECT DISTINCT image_id FROM f) i LEFT JOIN sg USING (image_id) GROUP BY 1")
def r02b(t):
    d = C.contour_summary(t.px8s(), 0.5, "alpha")
    return d.withColumn("length", F.round("length", 6))


@query(
    "r03_chain_summary",
    "px8s",
    f"""RECURSIVE {PX}, {segments_sql('f', 0.5)}, ed AS (SELECT image_id, ea AS u, eb AS w FROM sg UNION SELECT image_id, eb, ea FROM sg), wk(image_id, s, u) AS (SELECT image_id, u, u FROM ed UNION SELECT wk.image_id, wk.s, ed.w FROM wk JOIN ed ON ed.image_id = wk.image_id AND ed.u = wk.u),
    ch AS (SELECT image_id, u, min(s) AS chain FROM wk GROUP BY image_id, u), dg AS (SELECT image_id, u, count(*) AS deg FROM (SELECT image_id, ea AS u FROM sg UNION ALL SELECT image_id, eb FROM sg) GROUP BY ALL),
    a AS (SELECT sg.image_id, chain, count(*) AS segments, sum({LEN}) AS length FROM sg JOIN ch ON ch.image_id = sg.image_id AND ch.u = ea GROUP BY ALL), b AS (SELECT image_id, chain, count(*) AS vertices, bool_and(deg = 2) AS closed FROM ch JOIN dg USING (image_id, u) GROUP BY ALL)
    SELECT image_id, chain, segments, round(length, 6) AS length, vertices, closed FROM a JOIN b USING (image_id, chain)""",
)
def r03(t):
    return C.chain_summary(t.px8s(), 0.5, "alpha").withColumn("length", F.round("length", 6))


@query(
    "r03_ordered_chains",
    "px8s",
    f"""RECURSIVE {PX}, {segments_sql('f', 0.5)}, ed AS (SELECT image_id, ea AS u, eb AS w FROM sg UNION SELECT image_id, eb, ea FROM sg), wk(image_id, s, u) AS (SELECT image_id, u, u FROM ed UNION SELECT wk.image_id, wk.s, ed.w FROM wk JOIN ed ON ed.image_id = wk.image_id AND ed.u = wk.u),
    ch AS (SELECT image_id, u, min(s) AS chain FROM wk GROUP BY image_id, u), dg AS (SELECT image_id, u, count(*) AS deg FROM (SELECT image_id, ea AS u FROM sg UNION ALL SELECT image_id, eb FROM sg) GROUP BY ALL),
    vx AS (SELECT image_id, u, any_value(x) AS px, any_value(y) AS py FROM (SELECT image_id, ea AS u, xa AS x, ya AS y FROM sg UNION ALL SELECT image_id, eb, xb, yb FROM sg) GROUP BY 1, 2),
    kd AS (SELECT ch.image_id, chain, count(*) AS vertices, min(u) FILTER (WHERE deg = 1) IS NULL AS closed, coalesce(min(u) FILTER (WHERE deg = 1), min(u)) AS start FROM ch JOIN dg USING (image_id, u) GROUP BY ch.image_id, chain),
    s2 AS (SELECT kd.*, min(w) AS second FROM kd JOIN ed ON ed.image_id = kd.image_id AND ed.u = kd.start GROUP BY ALL),
    st(image_id, chain, start, closed, prev, cur, k, s) AS (SELECT s2.image_id, chain, start, closed, start, second, 1, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) FROM s2 JOIN vx a ON a.image_id = s2.image_id AND a.u = start JOIN vx b ON b.image_id = s2.image_id AND b.u = second
      UNION ALL SELECT t.image_id, t.chain, t.start, t.closed, t.cur, e.w, t.k + 1, t.s + sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) FROM st t JOIN ed e ON e.image_id = t.image_id AND e.u = t.cur AND e.w <> t.prev JOIN vx a ON a.image_id = t.image_id AND a.u = t.cur JOIN vx b ON b.image_id = t.image_id AND b.u = e.w WHERE t.cur <> t.start),
    pl AS (SELECT image_id, chain, start AS edge, 0 AS k, 0.0::DOUBLE AS s FROM kd UNION ALL SELECT image_id, chain, cur, k, s FROM st WHERE cur <> start), ln AS (SELECT image_id, chain, max(s) AS length FROM st GROUP BY 1, 2)
    SELECT pl.image_id, pl.chain, closed, vertices, round(length, 6) AS length, edge, k::BIGINT AS k, round(s, 6) AS s, round(px, 6) AS px, round(py, 6) AS py, deg = 1 AND NOT (round(px, 9) IN (0.5, 7.5) OR round(py, 9) IN (0.5, 7.5)) AS malformed_end
    FROM pl JOIN kd ON kd.image_id = pl.image_id AND kd.chain = pl.chain JOIN ln ON ln.image_id = pl.image_id AND ln.chain = pl.chain JOIN vx ON vx.image_id = pl.image_id AND vx.u = edge JOIN dg ON dg.image_id = pl.image_id AND dg.u = edge""",
)
def r03b(t):
    d = C.chains(t.px8s(), 0.5, "alpha")
    return d.withColumns({c: F.round(c, 6) for c in ("length", "s", "px", "py")})


@query("r04_boundary_observations", "px8s", None)
def r04(t):
    return C.boundary_observations(t.px8s(), 0.5, "alpha", noise=2.0 / 255)


@query(
    "j07_bilinear_lookup",
    "px8",
    """p AS (SELECT image_id, x AS pid, 0.3 + x * 1.13 AS px, 7.9 - x * 0.87 AS py FROM px8 WHERE y = 0), q AS (SELECT *, least(7.0, greatest(0.0, px - 0.5)) AS fx, least(7.0, greatest(0.0, py - 0.5)) AS fy FROM p),
    c AS (SELECT *, floor(fx)::INT AS i, floor(fy)::INT AS j, fx - floor(fx) AS tx, fy - floor(fy) AS ty FROM q), v AS (SELECT image_id, x, y, alpha FROM px8)
    SELECT c.image_id, pid, round((v00.alpha * (1 - tx) + v10.alpha * tx) * (1 - ty) + (v01.alpha * (1 - tx) + v11.alpha * tx) * ty, 6) AS a FROM c JOIN v v00 ON v00.image_id = c.image_id AND v00.x = i AND v00.y = j
      JOIN v v10 ON v10.image_id = c.image_id AND v10.x = least(i + 1, 7) AND v10.y = j JOIN v v01 ON v01.image_id = c.image_id AND v01.x = i AND v01.y = least(j + 1, 7) JOIN v v11 ON v11.image_id = c.image_id AND v11.x = least(i + 1, 7) AND v11.y = least(j + 1, 7)""",
)
def j07(t):
    x = F.col("x")
    pts = t.px8().filter("y = 0").select("image_id", x.alias("pid"), (x * 1.13 + 0.3).alias("px"), (F.lit(7.9) - x * 0.87).alias("py"))
    return C.bilinear(pts, t.px8(), "alpha", "a").withColumn("a", F.round("a", 6))
