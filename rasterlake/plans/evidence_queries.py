"""Mixtures, kernels, likelihoods and correlation over the raster tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import evidence as V, fields as W
from rasterlake.operators.palette import mark_border
from rasterlake.operators.quantiles import metric_quantiles
from rasterlake.plans.contour_queries import LEN, segments_sql
from rasterlake.plans.functions_queries import r6
from rasterlake.plans.raster_sql import nb, norm, obs_sql
from rasterlake.registry import query

PAIR_SQL = """hp AS (SELECT DISTINCT image_id, 200 / 255.0::DOUBLE AS fr, 190 / 255.0::DOUBLE AS fg, 30 / 255.0::DOUBLE AS fb, 1.0::DOUBLE AS fa, CASE WHEN image_id % 2 = 0 THEN 40 ELSE 0 END / 255.0::DOUBLE AS br,
   CASE WHEN image_id % 2 = 0 THEN 60 ELSE 0 END / 255.0::DOUBLE AS bg, CASE WHEN image_id % 2 = 0 THEN 30 ELSE 0 END / 255.0::DOUBLE AS bb, CASE WHEN image_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ba FROM rgba8)"""
DEN = "((fr - br) * (fr - br) + (fg - bg) * (fg - bg) + (fb - bb) * (fb - bb) + (fa - ba) * (fa - ba))"
MIX_SQL = f"""{obs_sql('rgba8')}, {PAIR_SQL}, m1 AS (SELECT ob.*, hp.* EXCLUDE (image_id), sqrt({DEN}) AS cond, least(1.0, greatest(0.0, ((pr - br) * (fr - br) + (pg - bg) * (fg - bg) + (pb - bb) * (fb - bb) + (pa - ba) * (fa - ba)) / {DEN})) AS al FROM ob JOIN hp USING (image_id)),
  m2 AS (SELECT *, pr - (br + al * (fr - br)) AS e1, pg - (bg + al * (fg - bg)) AS e2, pb - (bb + al * (fb - bb)) AS e3, pa - (ba + al * (fa - ba)) AS e4, {norm(['qr', 'qg', 'qb', 'qa'])} / cond AS aq FROM m1),
  m3 AS (SELECT image_id, x, y, pa, al, aq, cond, sqrt(e1 * e1 + e2 * e2 + e3 * e3 + e4 * e4) AS res, (e1 * (fr - br) + e2 * (fg - bg) + e3 * (fb - bb) + e4 * (fa - ba)) / cond AS sgn FROM m2), {nb('m3', 'mx', ['al'])}"""


FLATNESS = "sqrt(pow(least(abs(al - w_al), abs(e_al - al)), 2) + pow(least(abs(al - n_al), abs(s_al - al)), 2))"


def interior_shapes_sql(src: str = "mx") -> str:
    """CTE ``si``: the largest flat region of intermediate coverage of each image, by a flood over runs."""
    return f"""fl AS (SELECT image_id, x, y, al FROM {src} WHERE al > 0.08 AND al < 0.92 AND {FLATNESS} <= 8 * greatest(aq, 1e-9)),
  rn AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1, count(*) AS n, sum(al) AS t, min(al) AS lo, max(al) AS hi, y::BIGINT * 1048576 + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS gp FROM fl) GROUP BY image_id, y, gp),
  ct AS (SELECT a.image_id, a.id AS p, b.id AS q, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1 AS shared FROM rn a JOIN rn b ON b.image_id = a.image_id AND b.y = a.y + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
  lk AS (SELECT image_id, p, q FROM ct UNION ALL SELECT image_id, q, p FROM ct),
  fd(image_id, s, id) AS (SELECT image_id, id, id FROM rn UNION SELECT fd.image_id, fd.s, lk.q FROM fd JOIN lk ON lk.image_id = fd.image_id AND lk.p = fd.id),
  rt AS (SELECT image_id, id, min(s) AS region FROM fd GROUP BY 1, 2), sh AS (SELECT image_id, p AS id, sum(shared) AS shared FROM ct GROUP BY 1, 2),
  rs AS (SELECT rn.image_id, region, sum(n) AS area, sum(2 * n + 2 - 2 * coalesce(shared, 0)) AS per, sum(t) / sum(n) AS mean, max(hi) - min(lo) AS span FROM rn JOIN rt USING (image_id, id) LEFT JOIN sh USING (image_id, id) GROUP BY rn.image_id, region),
  si AS (SELECT image_id, arg_max({{'a': area, 'p': per, 'm': mean, 's': span}}, (area, -region)) AS b, count(*) AS regions, sum(area)::BIGINT AS flat_px FROM rs GROUP BY 1)"""


def interior_sql(src: str) -> str:
    return f"""RECURSIVE {MIX_SQL.replace("rgba8", src)}, {interior_shapes_sql()} SELECT image_id, b.a::BIGINT AS largest_region_px, round(2 * b.a / b.p::DOUBLE, 6) AS thickness, regions, round(b.m, 6) AS coverage, round(b.s, 6) AS coverage_span, flat_px FROM si WHERE b.a >= 24"""


def interiors(px):
    d = V.semi_transparent(mixtures_of(px))
    return d.select("image_id", "largest_region_px", "regions", "flat_px", *[r6(F.col(c), c) for c in ("thickness", "coverage", "coverage_span")])


def mixtures(t):
    return mixtures_of(t.rgba8())


def mixtures_of(px):
    even = F.col("image_id") % 2 == 0
    bg = lambda v: (F.when(even, v).otherwise(0) / 255.0)
    pairs = px.select("image_id").distinct().select(
        "image_id", *[F.lit(v / 255).alias(f"f{c}") for c, v in zip("rgb", (200, 190, 30))], F.lit(1.0).alias("fa"),
        bg(40).alias("br"), bg(60).alias("bg"), bg(30).alias("bb"), F.when(even, 1.0).otherwise(0.0).alias("ba"),
    )
    return V.mixture(W.observed(px), pairs)


@query(
    "p04_two_colour_mixture",
    "rgba8",
    f"""{MIX_SQL} SELECT image_id, x, y, round(al, 6) AS alpha, round(res, 6) AS residual, round(aq, 6) AS alpha_quant, round(sqrt(pow(0.5 * (e_al - w_al), 2) + pow(0.5 * (s_al - n_al), 2)), 6) AS gradient,
      round(sqrt(pow(least(abs(al - w_al), abs(e_al - al)), 2) + pow(least(abs(al - n_al), abs(s_al - al)), 2)), 6) AS flatness FROM mx""",
)
def p04(t):
    return mixtures(t).select("image_id", "x", "y", *[r6(F.col(c), c) for c in ("alpha", "residual", "alpha_quant", "gradient", "flatness")])


@query(
    "a12_w05_residual_indicators",
    "rgba8",
    f"""{MIX_SQL}, s AS (SELECT *, res * 255 AS codes, sign(round(sgn, 12)) AS sg, lag(sign(round(sgn, 12))) OVER (PARTITION BY image_id, y ORDER BY x) AS pv, row_number() OVER (PARTITION BY image_id ORDER BY res) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM mx)
    SELECT image_id, round(avg(codes), 6) AS mean_codes, round(max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN codes END), 6) AS p95_codes, round(max(codes), 6) AS max_codes,
      round(sum(CASE WHEN pa > {1 / 255!r} AND pa < 1 - {1 / 255!r} THEN codes ELSE 0 END) / sum(codes), 6) AS mixed_mass, round(count(*) / count(*) FILTER (WHERE pv IS NULL OR pv <> sg)::DOUBLE, 6) AS mean_run_px FROM s GROUP BY image_id""",
)
def a12(t):
    d = V.residual_indicators(mixtures(t))
    return d.select("image_id", *[r6(F.col(c), c) for c in d.columns if c != "image_id"])


TW_SQL = f"""f AS (SELECT image_id, x, y, alpha AS v FROM px8s), {segments_sql('f', 0.5)}, ln AS (SELECT image_id, sum({LEN}) AS l FROM sg GROUP BY 1),
  tw AS (SELECT image_id, coalesce(any_value(l), 0) AS len, CASE WHEN coalesce(any_value(l), 0) > 0 THEN sum(4 * v * (1 - v)) / any_value(l) ELSE 0 END AS w, coalesce(count(*) FILTER (WHERE v >= 0.98) / nullif(count(*) FILTER (WHERE v > 0.02), 0)::DOUBLE, 0) AS rf FROM f LEFT JOIN ln USING (image_id) GROUP BY 1)"""


@query("a13_transition_width", "px8s", f"{TW_SQL} SELECT image_id, round(len, 6) AS length, round(w, 6) AS width, round(rf, 6) AS resolved FROM tw")
def a13(t):
    d = V.transition_width(t.px8s())
    return d.select("image_id", *[r6(F.col(c), c) for c in ("length", "width", "resolved")])


KV = ", ".join(f"('{n}', {w}, {s})" for n, w, s in V.KERNELS)


@query(
    "a14_kernel_choice",
    "px8s",
    f"""{TW_SQL}, kt(kernel, kw, sd) AS (VALUES {KV}), k AS (SELECT tw.*, kernel, 0.5 * pow((w - kw::DOUBLE) / sd::DOUBLE, 2) AS p, CASE WHEN rf < 0.25 THEN 'unresolved' WHEN len <= 0 THEN 'no_contour' END AS refusal FROM tw CROSS JOIN kt), b AS (SELECT *, min(p) OVER (PARTITION BY image_id) AS bp FROM k)
    SELECT image_id, round(w, 6) AS width, round(rf, 6) AS resolved, refusal, kernel, round(p, 4) AS penalty FROM b WHERE refusal IS NULL AND p <= bp + 2 UNION ALL SELECT DISTINCT image_id, round(w, 6), round(rf, 6), refusal, NULL, NULL FROM b WHERE refusal IS NOT NULL""",
)
def a14(t):
    d = V.kernel_choice(t.px8s())
    return d.select("image_id", r6(F.col("width"), "width"), r6(F.col("resolved"), "resolved"), "refusal", "kernel", F.round("penalty", 4).alias("penalty"))


@query(
    "a20_otsu",
    "px8",
    """h AS (SELECT image_id, code AS bin, count(*) AS c FROM px8 GROUP BY ALL), q AS (SELECT image_id, bin, sum(c) OVER w AS nb, sum(bin * c) OVER w AS sb, sum(c) OVER p AS n, sum(bin * c) OVER p AS s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY bin), p AS (PARTITION BY image_id)),
    v AS (SELECT *, CASE WHEN n > nb AND bin < 255 THEN nb * (n - nb) * pow(sb / nb::DOUBLE - (s - sb) / (n - nb)::DOUBLE, 2) END AS var FROM q) SELECT image_id, coalesce(arg_max(bin, (round(var, 6), -bin)) FILTER (WHERE var IS NOT NULL), 0)::INT AS threshold FROM v GROUP BY 1""",
)
def a20(t):
    return V.otsu(t.px8())


@query(
    "a21_border_medians",
    "rgba8",
    "b AS (SELECT * FROM rgba8 WHERE x IN (0, 7) OR y IN (0, 7)) SELECT image_id, " + ", ".join(f"list_sort(list({c}))[1 + count(*) // 2]::DOUBLE AS {c}" for c in "rgba") + " FROM b GROUP BY image_id",
)
def a21(t):
    d = mark_border(t.rgba8()).filter("border")
    return metric_quantiles(d, ["image_id"], {c: {c: ("floor", 0.5)} for c in "rgba"})


DZ = "dz AS (SELECT image_id, x, y, sign(obs - pred) * greatest(abs(obs - pred) - 0.02, 0) AS r FROM pair)"


def residuals(t):
    return t.pair().select("image_id", "x", "y", V.dead_zone(F.col("obs") - F.col("pred"), F.lit(0.02)).alias("r"))


@query(
    "a10_image_difference",
    "rgba8",
    """d AS (SELECT p.image_id, p.a, abs(p.r * p.a / 255.0::DOUBLE - q.r * q.a / 255.0::DOUBLE) AS dr, abs(p.g * p.a / 255.0::DOUBLE - q.g * q.a / 255.0::DOUBLE) AS dg, abs(p.b * p.a / 255.0::DOUBLE - q.b * q.a / 255.0::DOUBLE) AS db, abs(p.a - q.a)::DOUBLE AS da
       FROM rgba8 p JOIN rgba8 q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y)
    SELECT image_id, round(max(greatest(dr, dg, db, da)), 6) AS max_code, round(avg((dr + dg + db + da) / 4), 6) AS frame_mean, round(coalesce(avg(CASE WHEN a > 0 AND a < 255 THEN (dr + dg + db + da) / 4 END), 0), 6) AS edge_mean,
      count(*) FILTER (WHERE a > 0 AND a < 255) AS edge_pixels, round(avg((greatest(dr, dg, db, da) = 0)::INT), 6) AS identical FROM d GROUP BY 1""",
)
def a10(t):
    b = t.rgba8().select((F.col("image_id") - 1).alias("image_id"), "x", "y", *[F.col(c).alias(c + "2") for c in "rgba"])
    d = V.image_difference(t.rgba8().join(b, ["image_id", "x", "y"]), (F.col("a") > 0) & (F.col("a") < 255))
    return d.select("image_id", "edge_pixels", *[r6(F.col(c), c) for c in ("max_code", "frame_mean", "edge_mean", "identical")])


@query("a22_block_likelihood", "pair", f"{DZ}, b AS (SELECT image_id, x // 4 AS bx, y // 4 AS by_, avg(r * r) AS e FROM dz GROUP BY ALL) SELECT image_id, round(sum(2.5 * log2(1 + e / 0.01 / 4)), 6) AS pixel_bits, count(*) AS blocks FROM b GROUP BY 1")
def a22(t):
    return V.block_likelihood(residuals(t), 4, 0.1).withColumn("pixel_bits", F.round("pixel_bits", 6))


@query(
    "a23_lag_correlation",
    "pair",
    f"""{DZ}, {nb('dz', 'nz', ['r'], clamp=False)}, s AS (SELECT image_id, sum(r * e_r) / nullif(sqrt(sum(r * r) FILTER (WHERE e_r IS NOT NULL) * sum(e_r * e_r)), 0) AS lx, sum(r * s_r) / nullif(sqrt(sum(r * r) FILTER (WHERE s_r IS NOT NULL) * sum(s_r * s_r)), 0) AS ly FROM nz GROUP BY 1), m AS (SELECT *, greatest(abs(coalesce(lx, 0)), abs(coalesce(ly, 0))) AS a FROM s)
    SELECT image_id, round(coalesce(lx, 0), 6) AS lag_x, round(coalesce(ly, 0), 6) AS lag_y, round(CASE WHEN a > 0 AND a < 1 THEN greatest(-1 / ln(a), 1) ELSE 1 END, 6) AS length_px FROM m""",
)
def a23(t):
    d = V.lag_correlation(residuals(t))
    return d.select("image_id", *[r6(F.col(c), c) for c in ("lag_x", "lag_y", "length_px")])


def tr_sql(kind: str, size: int) -> str:
    vals = ", ".join(f"({u}, {x}, {c!r}::DOUBLE)" for u, r in enumerate(V.basis(kind, size)) for x, c in enumerate(r))
    return f"""bs(u, p, c) AS (VALUES {vals}), {DZ}, tt AS (SELECT image_id, x // {size} AS bx, y // {size} AS by_, a.u AS u, b.u AS v, sum(a.c * b.c * r) AS t FROM dz JOIN bs a ON a.p = x % {size} JOIN bs b ON b.p = y % {size} GROUP BY ALL)
    SELECT '{kind}' AS kind, round(sqrt(avg(t * t) FILTER (WHERE u = 0 AND v = 0)), 6) AS dc_rms, round(sqrt(avg(t * t) FILTER (WHERE u > 0 OR v > 0)), 6) AS ac_rms, count(*) FILTER (WHERE u = 0 AND v = 0) AS blocks FROM tt"""


def energy(t, kind, size):
    d = V.transform_energy(residuals(t), kind, size)
    return d.select(F.lit(kind).alias("kind"), r6(F.col("dc_rms"), "dc_rms"), r6(F.col("ac_rms"), "ac_rms"), "blocks")


for _kind, _size in (("cosine", 8), ("hadamard", 4), ("identity", 2)):
    query(f"a24_transform_energy_{_kind}", "pair", tr_sql(_kind, _size))(lambda t, k=_kind, s=_size: energy(t, k, s))

PAINT_PX = "pp AS (SELECT image_id, label, alpha AS v, 0.5 + (x % 3) / 4.0::DOUBLE AS weight, 0.001 * (y % 4) AS q FROM labels4 JOIN px8 USING (image_id, x, y)), pt AS (SELECT image_id, label, count(*) AS support, sum(weight / pow(greatest(q, 1 / 510.0::DOUBLE), 2) * v) / sum(weight / pow(greatest(q, 1 / 510.0::DOUBLE), 2)) AS p FROM pp GROUP BY ALL)"


def paint_pixels(t):
    label = F.least(F.lit(3), F.floor(F.col("alpha") * 4).cast("int"))
    return t.px8().select("image_id", "x", "y", label.alias("label"), F.col("alpha").alias("v"), (F.col("x") % 3 / 4.0 + 0.5).alias("weight"), (F.col("y") % 4 * 0.001).alias("q"))


@query("a25_region_paints", "labels4", f"{PAINT_PX} SELECT image_id, label, support, CASE WHEN support < 4 THEN 'insufficient_support' END AS refusal, CASE WHEN support >= 4 THEN round(p, 6) END AS paint FROM pt")
def a25(t):
    return V.hard_paints(paint_pixels(t), 4).withColumn("paint", F.round("paint", 6))


@query("a26_fixed_paint_score", "labels4", f"{PAINT_PX} SELECT image_id, round(sum(weight * pow(((64 * label + 32) / 255.0::DOUBLE - v) / greatest(q, 1 / 510.0::DOUBLE), 2)), 3) AS score FROM pp GROUP BY 1")
def a26(t):
    px = paint_pixels(t)
    paints = px.select("image_id", "label").distinct().withColumn("paint", (F.col("label") * 64 + 32) / 255.0)
    return V.fixed_paint_score(px, paints).withColumn("score", F.round("score", 3))


LAGS = 4


@query(
    "a29_autocorrelation",
    "pair",
    f"""{DZ}, ac AS (SELECT image_id, x, y, CASE WHEN abs(r) > 1e-12 THEN r END AS r FROM dz), m AS (SELECT image_id, count(r) AS n, avg(r) AS mu, var_pop(r) AS var FROM ac GROUP BY 1 HAVING count(r) > 0),
    l AS (SELECT a.image_id, k, avg((a.r - mu) * (bx.r - mu)) / nullif(any_value(var), 0) AS cx, avg((a.r - mu) * (bb.r - mu)) / nullif(any_value(var), 0) AS cy FROM ac a JOIN m USING (image_id) CROSS JOIN (SELECT range + 1 AS k FROM range(0, {LAGS})) LEFT JOIN ac bx ON bx.image_id = a.image_id AND bx.y = a.y AND bx.x = a.x + k
       LEFT JOIN ac bb ON bb.image_id = a.image_id AND bb.x = a.x AND bb.y = a.y + k GROUP BY ALL),
    z AS (SELECT image_id, min(CASE WHEN coalesce(cx, 0) < exp(-1.0::DOUBLE) THEN k END)::INT AS length_x, min(CASE WHEN coalesce(cy, 0) < exp(-1.0::DOUBLE) THEN k END)::INT AS length_y FROM l GROUP BY 1),
    e AS (SELECT m.image_id, n, length_x, length_y, greatest(n / ((2 * coalesce(length_x, {LAGS}) - 1) * (2 * coalesce(length_y, {LAGS}) - 1))::DOUBLE, 1.0) AS eff FROM m JOIN z USING (image_id)
      UNION ALL SELECT DISTINCT image_id, 0, 1, 1, 1.0 FROM dz WHERE image_id NOT IN (SELECT image_id FROM m))
    SELECT image_id, n AS active, length_x, length_y, round(eff, 6) AS effective, round(n / eff, 6) AS overcount FROM e""",
)
def a29(t):
    d = V.autocorrelation(residuals(t), LAGS)
    return d.withColumns({"effective": F.round("effective", 6), "overcount": F.round("overcount", 6)})


@query(
    "a64_two_colour_outcome",
    "meas",
    """e AS (SELECT group_id AS image_id, CASE WHEN ascii(class) % 2 = 1 THEN 'opaque:' ELSE 'clear:' END || class || '-' || (cell_id % 2) AS class, 'h' || scene_id || '-' || cell_id || '-' || quantity || '-' || l_partkey AS id, quantity % 3 > 0 AS cond,
      floor(bits_per_block) + l_partkey % 2 * 5e-10::DOUBLE AS score, p95_px * 100 AS p95, CASE WHEN quantity % 6 = 4 THEN quantity / 10.0::DOUBLE END AS th, CASE WHEN quantity = 50 THEN 'more_than_two_faces' END AS pr FROM meas),
    lo AS (SELECT image_id, class, min(score) AS low FROM e WHERE cond GROUP BY ALL),
    b AS (SELECT image_id, class, arg_min({'p': p95, 't': th}, id) AS b FROM e JOIN lo USING (image_id, class) WHERE cond AND score <= low + CASE WHEN class LIKE 'opaque:%' THEN 1e-9 ELSE 0 END GROUP BY ALL),
    g AS (SELECT image_id, count(*) FILTER (WHERE b.t IS NULL AND b.p <= 12) AS ex, arg_min(b.t, class) FILTER (WHERE b.t IS NOT NULL) AS t FROM b GROUP BY 1), i AS (SELECT image_id, max(pr) AS pr, bool_or(cond) AS cond FROM e GROUP BY 1)
    SELECT image_id, coalesce(ex, 0) AS explaining, CASE WHEN pr IS NOT NULL THEN 'unsupported_palette' WHEN NOT cond THEN 'unsupported_no_well_conditioned_pair' WHEN ex = 0 AND t >= 2 THEN 'unsupported_semi_transparent' WHEN ex = 0 AND t IS NOT NULL THEN 'ambiguous_thin' WHEN ex = 0 THEN 'unsupported_no_explanation' WHEN ex = 1 THEN 'supported' ELSE 'ambiguous' END AS outcome
    FROM i LEFT JOIN g USING (image_id)""",
)
def a64(t):
    q = F.col("quantity")
    kind = F.when(F.ascii("class") % 2 == 1, "opaque:").otherwise("clear:")
    e = t.meas().select(
        F.col("group_id").alias("image_id"), F.concat(kind, "class", F.lit("-"), F.col("cell_id") % 2).alias("class"), F.concat(F.lit("h"), F.concat_ws("-", "scene_id", "cell_id", "quantity", "l_partkey")).alias("id"),
        (q % 3 > 0).alias("conditioned"), (F.floor("bits_per_block") + F.col("l_partkey") % 2 * 5e-10).alias("score"), (F.col("p95_px") * 100).alias("p95"),
        F.when(q % 6 == 4, q / 10.0).alias("thickness"), F.when(q == 50, "more_than_two_faces").alias("palette_refusal"),
    )
    return V.two_colour_outcome(e, 12.0)


@query("a62_semi_transparent", "flat32", interior_sql("flat32"))
def a62(t):
    return interiors(t.flat32())


#: readings of an image: class, id, foreground, background
READINGS = [
    ("opaque:a", "p0", (200, 190, 30, 255), (40, 60, 30, 255)), ("opaque:b", "p1", (200, 60, 220, 255), (40, 60, 30, 255)),
    ("clear:a", "p2", (200, 190, 30, 255), (0, 0, 0, 0)), ("opaque:a", "p3", (40, 60, 30, 255), (41, 60, 30, 255)),
]
READING_SQL = ", ".join(f"({k}, '{c}', '{i}', {', '.join(f'{v} / 255.0::DOUBLE' for v in (*f, *b))})" for k, (c, i, f, b) in enumerate(READINGS))
# four of five images have two colours only, every second of these no background
DUO_SQL = """duo AS (SELECT image_id, x, y, r, CASE WHEN image_id % 5 = 0 THEN g WHEN r = 200 THEN 190 ELSE 60 END AS g, CASE WHEN image_id % 5 = 0 THEN b ELSE 30 END AS b,
  CASE WHEN image_id % 5 = 0 THEN a WHEN image_id % 2 = 1 AND r = 40 THEN 0 ELSE 255 END AS a FROM flat32)"""
READ_MIX = MIX_SQL[MIX_SQL.index("m1 AS") :]


@query(
    "a64_outcome_of_mixtures",
    "flat32",
    f"""RECURSIVE rd(k, class, id, fr, fg, fb, fa, br, bg, bb, ba) AS (VALUES {READING_SQL}), {DUO_SQL}, sc AS (SELECT image_id * 4 + k AS image_id, x, y, r, g, b, a FROM duo CROSS JOIN rd), {obs_sql('sc')},
    hp AS (SELECT DISTINCT image_id, fr, fg, fb, fa, br, bg, bb, ba FROM sc JOIN rd ON k = image_id % 4), {READ_MIX}, mw AS (SELECT * FROM mx WHERE cond >= 0.02), {interior_shapes_sql('mw')},
    q AS (SELECT image_id, res * 255 AS codes, row_number() OVER (PARTITION BY image_id ORDER BY res) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM mw), p AS (SELECT image_id, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN codes END) AS p95 FROM q GROUP BY 1),
    e AS (SELECT hp.image_id // 4 AS image_id, class, id, p95, round(0.5 * pow(p95 / 25.57::DOUBLE, 2), 9) AS score, CASE WHEN b.a >= 24 THEN 2 * b.a / b.p::DOUBLE END AS th FROM hp JOIN rd ON k = hp.image_id % 4 JOIN p ON p.image_id = hp.image_id LEFT JOIN si ON si.image_id = hp.image_id),
    w AS (SELECT image_id, class, arg_min({{'p': p95, 't': th}}, (score, id)) AS b FROM e GROUP BY ALL), g AS (SELECT image_id, count(*) FILTER (WHERE b.t IS NULL AND b.p <= 60) AS ex, arg_min(b.t, class) FILTER (WHERE b.t IS NOT NULL) AS t FROM w GROUP BY 1)
    SELECT image_id, ex AS explaining, CASE WHEN ex = 0 AND t >= 2 THEN 'unsupported_semi_transparent' WHEN ex = 0 AND t IS NOT NULL THEN 'ambiguous_thin' WHEN ex = 0 THEN 'unsupported_no_explanation' WHEN ex = 1 THEN 'supported' ELSE 'ambiguous' END AS outcome FROM g""",
)
def a64b(t):
    many, inside = F.col("image_id") % 5 == 0, F.col("r") == 200
    px = t.flat32().select(
        "image_id", "x", "y", "r", F.when(many, F.col("g")).when(inside, 190).otherwise(60).alias("g"), F.when(many, F.col("b")).otherwise(30).alias("b"),
        F.when(many, F.col("a")).when((F.col("image_id") % 2 == 1) & ~inside, 0).otherwise(255).alias("a"),
    )
    colours = lambda f, b: [F.lit(v / 255).alias(f"{k}{c}") for k, vs in (("f", f), ("b", b)) for c, v in zip("rgba", vs)]
    readings = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(i).alias("id"), *colours(f, b)) for c, i, f, b in READINGS])
    pairs = px.select("image_id").distinct().select("image_id", F.inline(readings))
    return V.two_colour_outcome(V.mixture_evidence(W.observed(px), pairs), 60.0)


# three regions share a pixel two at a time, as the fourth channel says
SOFT_SQL = """sc AS (SELECT image_id, x, y, a / 255.0::DOUBLE AS u, r / 255.0::DOUBLE AS vr, g / 255.0::DOUBLE AS vg, b / 255.0::DOUBLE AS vb, 0.5 + (x % 3) / 4.0::DOUBLE AS w, greatest(0.001 * (y % 4), 1 / 510.0::DOUBLE) AS q FROM rgba8),
  sw AS (SELECT image_id, greatest(0, 1 - 2 * u) AS c0, 1 - abs(2 * u - 1) AS c1, greatest(0, 2 * u - 1) AS c2, vr, vg, vb, w / (q * q) AS w FROM sc),
  sn AS (SELECT image_id, sum(c0) AS s0, sum(c1) AS s1, sum(c2) AS s2, sum(w * c0 * c0) AS n00, sum(w * c0 * c1) AS n01, sum(w * c1 * c1) AS n11, sum(w * c1 * c2) AS n12, sum(w * c2 * c2) AS n22, """ + ", ".join(f"sum(w * c{k} * v{c}) AS t{k}{c}" for k in range(3) for c in "rgb") + """ FROM sw GROUP BY 1),
  sr AS (SELECT *, least(coalesce(nullif(s0, 0), 9), coalesce(nullif(s1, 0), 9), coalesce(nullif(s2, 0), 9)) >= 4 AS ok, n00 + rr AS d0, n11 + rr AS d1, n22 + rr AS d2 FROM (SELECT *, 0.001 * greatest(1, n00, n11, n22) AS rr FROM sn)),
  se AS (SELECT *, d1 - n01 * n01 / d0 AS e1, """ + ", ".join(f"t1{c} - n01 / d0 * t0{c} AS f1{c}" for c in "rgb") + """ FROM sr), sg AS (SELECT *, d2 - n12 * n12 / e1 AS e2, """ + ", ".join(f"t2{c} - n12 / e1 * f1{c} AS f2{c}" for c in "rgb") + """ FROM se),
  s2 AS (SELECT *, """ + ", ".join(f"f2{c} / e2 AS x2{c}" for c in "rgb") + """ FROM sg), sh AS (SELECT *, """ + ", ".join(f"(f1{c} - n12 * x2{c}) / e1 AS x1{c}" for c in "rgb") + """ FROM s2), so AS (SELECT *, """ + ", ".join(f"(t0{c} - n01 * x1{c}) / d0 AS x0{c}" for c in "rgb") + """ FROM sh)"""


def soft_regions(t):
    u = F.col("a") / 255.0
    px = t.rgba8().select("image_id", "x", "y", *[(F.col(c) / 255.0).alias(f"v{c}") for c in "rgb"], *[(F.col("y") % 4 * 0.001).alias(f"q{c}") for c in "rgb"], (F.col("x") % 3 / 4.0 + 0.5).alias("weight"), u.alias("u"))
    parts = [F.greatest(F.lit(0.0), 1.0 - F.col("u") * 2), 1.0 - F.abs(F.col("u") * 2 - 1.0), F.greatest(F.lit(0.0), F.col("u") * 2 - 1.0)]
    cover = px.select("image_id", "x", "y", F.posexplode(F.array(*parts)).alias("label", "coverage")).filter("coverage > 0")
    return cover, px


@query(
    "a25_soft_paints",
    "rgba8",
    SOFT_SQL + " " + " UNION ALL ".join(f"SELECT image_id, {k} AS label, round(s{k}, 6) AS support, CASE WHEN NOT ok THEN 'insufficient_support' END AS refusal, " + ", ".join(f"CASE WHEN ok THEN round(x{k}{c}, 6) END AS paint_{c}" for c in "rgb") + f" FROM so WHERE s{k} > 0" for k in range(3)),
)
def a25b(t):
    d = V.soft_paints(*soft_regions(t), 4, 0.001)
    return d.withColumns({c: F.round(c, 6) for c in ("support", "paint_r", "paint_g", "paint_b")})


@query(
    "a25_soft_paint_score",
    "rgba8",
    SOFT_SQL + ", sp AS (SELECT sw.*, " + ", ".join(f"x{k}{c}" for k in range(3) for c in "rgb") + " FROM sw JOIN so USING (image_id) WHERE ok) SELECT image_id, round(sum(w * (" + " + ".join(f"pow(c0 * x0{c} + c1 * x1{c} + c2 * x2{c} - v{c}, 2)" for c in "rgb") + ")), 3) AS score FROM sp GROUP BY 1",
)
def a25c(t):
    cover, px = soft_regions(t)
    return V.soft_paint_score(cover, px, V.soft_paints(cover, px, 4, 0.001)).withColumn("score", F.round("score", 3))


# rasters of 7x6 pixels, whose sides are no multiple of any block, beside the following raster as their prediction
CODEC_SQL = "od AS (SELECT p.image_id, p.x, p.y, " + ", ".join(f"p.{c} - q.{c} AS d{c}" for c in "rgba") + " FROM rgba8 p JOIN rgba8 q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y WHERE p.x < 7 AND p.y < 6)"


def codec_sql(codec: str) -> str:
    kind, block, *_ = V.CODECS[codec]
    vals = ", ".join(f"({u}, {x}, {c!r}::DOUBLE)" for u, r in enumerate(V.basis(kind, block)) for x, c in enumerate(r))
    wide = lambda k, m: f"(SELECT range AS {k} FROM range(0, {-(-m // block) * block}))"
    return f"""{CODEC_SQL}, bs(u, p, c) AS (VALUES {vals}), pd AS (SELECT image_id, i AS x, j AS y, {', '.join(f'd{c}' for c in 'rgba')} FROM od JOIN {wide('i', 7)} ON od.x = least(i, 6) JOIN {wide('j', 6)} ON od.y = least(j, 5)),
    tc AS (SELECT image_id, x // {block} AS bx, y // {block} AS by_, a.u AS u, b.u AS v, {', '.join(f'sum(a.c * b.c * d{c}) AS c{c}' for c in 'rgba')} FROM pd JOIN bs a ON a.p = x % {block} JOIN bs b ON b.p = y % {block} GROUP BY ALL)"""


def _observed(t):
    after = t.rgba8().select((F.col("image_id") - 1).alias("image_id"), "x", "y", *[F.col(c).alias(f"{c}2") for c in "rgba"])
    d = t.rgba8().filter("x < 7 and y < 6").join(after, ["image_id", "x", "y"])
    return d.select("image_id", "x", "y", *[(F.col(c) - F.col(f"{c}2")).alias(f"d{c}") for c in "rgba"])


for _codec, (_kind, _block, _dc, _ac, _al) in V.CODECS.items():
    _bits = lambda v, s: f"2.5 * log2(1 + pow({v} / ({s})::DOUBLE, 2) / 4)"
    _s = f"CASE WHEN u = 0 AND v = 0 THEN {_dc} ELSE {_ac} END"
    _sum = " + ".join([*[_bits(f"c{c}", _s) for c in "rgb"], _bits("ca", str(_al))])
    query(f"a24_codec_bits_{_codec}", "rgba8", f"{codec_sql(_codec)} SELECT image_id, count(*) FILTER (WHERE u = 0 AND v = 0) AS blocks, count(*) * 4 AS coefficients, round(sum({_sum}), 4) AS bits FROM tc GROUP BY 1")(
        lambda t, k=_codec: V.codec_bits(_observed(t), ["image_id"], k).withColumn("bits", F.round("bits", 4))
    )
    _sq = "(pow(cr, 2) + pow(cg, 2) + pow(cb, 2)) / 3"
    query(f"a24_codec_spread_{_codec}", "rgba8", f"{codec_sql(_codec)} SELECT image_id, round(sqrt(avg({_sq}) FILTER (WHERE u = 0 AND v = 0)), 6) AS dc_rms, round(sqrt(avg({_sq}) FILTER (WHERE u > 0 OR v > 0)), 6) AS ac_rms, round(sqrt(avg(ca * ca)), 6) AS alpha_rms FROM tc GROUP BY 1")(
        lambda t, k=_codec: V.codec_spread(_observed(t), ["image_id"], k).withColumns({c: F.round(c, 6) for c in ("dc_rms", "ac_rms", "alpha_rms")})
    )


# every raster beside the following one as its prediction, in blocks that do not divide the sides; every third has a region
LIKELIHOOD = V.LikelihoodConfig((0.1, 0.12, 0.14, 0.05), 3)
_res = lambda c: f"sign(a.p{c} - b.p{c}) * greatest(abs(a.p{c} - b.p{c}) - a.q{c}, 0) AS r{c}"
_iid = " + ".join(f"2.5 * log2(1 + pow(r{c} / {s}, 2) / 4)" for c, s in zip("rgba", LIKELIHOOD.sigma))
_lag = lambda d, k: f"sum({' + '.join(f'r{c} * {d}_r{c}' for c in 'rgba')}) AS d{k}, sum({' + '.join(f'r{c} * r{c}' for c in 'rgba')}) FILTER (WHERE {d}_ra IS NOT NULL) AS a{k}, sum({' + '.join(f'{d}_r{c} * {d}_r{c}' for c in 'rgba')}) AS f{k}"
_block = " + ".join(f"2.5 * log2(1 + e{c} / pow({s}, 2) / 4)" for c, s in zip("rgba", LIKELIHOOD.sigma))


@query(
    "a22_a23_raster_likelihood",
    "rgba8",
    f"""{obs_sql('rgba8')}, rz AS (SELECT a.image_id, a.x, a.y, {', '.join(_res(c) for c in 'rgba')} FROM ob a JOIN ob b ON b.image_id = a.image_id + 1 AND b.x = a.x AND b.y = a.y), {nb('rz', 'rn', ['rr', 'rg', 'rb', 'ra'], clamp=False)},
    bk AS (SELECT image_id, x // 3 * 3 AS bx, y // 3 * 3 AS by_, max(x) + 1 AS ex, max(y) + 1 AS ey, {', '.join(f'avg(r{c} * r{c}) AS e{c}' for c in 'rgba')} FROM rz GROUP BY 1, 2, 3),
    sb AS (SELECT image_id, coalesce(sum({_block}), 0) AS pixel_bits, count(*) AS blocks FROM bk WHERE image_id % 3 <> 0 OR (bx < 6 AND ex > 1 AND by_ < 3 AND ey > 0) GROUP BY 1),
    dg AS (SELECT image_id, sum({' + '.join(f'(r{c} = 0)::INT' for c in 'rgba')})::BIGINT AS deadzone, sum({_iid}) AS iid_bits, {_lag('e', 'x')}, {_lag('s', 'y')} FROM rn GROUP BY 1),
    lg AS (SELECT *, coalesce(dx / nullif(sqrt(ax * fx), 0), 0) AS lx, coalesce(dy / nullif(sqrt(ay * fy), 0), 0) AS ly FROM dg), ma AS (SELECT *, greatest(abs(lx), abs(ly)) AS m FROM lg)
    SELECT image_id, round(pixel_bits, 5) AS pixel_bits, round(pixel_bits + image_id % 7 + 3 + 0.5 * (image_id % 2) + 1.25 + 2, 5) AS total_bits, blocks, deadzone, round(iid_bits, 4) AS iid_bits, round(lx, 6) AS lag_x, round(ly, 6) AS lag_y, round(CASE WHEN m > 0 AND m < 1 THEN greatest(-1 / ln(m), 1) ELSE 1 END, 6) AS length_px FROM sb JOIN ma USING (image_id)""",
)
def a22b(t):
    i = F.col("image_id")
    seen = W.observed(t.rgba8())
    after = seen.select((i - 1).alias("image_id"), "x", "y", *[F.col(f"p{c}").alias(f"m{c}") for c in "rgba"])
    images = seen.select("image_id").distinct()
    bits = dict(zip(V.PRIORS, ((i % 7).cast("double"), F.lit(3.0), i % 2 * 0.5, F.lit(1.25), F.lit(2.0))))
    priors = images.select("image_id", *[e.alias(k) for k, e in bits.items()])
    rois = images.filter(i % 3 == 0).select("image_id", F.lit(2).alias("x0"), F.lit(1).alias("y0"), F.lit(5).alias("x1"), F.lit(2).alias("y1"), F.lit(1).alias("halo"))
    d = V.raster_likelihood(seen.join(after, ["image_id", "x", "y"]), LIKELIHOOD, priors, rois)
    digits = {"pixel_bits": 5, "total_bits": 5, "iid_bits": 4, "lag_x": 6, "lag_y": 6, "length_px": 6}
    return d.withColumns({k: F.round(k, n) for k, n in digits.items()})
