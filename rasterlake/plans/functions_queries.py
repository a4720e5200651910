"""Scalar expressions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions import codes, color, hashing, stats
from rasterlake.operators.geometry import signed_area
from rasterlake.operators.routing import catastrophic_kinds, route_decision
from rasterlake.registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


LIN = "CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def lin(v: str) -> str:
    return "(" + LIN.format(v=v) + ")"


ENC = "(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1.0::DOUBLE / 2.4) - 0.055 END)"


@query(
    "f01_srgb_transfer",
    "rgba8",
    f"""l AS (SELECT image_id, x, y, r, {lin('r')} AS lin_r, {lin('g')} AS lin_g FROM rgba8)
    SELECT image_id, x, y, round(lin_r, 6) AS lin_r, round(lin_g, 6) AS lin_g,
           round({ENC.format(v='lin_r')}, 6) AS enc_r,
           floor({ENC.format(v='lin_r')} * 255 + 0.5)::INT AS code_r FROM l""",
)
def f01(t):
    d = t.rgba8().withColumn("lr", color.code_to_linear(F.col("r"))).withColumn("lg", color.code_to_linear(F.col("g")))
    return d.select(
        "image_id", "x", "y", r6(F.col("lr"), "lin_r"), r6(F.col("lg"), "lin_g"),
        r6(color.linear_to_srgb(F.col("lr")), "enc_r"), color.linear_to_code(F.col("lr")).alias("code_r"),
    )


@query(
    "f02_premultiply",
    "rgba8",
    """p AS (SELECT image_id, x, y, a / 255.0::DOUBLE AS al, r / 255.0::DOUBLE * (a / 255.0::DOUBLE) AS pr FROM rgba8)
    SELECT image_id, x, y, round(pr, 6) AS pr, round(CASE WHEN al = 0 THEN NULL ELSE pr / al END, 6) AS straight_r FROM p""",
)
def f02(t):
    a = F.col("a") * color.CODE
    d = t.rgba8().withColumn("al", a).withColumn("pr", color.premultiplied(F.col("r") * color.CODE, F.col("al")))
    return d.select("image_id", "x", "y", r6(F.col("pr"), "pr"), r6(color.unpremultiplied(F.col("pr"), F.col("al")), "straight_r"))


def _obs_sql(blend: str) -> str:
    val = (lambda v: lin(f"({v})")) if blend == "linear_light" else (lambda v: f"(({v}) / 255.0::DOUBLE)")
    cols = []
    for c in "rgb":
        step = f"greatest(abs({val(c)} - {val(f'greatest({c} - 1, 0)')}), abs({val(f'least({c} + 1, 255)')} - {val(c)}))"
        cols.append(f"round({val(c)} * (a / 255.0::DOUBLE), 6) AS p{c}")
        cols.append(f"round(0.5 * {step} * (a / 255.0::DOUBLE) + {val(c)} * (0.5 / 255.0::DOUBLE), 6) AS q{c}")
    return f"SELECT image_id, x, y, '{blend}' AS blend, {', '.join(cols)}, round(a / 255.0::DOUBLE, 6) AS pa FROM rgba8"


@query("f03_observation", "rgba8", f"{_obs_sql('linear_light')} UNION ALL {_obs_sql('encoded_srgb')}")
def f03(t):
    def one(blend):
        obs = color.observation(*[F.col(c) for c in "rgba"], blend)
        return t.rgba8().select("image_id", "x", "y", F.lit(blend).alias("blend"), *[r6(c, n) for n, c in obs.items() if n != "qa"])

    return one("linear_light").unionByName(one("encoded_srgb"))


@query(
    "f04_alpha_class",
    "rgba8",
    """SELECT image_id, x, y, CASE WHEN a / 255.0 <= 0.5 / 255 THEN 'transparent'
       WHEN a / 255.0 >= 1 - 0.5 / 255 THEN 'opaque' ELSE 'partial' END AS alpha_class FROM rgba8""",
)
def f04(t):
    return t.rgba8().select("image_id", "x", "y", color.alpha_class(F.col("a") * color.CODE).alias("alpha_class"))


@query(
    "f05_premultiplied_delta",
    "rgba8",
    """SELECT p.image_id, p.x, p.y, round(abs(p.r * p.a / 255.0::DOUBLE - q.r * q.a / 255.0::DOUBLE), 6) AS dr,
       round(abs(p.g * p.a / 255.0::DOUBLE - q.g * q.a / 255.0::DOUBLE), 6) AS dg,
       round(abs(p.b * p.a / 255.0::DOUBLE - q.b * q.a / 255.0::DOUBLE), 6) AS db, abs(p.a - q.a) AS da
    FROM rgba8 p JOIN rgba8 q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y""",
)
def f05(t):
    a = t.rgba8()
    b = t.rgba8().select((F.col("image_id") - 1).alias("image_id"), "x", "y", *[F.col(c).alias(c + "2") for c in "rgba"])
    d = a.join(b, ["image_id", "x", "y"])
    delta = lambda c: r6(color.premultiplied_delta(F.col(c), F.col("a"), F.col(c + "2"), F.col("a2")), "d" + c)
    return d.select("image_id", "x", "y", delta("r"), delta("g"), delta("b"), F.abs(F.col("a") - F.col("a2")).alias("da"))


@query(
    "f06_vector_algebra",
    "rgba8",
    """v AS (SELECT p.image_id, p.x, p.y, p.r / 255.0::DOUBLE AS r1, p.g / 255.0::DOUBLE AS g1, p.b / 255.0::DOUBLE AS b1, p.a / 255.0::DOUBLE AS a1,
                  q.r / 255.0::DOUBLE AS r2, q.g / 255.0::DOUBLE AS g2, q.b / 255.0::DOUBLE AS b2, q.a / 255.0::DOUBLE AS a2
           FROM rgba8 p JOIN rgba8 q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y)
    SELECT image_id, x, y, round(r1 * r2 + g1 * g2 + b1 * b2 + a1 * a2, 6) AS dot,
           round(sqrt((r1-r2)*(r1-r2) + (g1-g2)*(g1-g2) + (b1-b2)*(b1-b2) + (a1-a2)*(a1-a2)), 6) AS dist,
           round(r2 + 0.3 * (r1 - r2), 6) AS mix_r, round(a2 + 0.3 * (a1 - a2), 6) AS mix_a FROM v""",
)
def f06(t):
    a = t.rgba8()
    b = t.rgba8().select((F.col("image_id") - 1).alias("image_id"), "x", "y", *[F.col(c).alias(c + "2") for c in "rgba"])
    d = a.join(b, ["image_id", "x", "y"])
    u, v = [F.col(c) * color.CODE for c in "rgba"], [F.col(c + "2") * color.CODE for c in "rgba"]
    mixed = color.vec_mix(v, u, F.lit(0.3))
    return d.select(
        "image_id", "x", "y", r6(color.vec_dot(u, v), "dot"), r6(color.vec_norm(color.vec_sub(u, v)), "dist"),
        r6(mixed[0], "mix_r"), r6(mixed[3], "mix_a"),
    )


@query(
    "f07_f08_f09_losses",
    "samples",
    """SELECT axis_line, distance_px, sigma_px, round(1 / (1 + pow(distance_px / 2.5, 2)), 6) AS soft,
       round(CASE WHEN abs(distance_px / 0.35) <= 1 THEN pow(distance_px / 0.35, 2) ELSE 2 * abs(distance_px / 0.35) - 1 END, 6) AS rho,
       round(2.5 * log2(1 + distance_px * distance_px / 4), 6) AS student_bits FROM samples""",
)
def f07(t):
    d = F.col("distance_px")
    return t.samples().select(
        "axis_line", "distance_px", "sigma_px", r6(color.soft(d, 2.5), "soft"), r6(codes.rho(d / 0.35), "rho"),
        r6(codes.student_bits(d * d, 4.0), "student_bits"),
    )


@query(
    "f10_residual_bits",
    "samples",
    f"""u AS (SELECT axis_line, distance_px, sigma_px, abs(distance_px / nullif(sigma_px, 0)) AS a FROM samples)
    SELECT axis_line, distance_px, sigma_px, CASE WHEN sigma_px <= 0 THEN NULL ELSE round(greatest(0.0,
      (CASE WHEN a <= 1 THEN a * a ELSE 2 * a - 1 END) / (2 * ln(2.0::DOUBLE))
      + log2(sigma_px * sqrt(2 * pi()) / {codes.COORDINATE_PRECISION_PX!r}::DOUBLE)), 6) END AS bits FROM u""",
)
def f10(t):
    bits = codes.residual_bits(F.col("distance_px"), F.nullif(F.col("sigma_px"), F.lit(0.0)))
    return t.samples().select(
        "axis_line", "distance_px", "sigma_px", F.round(F.when(F.col("sigma_px") > 0, bits), 6).alias("bits")
    )


@query(
    "f11_level_quantise",
    "px8s",
    """SELECT image_id, x, y, floor(alpha * 512 + 0.5)::INT AS level, floor(alpha * 512 + 0.5) / 512.0::DOUBLE AS value FROM px8s""",
)
def f11(t):
    q = codes.quantize_level(F.col("alpha"))
    return t.px8s().select("image_id", "x", "y", q.alias("level"), codes.dequantize_level(q).alias("value"))


@query(
    "f12_log2_binomial",
    "",
    """SELECT l_quantity::BIGINT AS n, l_linenumber::BIGINT * 3 AS k, count(*) AS rows,
       round(CASE WHEN l_linenumber * 3 > l_quantity THEN NULL ELSE
         (lgamma(l_quantity + 1) - lgamma(l_linenumber * 3 + 1.0) - lgamma(l_quantity - l_linenumber * 3 + 1)) / ln(2.0::DOUBLE) END, 6) + 0.0 AS bits,
       round(log2(l_quantity + 1), 6) AS gap_bits
    FROM lineitem GROUP BY l_quantity, l_linenumber""",
)
def f12(t):
    d = t.table("lineitem").groupBy(
        F.rint("l_quantity").cast("bigint").alias("n"), (F.col("l_linenumber").cast("bigint") * 3).alias("k")
    ).agg(F.count("*").alias("rows"))
    bits = F.when(F.col("k") <= F.col("n"), codes.log2_binomial("n", "k"))
    return d.select("n", "k", "rows", r6(bits, "bits"), r6(codes.gap_bits(F.col("n") + 2), "gap_bits"))


@query(
    "f13_normal_quantile",
    "",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, level, CASE level WHEN 0.5 THEN 0.674489750196082::DOUBLE
       WHEN 0.9 THEN 1.644853626951472::DOUBLE WHEN 0.95 THEN 1.959963984540054::DOUBLE WHEN 0.99 THEN 2.575829303548901::DOUBLE END AS z
    FROM (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 WHEN 2 THEN 0.95 WHEN 3 THEN 0.99 ELSE 0.8 END::DOUBLE AS level FROM lineitem)""",
)
def f13(t):
    k = F.col("l_linenumber") % 5
    level = F.when(k == 0, 0.5).when(k == 1, 0.9).when(k == 2, 0.95).when(k == 3, 0.99).otherwise(0.8)
    d = t.table("lineitem").withColumn("level", level)
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "level", codes.z_for_coverage(F.col("level")).alias("z"))


# bisection of the exact binomial tail, for any CTE ``trials(id, k, n)``
def cp_sql(confidence: float) -> str:
    return f"""
    cp_step(id, k, n, lo, hi, i) AS (
      SELECT id, k, n, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM trials WHERE n > 0 AND k < n
      UNION ALL
      SELECT id, k, n, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, i + 1
      FROM (SELECT id, k, n, lo, hi, i, mid,
              list_sum(list_transform(range(0, k::BIGINT + 1), lambda j:
                exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(mid) + (n - j) * ln(1 - mid))))
                > 1 - {confidence}::DOUBLE AS below
            FROM (SELECT *, (lo + hi) / 2 AS mid FROM cp_step WHERE i < 52))),
    cp AS (
      SELECT t.id, t.k, t.n, coalesce((s.lo + s.hi) / 2, 1.0) AS upper
      FROM trials t LEFT JOIN (SELECT * FROM cp_step WHERE i = 52) s ON s.id IS NOT DISTINCT FROM t.id)"""


@query(
    "f14_incomplete_beta",
    "",
    """SELECT l_quantity::BIGINT AS n, l_linenumber::BIGINT AS k, count(*) AS rows, round(lgamma(l_quantity + 0.5), 6) AS ln_gamma,
       round(list_sum(list_transform(range(l_linenumber::BIGINT, (l_linenumber + l_quantity)::BIGINT), lambda j:
         exp(lgamma(l_linenumber + l_quantity) - lgamma(j + 1.0) - lgamma(l_linenumber + l_quantity - j)
             + j * ln(0.137::DOUBLE) + (l_linenumber + l_quantity - 1 - j) * ln(0.863::DOUBLE)))), 6) AS beta_value
    FROM lineitem GROUP BY l_quantity, l_linenumber""",
)
def f14(t):
    d = t.table("lineitem").groupBy(
        F.rint("l_quantity").cast("bigint").alias("n"), F.col("l_linenumber").cast("bigint").alias("k")
    ).agg(F.count("*").alias("rows"))
    return d.select(
        "n", "k", "rows", r6(stats.log_gamma_column(F.col("n") + 0.5), "ln_gamma"),
        r6(stats.incomplete_beta_column(F.col("k"), F.col("n"), F.lit(0.137)), "beta_value"),
    )


@query(
    "f15_clopper_pearson",
    "meas",
    f"""RECURSIVE trials AS (SELECT family || '/' || size_px AS id, count(*) FILTER (WHERE catastrophic AND accepted) AS k,
          count(*) FILTER (WHERE accepted) AS n FROM meas GROUP BY 1), {cp_sql(0.99)}
    SELECT id, k, n, round(upper, 6) AS upper FROM cp""",
)
def f15(t):
    d = t.meas().groupBy(F.concat_ws("/", "family", "size_px").alias("id")).agg(
        F.count_if(F.col("catastrophic") & F.col("accepted")).alias("k"), F.count_if("accepted").alias("n")
    )
    return d.select("id", "k", "n", r6(stats.clopper_pearson_upper(F.col("k"), F.col("n"), 0.99), "upper"))


@query(
    "f16_required_groups",
    "meas",
    """SELECT family, cell_id, count(*) AS rows, ceil(ln(0.01::DOUBLE) / ln(1 - 0.01 * cell_id::DOUBLE))::BIGINT AS required
    FROM meas GROUP BY family, cell_id""",
)
def f16(t):
    d = t.meas().groupBy("family", "cell_id").agg(F.count("*").alias("rows"))
    return d.select("family", "cell_id", "rows", stats.required_groups(F.lit(0.99), F.col("cell_id") * 0.01).alias("required"))


@query(
    "f17_binomial_tail",
    "meas",
    """w AS (SELECT group_id % 50 AS bucket, count(*) FILTER (WHERE accepted) AS wins, count(*) AS trials FROM meas GROUP BY 1)
    SELECT bucket, wins, trials, round(least(1.0, list_sum(list_transform(range(wins, trials + 1), lambda j:
      exp(lgamma(trials + 1.0) - lgamma(j + 1.0) - lgamma(trials - j + 1.0) - trials * ln(2.0::DOUBLE))))), 6) AS p_value FROM w""",
)
def f17(t):
    d = t.meas().groupBy((F.col("group_id") % 50).alias("bucket")).agg(F.count_if("accepted").alias("wins"), F.count("*").alias("trials"))
    return d.select("bucket", "wins", "trials", r6(stats.binomial_tail_half(F.col("wins"), F.col("trials")), "p_value"))


@query(
    "f18_entropy_bound",
    "meas",
    """e AS (SELECT group_id, cell_id, p95_px, p95_px / 0.3 AS top, 1 + quantity % 6 AS classes FROM meas)
    SELECT group_id, cell_id, round(top, 6) AS top, classes, round(CASE WHEN top < 0 OR top > 1 THEN NULL WHEN classes = 1 THEN 0.0
      WHEN top <= 1.0 / classes THEN log2(classes::DOUBLE) WHEN 1 - top <= 0 THEN 0.0
      ELSE -top * log2(top) - (1 - top) * log2(1 - top) + (1 - top) * log2(classes - 1.0::DOUBLE) END, 6) AS entropy FROM e""",
)
def f18(t):
    d = t.meas().select("group_id", "cell_id", (F.col("p95_px") / 0.3).alias("top_"), (F.col("quantity") % 6 + 1).alias("classes"))
    return d.select("group_id", "cell_id", r6(F.col("top_"), "top"), "classes", r6(codes.finite_entropy_bound(F.col("top_"), F.col("classes")), "entropy"))


@query(
    "f19_fnv_bucket",
    "",
    """h AS (SELECT c_custkey, c_name, list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::UHUGEINT),
        lambda acc, b: (xor(acc, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS v FROM customer)
    SELECT c_custkey, v::VARCHAR AS hash, (v % 100)::INT AS bucket FROM h""",
)
def f19(t):
    h = hashing.fnv1a64(F.col("c_name"))
    return t.table("customer").select("c_custkey", h.cast("string").alias("hash"), (h % 100).cast("int").alias("bucket"))


@query(
    "f20_sha_bucket",
    "",
    """SELECT o_orderkey, (('0x' || substr(sha256('source-shard/v1/' || o_orderkey), 1, 16))::UBIGINT % 8)::INT AS shard FROM orders""",
)
def f20(t):
    return t.table("orders").select("o_orderkey", hashing.sha_bucket(F.concat(F.lit("source-shard/v1/"), "o_orderkey"), 8).alias("shard"))


@query(
    "f21_key_fingerprint",
    "",
    """SELECT p_partkey, sha256('brand=' || p_brand || chr(31) || 'type=' || p_type || chr(31) || 'size=' || p_size) AS fingerprint FROM part""",
)
def f21(t):
    parts = {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")}
    return t.table("part").select("p_partkey", hashing.key_fingerprint(parts).alias("fingerprint"))


@query(
    "f22_f23_rounding_and_growth",
    "meas",
    """SELECT group_id, cell_id, palette_delta, channel_delta, round(CASE WHEN p95_px = 0 THEN 0 ELSE ceil(p95_px / 0.0025) * 0.0025 END, 6) AS step_up,
       least(ceil(quantity / 8.0) * 8, 128)::BIGINT AS code_up, least(palette_delta + 1, 8) AS next_code,
       CASE WHEN palette_delta = 0 AND channel_delta = 0 THEN 1.0 WHEN channel_delta = 0 THEN 1.7976931348623157e308
            ELSE round(palette_delta / channel_delta::DOUBLE, 6) END AS growth FROM meas""",
)
def f22(t):
    growth = codes.growth_ratio(F.col("palette_delta"), F.col("channel_delta"))
    return t.meas().select(
        "group_id", "cell_id", "palette_delta", "channel_delta",
        r6(codes.ceil_to_step(F.col("p95_px"), 0.0025), "step_up"),
        codes.ceil_code(F.col("quantity"), 8, 128).alias("code_up"), codes.next_code(F.col("palette_delta"), 8).alias("next_code"),
        F.when(growth > 1e300, growth).otherwise(F.round(growth, 6)).alias("growth"),
    )


@query(
    "f26_position_uncertainty",
    "samples",
    """s AS (SELECT axis_line, distance_px, sigma_px, bias_px, sqrt(pow(0.5 / 255, 2) / 3 + bias_px * bias_px + pow(2.0 / 255, 2))
               / greatest(abs(sigma_px), 1e-9) AS sp, abs(distance_px) / (8 * greatest(abs(sigma_px), 1e-9)) AS bi FROM samples)
    SELECT axis_line, distance_px, sigma_px, round(sp, 6) AS sigma_pos, round(bi, 6) AS bias,
      round(least(1.959963984540054 * sp + bi, 4), 6) AS halfwidth, 1.959963984540054 * sp + bi > 4 AS capped,
      round(least(1.0, greatest(0.0, 1 - (sp + bi) / 4)), 6) AS confidence FROM s""",
)
def f26(t):
    u = codes.position_uncertainty(
        F.lit(0.5 / 255), F.col("bias_px"), F.lit(2.0 / 255), F.col("sigma_px"), F.col("distance_px"), F.lit(codes.Z_TABLE[0.95])
    )
    return t.samples().select(
        "axis_line", "distance_px", "sigma_px", *[r6(u[n], n) for n in ("sigma_pos", "bias", "halfwidth", "confidence")], u["capped"].alias("capped")
    )


@query(
    "f27_route_decision",
    "",
    """facts AS (SELECT doc_id, source, quality_modes AS palette_modes, share AS dominant_share, chains, supported, foreground, width, opaque, margin
       FROM (SELECT doc_id, source, (n_chars % 6)::BIGINT AS quality_modes, (50 + n_chars % 51) / 100.0::DOUBLE AS share, (n_chars % 12)::BIGINT AS chains,
             doc_id % 3 = 0 AS supported, (n_chars % 97) / 97.0::DOUBLE AS foreground, (n_chars % 13)::DOUBLE AS width,
             doc_id % 2 = 0 AS opaque, ((n_chars % 9) - 4)::DOUBLE AS margin FROM documents))
    SELECT doc_id, CASE WHEN supported AND chains <= 8 AND foreground <= 0.40 AND width <= 5.12 THEN 'line_art'
        WHEN supported AND chains <= 8 THEN 'two_colour' WHEN palette_modes >= 3 AND dominant_share >= 0.85 THEN 'multi_region'
        WHEN opaque AND dominant_share < 0.85 AND margin > 0 THEN 'gradient'
        WHEN foreground <= 0.40 AND width <= 5.12 THEN 'line_art' WHEN palette_modes > 0 THEN 'multi_region' ELSE 'none' END AS lane,
      CASE WHEN supported AND chains <= 8 AND foreground <= 0.40 AND width <= 5.12 THEN 'thin strokes outrank two-colour evidence'
        WHEN supported AND chains <= 8 THEN 'supported two-colour evidence'
        WHEN palette_modes >= 3 AND dominant_share >= 0.85 THEN 'concentrated palette'
        WHEN opaque AND dominant_share < 0.85 AND margin > 0 THEN 'smooth gradient'
        WHEN foreground <= 0.40 AND width <= 5.12 THEN 'thin strokes' WHEN palette_modes > 0 THEN 'regions after other refusals' ELSE 'no lane' END AS reason,
      ((supported AND chains > 8)::INT + (NOT supported)::INT)::BIGINT AS two_colour_refusals FROM facts""",
)
def f27(t):
    n = F.col("n_chars")
    facts = t.table("documents").select(
        "doc_id", (n % 6).alias("palette_modes"), ((n % 51 + 50) / 100.0).alias("dominant_share"), (n % 12).alias("chains"),
        (F.col("doc_id") % 3 == 0).alias("supported"), (n % 97 / 97.0).alias("foreground_share"),
        (n % 13).cast("double").alias("median_width_px"), (F.col("doc_id") % 2 == 0).alias("opaque"),
        (n % 9 - 4).cast("double").alias("gradient_margin_bits"), F.lit(64).alias("width"), F.lit(64).alias("height"),
    )
    d = route_decision(facts)
    refused = F.size(F.filter("observations", lambda o: (o["lane"] == "two_colour") & ~o["accepted"] & ~o["detail"].startswith("thin")))
    return d.select("doc_id", "lane", "reason", refused.cast("bigint").alias("two_colour_refusals"))


@query(
    "f28_catastrophic_kinds",
    "meas",
    """SELECT group_id, scene_id, cell_id, quantity, CASE WHEN NOT accepted THEN '' ELSE concat_ws(',',
       CASE WHEN class = '1-URGENT' THEN 'wrong_visible_topology' END, CASE WHEN catastrophic THEN 'verification_failure' END,
       CASE WHEN reason IS NULL OR channel_delta > 6 THEN 'serialized_mismatch' END,
       CASE WHEN palette_delta > 8 THEN 'wrong_paint_or_missing_face' END) END AS kinds FROM meas""",
)
def f28(t):
    d = t.meas().withColumn("delta", F.when(F.col("reason").isNotNull(), F.col("channel_delta")))
    kinds = catastrophic_kinds(
        available=F.col("accepted"), topology_exact=F.col("class") != "1-URGENT", verified=~F.col("catastrophic"),
        delivery=[(F.col("delta"), F.lit(6))], palette=(F.col("palette_delta"), F.lit(8)),
    )
    return d.select("group_id", "scene_id", "cell_id", "quantity", F.concat_ws(",", kinds).alias("kinds"))


@query(
    "f29_signed_area",
    "segments",
    """SELECT s.chain_id, round(0.5 * (sum(x1 * y2 - x2 * y1) + max(e.px * f.py - f.px * e.py)), 4) AS area FROM segments s
    JOIN (SELECT chain_id, arg_max(px, k) AS px, arg_max(py, k) AS py FROM chain GROUP BY 1) e USING (chain_id)
    JOIN (SELECT chain_id, arg_min(px, k) AS px, arg_min(py, k) AS py FROM chain GROUP BY 1) f USING (chain_id)
    GROUP BY s.chain_id""",
)
def f29(t):
    return signed_area(t.chain(), ["chain_id"], "k").select("chain_id", F.round("area", 4).alias("area"))


@query(
    "f30_effective_lower_bound",
    "meas",
    """m AS (SELECT group_id, scene_id, cell_id, quantity, accepted, p95_px AS given, bits_per_block AS sel, price / 1000 AS expl,
        (SELECT max(quantity) FROM meas)::DOUBLE AS up, 1 + quantity % 4 AS classes FROM meas), b AS (
      SELECT *, CASE WHEN accepted THEN given WHEN sel >= 0 AND expl + up > 0 THEN sel / (expl + up) END AS lb,
        least(1.0, greatest(0.0, sel / (expl + up))) AS top FROM m)
    SELECT group_id, scene_id, cell_id, quantity, round(lb, 6) AS lower_bound, round(CASE WHEN classes = 1 THEN 0.0 WHEN top <= 1.0 / classes THEN log2(classes::DOUBLE)
      WHEN top >= 1 THEN 0.0 ELSE -top * log2(top) - (1 - top) * log2(1 - top) + (1 - top) * log2(classes - 1.0::DOUBLE) END, 6) AS entropy_bound FROM b""",
)
def f30(t):
    m = t.meas()
    upper = F.broadcast(m.agg(F.max("quantity").cast("double").alias("up")))  # one row
    d = m.crossJoin(upper)
    explored = F.col("price") / 1000
    top = color.clamp(F.col("bits_per_block") / (explored + F.col("up")))
    lb = codes.lower_bound_mass(~F.col("accepted"), F.col("p95_px"), F.col("bits_per_block"), explored, F.col("up"))
    return d.select(
        "group_id", "scene_id", "cell_id", "quantity", r6(lb, "lower_bound"),
        r6(codes.finite_entropy_bound(top, F.col("quantity") % 4 + 1), "entropy_bound"),
    )


@query(
    "f31_paint_observation",
    "rgba8",
    f"""l AS (SELECT image_id, x, y, a, {lin('r')} AS lr, {lin('g')} AS lg FROM rgba8)
    SELECT image_id, x, y, round(CASE WHEN a >= 255 THEN lr ELSE 0 END, 6) AS linear_r, round(CASE WHEN a >= 255 THEN {ENC.format(v='lg')} ELSE 0 END, 6) AS encoded_g,
      CASE WHEN a >= 255 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS alpha FROM l""",
)
def f31(t):
    lin_ = [color.code_to_linear(F.col(c)) for c in "rgb"]
    opaque = F.col("a") >= 255
    a, b = color.paint_observation(lin_, opaque, "linear_light"), color.paint_observation(lin_, opaque, "encoded_srgb")
    return t.rgba8().select("image_id", "x", "y", r6(a[0], "linear_r"), r6(b[1], "encoded_g"), a[3].alias("alpha"))


@query(
    "f32_geometry_bits",
    "meas",
    """fam AS (SELECT group_id, scene_id, cell_id, quantity, size_px, ['line','circular_arc','quadratic_bezier','cubic_bezier'][1 + l_partkey % 4] AS curve, l_partkey % 4 AS c FROM meas),
    a AS (SELECT *, greatest(31.029146 + 2 * log2(size_px / 16384.0::DOUBLE), 0) AS anchor FROM fam)
    SELECT group_id, scene_id, cell_id, quantity, curve, round(anchor, 6) AS anchor_bits, round(anchor / 2, 6) AS coordinate_bits,
      round(2.321928 + [0, 1, 2, 4][1 + c] * anchor / 2 + CASE WHEN c = 1 THEN 2 ELSE 0 END, 6) AS segment_bits FROM a""",
)
def f32(t):
    names = F.array(*[F.lit(n) for n in codes.FAMILY_PARAMETERS])
    d = t.meas().withColumn("curve", F.element_at(names, (F.col("l_partkey") % 4 + 1).cast("int")))
    s = F.col("size_px").cast("double")
    return d.select(
        "group_id", "scene_id", "cell_id", "quantity", "curve", r6(codes.anchor_bits(s), "anchor_bits"),
        r6(codes.coordinate_bits(s), "coordinate_bits"), r6(codes.segment_bits(F.col("curve"), s), "segment_bits"),
    )
