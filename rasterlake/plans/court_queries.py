"""Strata, tails, calibration, paired and blind comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import courts as C
from rasterlake.operators.digests import digest_sql, ordered_digest
from rasterlake.plans.functions_queries import r6
from rasterlake.registry import query
from rasterlake.sources.config import GATES, load_gates

AXES = ["family", "size_px", "profile", "group_id"]
AXIS_SQL = "long AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a}::VARCHAR AS value, * FROM meas" for a in AXES) + ")"


def map_sql(label: str) -> str:
    return f"""SELECT axis, value, string_agg(lab || '=' || n, ';' ORDER BY lab) AS txt FROM
      (SELECT axis, value, {label} AS lab, count(*) AS n FROM long WHERE NOT accepted GROUP BY ALL) GROUP BY axis, value"""


@query(
    "a37_stratified_summary",
    "meas",
    f"""{AXIS_SQL}, st AS ({map_sql('status')}), rs AS ({map_sql("coalesce(reason, 'unclassified')")}),
    m AS (SELECT axis, value, count(*) AS renders, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted AND catastrophic) AS catastrophic,
       min(p99_px) AS lo, max(p99_px) AS hi, max(bits_per_block) AS worst FROM long GROUP BY axis, value),
    w AS (SELECT l.axis, l.value, max(l.p95_px) AS at FROM long l JOIN m ON m.axis = l.axis AND m.value = l.value AND m.worst = l.bits_per_block GROUP BY ALL)
    SELECT axis, value, renders, accepted, catastrophic, round(lo, 6) AS conditioning_min, round(hi, 6) AS conditioning_max, round(worst, 6) AS worst_bits,
      round(w.at, 6) AS worst_at_p95_px, coalesce(st.txt, '') AS refusal_statuses, coalesce(rs.txt, '') AS refusal_reasons
    FROM m JOIN w USING (axis, value) LEFT JOIN st USING (axis, value) LEFT JOIN rs USING (axis, value)""",
)
def a37(t):
    d = C.stratified_summary(t.meas(), AXES)
    return d.select(
        "axis", "value", "renders", "accepted", "catastrophic",
        *[r6(F.col(c), c) for c in ("conditioning_min", "conditioning_max", "worst_bits", "worst_at_p95_px")],
        C.map_text("refusal_statuses").alias("refusal_statuses"), C.map_text("refusal_reasons").alias("refusal_reasons"),
    )


@query(
    "a37_cost_histogram",
    "meas",
    """e AS (SELECT family, unnest([{'f': profile, 'r': 'slow', 'c': quantity % 3}, {'f': profile, 'r': 'flat', 'c': quantity % 5}]) AS e FROM meas)
    SELECT family, e.f || '/' || e.r AS cost, sum(e.c)::BIGINT AS count FROM e GROUP BY ALL""",
)
def a37b(t):
    entry = lambda r, m: F.struct(F.col("profile").alias("family"), F.lit(r).alias("reason"), (F.col("quantity") % m).alias("count"))
    d = t.meas().withColumn("refusals", F.array(entry("slow", 3), entry("flat", 5)))
    return C.cost_histogram(d, ["family"], "refusals")


AT = "floor(samples * least(1.0, {g} / greatest(max_px, 1e-9)))::BIGINT"


def with_gate_counts(d):
    at = lambda g: F.floor(F.col("samples") * F.least(F.lit(1.0), F.lit(g) / F.greatest(F.col("max_px"), F.lit(1e-9))))
    return d.withColumn("at95", at(0.25)).withColumn("at99", at(0.30))


@query(
    "a38_population_tail",
    "meas",
    f"""r AS (SELECT *, {AT.format(g=0.25)} AS at95, {AT.format(g=0.30)} AS at99, row_number() OVER (PARTITION BY family, profile ORDER BY p95_px) - 1 AS i95,
        row_number() OVER (PARTITION BY family, profile ORDER BY p99_px) - 1 AS i99, count(*) OVER (PARTITION BY family, profile) AS n
      FROM (SELECT * EXCLUDE (samples, at95, at99), CASE WHEN family = 'MACHINERY' AND l_partkey = 3 THEN 0 ELSE samples END AS samples FROM meas)),
    s AS (SELECT family, profile, bool_and(samples > 0 AND at95 <= samples AND at99 <= samples) AS complete, sum(samples)::BIGINT AS pooled, sum(at95) AS a95, sum(at99) AS a99,
      max(max_px) AS mx, max(CASE WHEN i95 = ceil((n - 1) * 0.95) THEN p95_px END) AS q95, max(CASE WHEN i99 = ceil((n - 1) * 0.99) THEN p99_px END) AS q99 FROM r GROUP BY ALL)
    SELECT family, profile, complete, CASE WHEN complete THEN pooled END AS pooled_samples, CASE WHEN complete THEN round(mx, 6) END AS max_px,
      CASE WHEN complete THEN round(q95, 6) END AS render_p95_q95_px, CASE WHEN complete THEN round(q99, 6) END AS render_p99_q99_px,
      CASE WHEN complete THEN a95 >= ceil((pooled - 1) * 0.95) + 1 END AS p95_gate_met, CASE WHEN complete THEN a99 >= ceil((pooled - 1) * 0.99) + 1 END AS p99_gate_met,
      CASE WHEN complete THEN mx <= 0.45 END AS max_gate_met FROM s""",
)
def a38(t):
    gap = (F.col("family") == "MACHINERY") & (F.col("l_partkey") == 3)
    rows = with_gate_counts(t.meas().withColumn("samples", F.when(gap, 0).otherwise(F.col("samples"))))
    d = C.population_tail(rows, ["family", "profile"], C.TailGates(0.25, 0.30, 0.45))
    px = ("max_px", "render_p95_q95_px", "render_p99_q99_px")
    return d.select("family", "profile", "complete", "pooled_samples", *[r6(F.col(c), c) for c in px], "p95_gate_met", "p99_gate_met", "max_gate_met")


CLASS = "profile || '/' || quantity || '/' || size_px || '/' || family"


def classed(d):
    return d.withColumn("class", F.concat_ws("/", "profile", "quantity", "size_px", "family"))


CLASSED_SQL = f"m AS (SELECT * EXCLUDE class, {CLASS} AS class FROM meas1)"
CAL_SQL = f"""{CLASSED_SQL}, cal AS (SELECT class, count(*) FILTER (WHERE NOT catastrophic) AS clean, count(*) FILTER (WHERE catastrophic) AS bad,
    max(bits_per_block) FILTER (WHERE NOT catastrophic) AS mx FROM m WHERE accepted GROUP BY class),
  st AS (SELECT *, CASE WHEN bad > 0 THEN 'excluded' WHEN clean >= 2 THEN 'calibrated' ELSE 'too_few' END AS state FROM cal),
  adm AS (SELECT m.*, m.accepted AND st.state IS NOT NULL AND st.state = 'calibrated' AS admitted FROM m LEFT JOIN st USING (class))"""


@query(
    "a39_supported_classes",
    "meas",
    "SELECT class || '/' || (group_id % 400) AS class, count(DISTINCT group_id) AS source_groups FROM meas WHERE accepted GROUP BY 1 HAVING count(DISTINCT group_id) >= 2",
)
def a39(t):
    d = t.meas().filter("accepted").withColumn("class", F.concat_ws("/", "class", F.col("group_id") % 400))
    return C.supported_classes(d)


@query("a40_class_calibration", "meas1", f"{CAL_SQL} SELECT class, clean, bad AS catastrophic, round(mx, 6) AS maximum_bits_per_block, state FROM st")
def a40(t):
    d = C.class_calibration(classed(t.meas1()))
    return d.select("class", "clean", "catastrophic", r6(F.col("maximum_bits_per_block"), "maximum_bits_per_block"), "state")


@query(
    "a41_origin_summary",
    "meas1",
    f"""{CAL_SQL}, o AS (SELECT status AS origin, count(*) AS groups_total, count(*) FILTER (WHERE accepted) AS pipeline_accepted, count(*) FILTER (WHERE admitted) AS admitted,
       count(*) FILTER (WHERE admitted AND catastrophic) AS catastrophic FROM adm GROUP BY status)
    SELECT origin, groups_total, pipeline_accepted, admitted, catastrophic, round(admitted / groups_total::DOUBLE, 6) AS coverage, round(v, 6) AS source_coverage,
      (SELECT min(admitted / groups_total::DOUBLE) FROM o) >= 0.5 AND (SELECT list_sort(list(origin)) FROM o) = ['F', 'O', 'P'] AS every_origin_met, v >= 0.8 AS total_met
      FROM o CROSS JOIN (SELECT count(DISTINCT CASE WHEN admitted THEN group_id END) / count(DISTINCT group_id)::DOUBLE AS v FROM adm)""",
)
def a41(t):
    m = classed(t.meas1())
    d = C.origin_summary(C.admitted(m, C.class_calibration(m)), "status", ["F", "O", "P"])
    return d.withColumns({c: F.round(c, 6) for c in ("coverage", "source_coverage")})


@query(
    "a42_derived_gates",
    "meas1",
    f"""{CAL_SQL}, c AS (SELECT * FROM adm WHERE admitted AND NOT catastrophic), r AS (SELECT runtime_ms, row_number() OVER (ORDER BY runtime_ms) - 1 AS i, count(*) OVER () AS n FROM c)
    SELECT round(ceil(max(p95_px) / 0.25) * 0.25, 6) AS p95_px, round(ceil(max(p99_px) / 0.25) * 0.25, 6) AS p99_px, round(ceil(max(max_px) / 0.25) * 0.25, 6) AS max_px,
      max(palette_delta) AS paint_delta_codes, least(ceil(max(channel_delta) / 8.0) * 8, 248)::BIGINT AS internal_max_channel_delta,
      round(ceil(max(bits_per_block) / (1 / 256.0)) / 256, 6) AS internal_mean_delta, (SELECT max(runtime_ms) FROM r WHERE i = ceil((n - 1) * 0.95))::DOUBLE AS runtime_p95_ms FROM c""",
)
def a42(t):
    m = classed(t.meas1())
    d = C.derive_gates(C.admitted(m, C.class_calibration(m)))
    px = ("p95_px", "p99_px", "max_px", "internal_mean_delta")
    return d.select(*[r6(F.col(c), c) for c in px], "paint_delta_codes", "internal_max_channel_delta", "runtime_p95_ms")


@query("a74_admission", "meas1", f"{CAL_SQL} SELECT group_id, scene_id, cell_id, accepted, admitted FROM adm")
def a74(t):
    m = classed(t.meas1())
    return C.admitted(m, C.class_calibration(m)).select("group_id", "scene_id", "cell_id", "accepted", "admitted")


@query(
    "j15_supported_semi_join",
    "meas1",
    f"{CAL_SQL} SELECT group_id, scene_id, cell_id, class FROM m WHERE class IN (SELECT class FROM st WHERE state = 'calibrated')",
)
def j15(t):
    m = classed(t.meas1())
    ok = C.class_calibration(m).filter("state = 'calibrated'")
    return m.join(ok, "class", "left_semi").select("group_id", "scene_id", "cell_id", "class")


@query(
    "a43_delivery_calibration",
    "meas",
    """d AS (SELECT family, size_px, channel_delta AS pm, p95_px / (CASE WHEN family = 'BUILDING' THEN 20 ELSE 40 END) AS pa, least(quantity * 2, 200) AS ip, quantity AS is_, p99_px AS ap, bits_per_block / 100 AS aseam FROM meas),
    o AS (SELECT family, size_px, count(*) AS candidate_rows, max(pm) AS a, max(pa) AS b, max(greatest(ip, is_)) AS c, max(greatest(ap, aseam)) AS e FROM d GROUP BY ALL),
    r AS (SELECT *, CASE WHEN a > 8 OR b > 0.01 OR c > 128 OR e > 2.0 THEN 'exceeds_safety_envelope' END AS refusal FROM o)
    SELECT family, size_px, candidate_rows, a AS o_profile_max, round(b, 6) AS o_profile_mean, c AS o_internal_max, round(e, 6) AS o_internal_mean, refusal,
      CASE WHEN refusal IS NULL THEN least(a + 1, 8) END AS gate_profile_max, CASE WHEN refusal IS NULL THEN round(least(CASE WHEN b = 0 THEN 0 ELSE ceil(b / 0.0025) * 0.0025 END, 0.01), 6) END AS gate_profile_mean,
      CASE WHEN refusal IS NULL THEN least(ceil(c / 8.0) * 8, 128)::BIGINT END AS gate_internal_max, CASE WHEN refusal IS NULL THEN round(least(CASE WHEN e = 0 THEN 0 ELSE ceil(e / 0.25) * 0.25 END, 2.0), 6) END AS gate_internal_mean FROM r""",
)
def a43(t):
    d = t.meas().select(
        "family", "size_px", F.col("channel_delta").alias("profile_max"),
        (F.col("p95_px") / F.when(F.col("family") == "BUILDING", 20).otherwise(40)).alias("profile_mean"),
        F.least(F.col("quantity") * 2, F.lit(200)).alias("internal_max_pure"), F.col("quantity").alias("internal_max_seam"),
        F.col("p99_px").alias("internal_mean_pure"), (F.col("bits_per_block") / 100).alias("internal_mean_seam"),
    )
    d = C.delivery_calibration(d, ["family", "size_px"])
    real = ("o_profile_mean", "o_internal_mean", "gate_profile_mean", "gate_internal_mean")
    keep = ["family", "size_px", "candidate_rows", "o_profile_max", "o_internal_max", "refusal", "gate_profile_max", "gate_internal_max"]
    return d.select(*keep, *[r6(F.col(c), c) for c in real])


# ---- paired comparison ------------------------------------------------------
BASE_SQL = """sel AS (SELECT *, quantity AS segments, runtime_ms AS bytes FROM meas1 WHERE accepted),
  base AS (SELECT group_id, scene_id, cell_id, CASE WHEN ok THEN p95_px * 0.9 + 0.02 * (quantity % 3) END AS b_p95_px, CASE WHEN ok THEN p99_px * 0.9 + 0.02 * (quantity % 3) END AS b_p99_px,
     CASE WHEN ok THEN max_px * 1.1 END AS b_max_px, CASE WHEN ok THEN palette_delta + quantity % 2 END AS b_palette_delta, CASE WHEN ok THEN quantity + cell_id % 4 - 1 END AS b_segments,
     CASE WHEN ok THEN runtime_ms + 10 END AS b_bytes, CASE WHEN refused THEN 'unsupported_shape' END AS b_refusal
   FROM (SELECT *, cell_id % 3 <> 0 AS ok, cell_id % 3 = 0 AND quantity % 9 <> 0 OR quantity % 23 = 0 AS refused FROM meas1)),
  pr AS (SELECT sel.*, base.* EXCLUDE (group_id, scene_id, cell_id), CASE WHEN b_p95_px IS NOT NULL AND b_refusal IS NOT NULL THEN 'contradictory'
     WHEN b_p95_px IS NOT NULL THEN 'measured' WHEN b_refusal IS NOT NULL THEN 'refused' ELSE 'missing' END AS pairing FROM sel LEFT JOIN base USING (group_id, scene_id, cell_id))"""


def pairs(t):
    sel = t.meas1().filter("accepted").withColumns({"segments": F.col("quantity"), "bytes": F.col("runtime_ms")})
    ok = F.col("cell_id") % 3 != 0
    refused = ((F.col("cell_id") % 3 == 0) & (F.col("quantity") % 9 != 0)) | (F.col("quantity") % 23 == 0)
    q = F.col("quantity")
    base = t.meas1().select(
        *C.KEY,
        F.when(ok, F.col("p95_px") * 0.9 + (q % 3) * 0.02).alias("b_p95_px"),
        F.when(ok, F.col("p99_px") * 0.9 + (q % 3) * 0.02).alias("b_p99_px"),
        F.when(ok, F.col("max_px") * 1.1).alias("b_max_px"),
        F.when(ok, F.col("palette_delta") + q % 2).alias("b_palette_delta"),
        F.when(ok, q + F.col("cell_id") % 4 - 1).alias("b_segments"),
        F.when(ok, F.col("runtime_ms") + 10).alias("b_bytes"),
        F.when(refused, "unsupported_shape").alias("b_refusal"),
    )
    return C.paired(sel, base)


@query("j10_paired_join", "meas1", f"{BASE_SQL} SELECT group_id, scene_id, cell_id, round(p95_px, 6) AS p95_px, round(b_p95_px, 6) AS b_p95_px, b_refusal, pairing FROM pr")
def j10(t):
    return pairs(t).select(*C.KEY, r6(F.col("p95_px"), "p95_px"), r6(F.col("b_p95_px"), "b_p95_px"), "b_refusal", "pairing")


def q_sql(col: str, q: float) -> str:
    return f"(SELECT list_sort(list({col}))[1 + ceil((count(*) - 1) * {q})::BIGINT] FROM pr p2 WHERE pairing = 'measured' AND p2.family = f.family)"


@query(
    "a44_tail_comparison",
    "meas1",
    f"""{BASE_SQL}, q AS (SELECT f.family, {q_sql('p95_px', 0.95)} AS s95, {q_sql('b_p95_px', 0.95)} AS b95, {q_sql('p99_px', 0.99)} AS s99, {q_sql('b_p99_px', 0.99)} AS b99,
      (SELECT max(max_px) FROM pr p2 WHERE pairing = 'measured' AND p2.family = f.family) AS sm, (SELECT max(b_max_px) FROM pr p2 WHERE pairing = 'measured' AND p2.family = f.family) AS bm
      FROM (SELECT DISTINCT family FROM pr WHERE pairing = 'measured') f)
    SELECT family, round(s95, 6) AS selected_p95, round(b95, 6) AS baseline_p95, round(s99, 6) AS selected_p99, round(b99, 6) AS baseline_p99, round(sm, 6) AS selected_max, round(bm, 6) AS baseline_max,
      s95 <= b95 AND s99 <= b99 AND sm <= bm AS no_tail_regression, s95 < b95 OR s99 < b99 OR sm < bm AS strict_tail_improvement FROM q""",
)
def a44(t):
    d = C.tail_comparison(pairs(t), ["family"])
    px = [f"{s}_{k}" for s in ("selected", "baseline") for k in ("p95", "p99", "max")]
    return d.select("family", *[r6(F.col(c), c) for c in px], "no_tail_regression", "strict_tail_improvement")


@query(
    "a45_complexity_growth",
    "meas1",
    f"""{BASE_SQL}, s AS (SELECT family, sum(segments) AS a, sum(b_segments) AS b, sum(bytes) AS c, sum(b_bytes) AS d, sum(palette_delta) AS e, sum(b_palette_delta) AS f FROM pr WHERE pairing = 'measured' GROUP BY family)
    SELECT family, round(a / b::DOUBLE, 6) AS segments_growth, round(c / d::DOUBLE, 6) AS bytes_growth, round(e / f::DOUBLE, 6) AS palette_delta_growth,
      round(greatest(a / b::DOUBLE, c / d::DOUBLE, e / f::DOUBLE), 6) AS max_growth, greatest(a / b::DOUBLE, c / d::DOUBLE, e / f::DOUBLE) <= 1.0 AS gate_met FROM s""",
)
def a45(t):
    d = C.complexity_growth(pairs(t), ["family"], ["segments", "bytes", "palette_delta"], 1.0)
    cols = ("segments_growth", "bytes_growth", "palette_delta_growth", "max_growth")
    return d.select("family", *[r6(F.col(c), c) for c in cols], "gate_met")


BLIND_SQL = f"""{BASE_SQL}, e AS (SELECT *, pairing = 'measured' AS ok FROM pr),
  bm AS (SELECT group_id, count(*) FILTER (WHERE catastrophic)::HUGEINT AS s1, sum(round(p95_px * 1e6)::HUGEINT) AS s2, sum(round(p99_px * 1e6)::HUGEINT) AS s3, max(round(max_px * 1e6)::HUGEINT) AS s4,
     sum(palette_delta)::HUGEINT AS s5, sum(segments)::HUGEINT AS s6, sum(bytes)::HUGEINT AS s7,
     count(*) FILTER (WHERE NOT ok OR b_palette_delta > 8)::HUGEINT AS b1, sum(round(CASE WHEN ok THEN b_p95_px ELSE 1.25 END * 1e6)::HUGEINT) AS b2, sum(round(CASE WHEN ok THEN b_p99_px ELSE 1.30 END * 1e6)::HUGEINT) AS b3,
     max(round(CASE WHEN ok THEN b_max_px ELSE 1.40 END * 1e6)::HUGEINT) AS b4, sum(CASE WHEN ok THEN b_palette_delta ELSE 9 END)::HUGEINT AS b5,
     sum(CASE WHEN ok THEN b_segments ELSE 18014398509481983 END)::HUGEINT AS b6, sum(CASE WHEN ok THEN b_bytes ELSE 18014398509481983 END)::HUGEINT AS b7 FROM e GROUP BY group_id),
  cm AS (SELECT *, sha256('blind-v1|' || group_id) AS commitment FROM bm),
  tr AS (SELECT group_id, commitment, CASE WHEN ('0x' || substr(commitment, 1, 2))::INT % 2 = 0 THEN 'left' ELSE 'right' END AS selected_side,
     CASE WHEN (s1, s2, s3, s4, s5, s6, s7) < (b1, b2, b3, b4, b5, b6, b7) THEN 'selected' WHEN (s1, s2, s3, s4, s5, s6, s7) > (b1, b2, b3, b4, b5, b6, b7) THEN 'baseline' ELSE 'tie' END AS winner FROM cm)"""


@query(
    "a46_blind_metrics",
    "meas1",
    f"""{BLIND_SQL} SELECT group_id, s1::BIGINT AS selected_catastrophic, (s2 / 1e6)::DOUBLE AS selected_p95, s5::BIGINT AS selected_palette, b1::BIGINT AS baseline_catastrophic,
       (b2 / 1e6)::DOUBLE AS baseline_p95, b5::BIGINT AS baseline_palette, (b6 % 1000003)::BIGINT AS baseline_segments FROM bm""",
)
def a46(t):
    d = C.blind_metrics(pairs(t), C.BlindGates())
    big = lambda c, n: F.col(c).cast("bigint").alias(n)
    px = lambda c, n: (F.col(c).cast("double") / 1e6).alias(n)
    return d.select(
        "group_id", big("selected.catastrophic", "selected_catastrophic"), px("selected.p95", "selected_p95"), big("selected.palette", "selected_palette"),
        big("baseline.catastrophic", "baseline_catastrophic"), px("baseline.p95", "baseline_p95"), big("baseline.palette", "baseline_palette"),
        (F.col("baseline.segments") % 1000003).cast("bigint").alias("baseline_segments"),
    )


@query(
    "a47_blind_trials",
    "meas1",
    f"""{BLIND_SQL} SELECT group_id, commitment, selected_side, CASE WHEN winner = 'tie' THEN 'tie' WHEN (winner = 'selected') = (selected_side = 'left') THEN 'left' ELSE 'right' END AS choice,
      winner = 'selected' AS selected_preferred, winner = 'baseline' AS baseline_preferred FROM tr""",
)
def a47a(t):
    return C.blind_trials(C.blind_metrics(pairs(t), C.BlindGates()), "blind-v1")


@query(
    "a47_blind_verdict",
    "meas1",
    f"""{BLIND_SQL}, v AS (SELECT count(*) AS source_trials, count(*) FILTER (WHERE winner = 'selected') AS selected_wins, count(*) FILTER (WHERE winner = 'baseline') AS baseline_wins FROM tr),
    p AS (SELECT *, selected_wins + baseline_wins AS nt, least(1.0, list_sum(list_transform(range(selected_wins, selected_wins + baseline_wins + 1), lambda j:
      exp(lgamma(selected_wins + baseline_wins + 1.0) - lgamma(j + 1.0) - lgamma(selected_wins + baseline_wins - j + 1.0) - (selected_wins + baseline_wins) * ln(2.0::DOUBLE))))) AS p FROM v)
    SELECT source_trials, selected_wins, baseline_wins, nt AS non_tied_trials, source_trials - nt AS ties, round(selected_wins / nt::DOUBLE, 6) AS preference_rate, round(p, 6) AS p_value,
      source_trials >= 10 AND selected_wins / nt::DOUBLE >= 0.5 AND p <= 0.05 AS gate_met FROM p""",
)
def a47b(t):
    trials = C.blind_trials(C.blind_metrics(pairs(t), C.BlindGates()), "blind-v1")
    d = C.blind_verdict(trials, C.BlindGates())
    return d.withColumns({"preference_rate": F.round("preference_rate", 6), "p_value": F.round("p_value", 6)})


@query(
    "a48_bundle_digest",
    "",
    f"""src AS (SELECT l_suppkey AS group_id, sha256(concat_ws('/', l_orderkey, l_partkey, l_linenumber, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT)) AS d FROM lineitem),
    {digest_sql('src', ['group_id'], 'd', 'd')} SELECT group_id, p AS bundle FROM dg3""",
)
def a48(t):
    text = F.concat_ws("/", "l_orderkey", "l_partkey", "l_linenumber", F.rint("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    src = t.table("lineitem").select(F.col("l_suppkey").alias("group_id"), F.sha2(text, 256).alias("d"))
    return ordered_digest(src, ["group_id"], ["d"], F.col("d"), "bundle")


ROW_TEXT = "concat_ws('|', group_id, scene_id, cell_id, CASE WHEN accepted THEN 1 ELSE 0 END, palette_delta, class)"


@query(
    "a61_population_commitment",
    "meas1",
    f"""src AS (SELECT concat_ws('|', group_id, scene_id, cell_id) AS k0, sha256(concat_ws('|', group_id, scene_id, cell_id)) AS d FROM meas1),
    {digest_sql('src', [], 'k0', 'd')} SELECT (SELECT count(*) FROM src) AS rows, p AS commitment FROM dg3""",
)
def a61(t):
    key = F.concat_ws("|", "group_id", "scene_id", "cell_id")
    src = t.meas1().select(key.alias("k0"), F.sha2(key, 256).alias("d"))
    digest = ordered_digest(src, [], ["k0"], F.col("d"), "commitment")
    return src.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(digest))  # one row each


@query(
    "a73_normalised_report_digest",
    "meas1",
    f"""src AS (SELECT family, concat_ws('|', group_id, scene_id, cell_id) AS k0, sha256({ROW_TEXT}) AS d FROM meas1),
    {digest_sql('src', ['family'], 'k0', 'd')} SELECT family, p AS digest FROM dg3""",
)
def a73(t):
    key = F.concat_ws("|", "group_id", "scene_id", "cell_id")
    text = F.concat_ws("|", "group_id", "scene_id", "cell_id", F.col("accepted").cast("int"), "palette_delta", "class")
    src = t.meas1().select("family", key.alias("k0"), F.sha2(text, 256).alias("d"))  # telemetry columns dropped
    return ordered_digest(src, ["family"], ["k0"], F.col("d"))


GATE_SQL = "gates(section, key, gate) AS (VALUES " + ", ".join(f"('{s}', '{k}', {v}::DOUBLE)" for s, k, v, _ in GATES) + ")"
METRICS = ["p95_px", "p99_px", "max_px", "palette_delta", "channel_delta", "runtime_ms"]
LONG_SQL = "lg AS (" + " UNION ALL ".join(f"SELECT group_id, scene_id, cell_id, family, '{m}' AS key, {m}::DOUBLE AS value FROM meas1" for m in METRICS) + ")"


@query(
    "j13_threshold_join",
    "meas1",
    f"{GATE_SQL}, {LONG_SQL} SELECT group_id, scene_id, cell_id, section, key, round(value, 6) AS value, gate, value <= gate AS met FROM lg JOIN gates USING (key)",
)
def j13(t):
    d = C.against_gates(t.meas1(), C.KEY, METRICS, load_gates(t.spark))
    return d.select(*C.KEY, "section", "key", r6(F.col("value"), "value"), "gate", "met")


@query(
    "g07_release_verdict",
    "meas1",
    f"""{GATE_SQL}, {LONG_SQL}, f AS (SELECT DISTINCT group_id, 'violates ' || section || '.' || key AS refusal FROM lg JOIN gates USING (key) WHERE NOT value <= gate)
    SELECT g.group_id, count(refusal) = 0 AS gate_met, coalesce(string_agg(refusal, '; ' ORDER BY refusal), '') AS refusals FROM (SELECT DISTINCT group_id FROM meas1) g LEFT JOIN f USING (group_id) GROUP BY g.group_id""",
)
def g07(t):
    judged = C.against_gates(t.meas1(), C.KEY, METRICS, load_gates(t.spark)).filter("not met")
    refusals = judged.select("group_id", F.concat(F.lit("violates "), "section", F.lit("."), "key").alias("refusal"))
    d = C.release_verdict(refusals, t.meas1().select("group_id").distinct(), ["group_id"])
    return d.withColumn("refusals", F.array_join("refusals", "; "))


@query(
    "a72_recovery_by_mode",
    "meas",
    """m AS (SELECT class AS mode, status <> 'P' AS measured, status <> 'P' AND p95_px < 0.2 AS recovered FROM meas)
    SELECT mode, count(*) AS attempted, count(*) FILTER (WHERE measured) AS measured, count(*) FILTER (WHERE NOT measured) AS refused, count(*) FILTER (WHERE recovered) AS recovered,
      round(count(*) FILTER (WHERE recovered) / count(*)::DOUBLE, 6) AS recovery_rate, count(*) FILTER (WHERE measured) >= 100 AND count(*) FILTER (WHERE recovered) / count(*)::DOUBLE >= 0.4 AS gate_met FROM m GROUP BY mode""",
)
def a72(t):
    measured = F.col("status") != "P"
    d = t.meas().select(F.col("class").alias("mode"), measured.alias("measured"), (measured & (F.col("p95_px") < 0.2)).alias("recovered"))
    return C.recovery_by_mode(d, 100, 0.4).withColumn("recovery_rate", F.round("recovery_rate", 6))
