"""Corridor coverage, factorial effects, recall and determinism."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import coverage as V, factorial as A
from rasterlake.operators.courts import by_axes
from rasterlake.operators.digests import digest_sql
from rasterlake.operators.determinism import artifact_determinism, run_determinism
from rasterlake.plans.functions_queries import r6
from rasterlake.registry import query

Z = {"50": 0.674489750196082, "90": 1.644853626951472, "95": 1.959963984540054, "99": 2.575829303548901}
SUMMARY = (
    "n AS samples, ds AS ds_px, "
    + ", ".join(f"round(in{p} / ds, 6) AS coverage_{p}" for p in Z)
    + """, round(h[1 + least(floor(n * 0.5), n - 1)::BIGINT], 6) AS median_halfwidth_px, round(h[1 + least(floor(n * 0.95), n - 1)::BIGINT], 6) AS p95_halfwidth_px,
    round(d[1 + least(floor(n * 0.5), n - 1)::BIGINT], 6) AS median_distance_px, round(d[1 + least(floor(n * 0.95), n - 1)::BIGINT], 6) AS p95_distance_px,
    round(mx, 6) AS max_distance_px, round(bias / ds, 6) AS bias_px, round(cap / n::DOUBLE, 6) AS capped_fraction, round(margin / ds, 6) AS margin_survival"""
)


def agg_sql(keys: str, source: str) -> str:
    ins = ", ".join(f"sum(CASE WHEN distance_px <= sigma_px * {z} THEN weight_ds ELSE 0 END) AS in{p}" for p, z in Z.items())
    return f"""SELECT {keys} count(*) AS n, sum(weight_ds) AS ds, {ins}, sum(CASE WHEN distance_px + 1 <= sigma_px * {Z['95']} THEN weight_ds ELSE 0 END) AS margin,
      sum(bias_px * weight_ds) AS bias, count(*) FILTER (WHERE capped) AS cap, max(distance_px) AS mx, list_sort(list(sigma_px * {Z['95']})) AS h, list_sort(list(distance_px)) AS d FROM {source}"""


REAL = [f"coverage_{p}" for p in Z] + [
    "median_halfwidth_px", "p95_halfwidth_px", "median_distance_px", "p95_distance_px", "max_distance_px", "bias_px", "capped_fraction", "margin_survival",
]


@query("a31_coverage_summary", "samples", f"a AS ({agg_sql('axis_flag, axis_status,', 'samples')} GROUP BY axis_flag, axis_status) SELECT axis_flag, axis_status, {SUMMARY} FROM a")
def a31(t):
    d = V.coverage_summary(t.samples(), ["axis_flag", "axis_status"])
    return d.select("axis_flag", "axis_status", "samples", "ds_px", *[r6(F.col(c), c) for c in REAL])


SAMPLE_AXES = ["axis_flag", "axis_status", "axis_line", "axis_segment"]


@query(
    "a32_axis_buckets",
    "samples",
    "l AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a}::VARCHAR AS value, * FROM samples" for a in SAMPLE_AXES)
    + f"), a AS ({agg_sql('axis, value,', 'l')} GROUP BY axis, value) SELECT axis, value, {SUMMARY} FROM a",
)
def a32(t):
    d = V.coverage_by_axis(t.samples(), SAMPLE_AXES)
    return d.select("axis", "value", "samples", "ds_px", *[r6(F.col(c), c) for c in REAL])


@query(
    "a33_recovery_counts",
    "meas",
    """a AS (SELECT family, CASE WHEN quantity % 7 <> 0 THEN status END AS recovered, CASE WHEN quantity % 3 = 0 THEN 'F' ELSE 'O' END AS truth, identifiability = 'identifiable' AS idf FROM meas)
    SELECT family, count(*) AS supported, count(*) FILTER (WHERE recovered = truth) AS correct, count(*) FILTER (WHERE recovered <> truth) AS wrong, count(*) FILTER (WHERE idf) AS identifiable,
      count(*) FILTER (WHERE NOT idf) AS unidentifiable, count(*) FILTER (WHERE idf AND recovered = truth) AS correct_where_identifiable FROM a WHERE recovered IS NOT NULL GROUP BY family""",
)
def a33(t):
    d = t.meas().select(
        "family", F.when(F.col("quantity") % 7 != 0, F.col("status")).alias("recovered"),
        F.when(F.col("quantity") % 3 == 0, "F").otherwise("O").alias("truth"), (F.col("identifiability") == "identifiable").alias("identifiable"),
    )
    return V.recovery_counts(d, ["family"])


ARM_SQL = """mem AS (SELECT *, 'f' || (event_id % 37) AS fixture, CASE WHEN user_id % 7 = 3 AND event_id % 2 = 0 THEN 'n2' ELSE 'n1' END AS budget, 'v1' AS schema FROM arms WHERE arm IS NOT NULL),
  ag AS (SELECT user_id, arm, avg(value) AS v, count(*) AS members, bool_or(contaminated) AS cont, CASE WHEN min(backend) <> max(backend) THEN 'key_mismatch:backend' WHEN min(schema) IS NULL THEN 'x'
     WHEN min(budget) <> max(budget) THEN 'key_mismatch:budget' END AS refusal FROM (SELECT * REPLACE (event_id % 29 = 0 AS contaminated) FROM mem) GROUP BY user_id, arm)"""


def arm_rows(t):
    return t.arms().select(
        "user_id", "arm", "value", (F.col("event_id") % 29 == 0).alias("contaminated"), "backend", F.lit("c").alias("config"),
        F.when((F.col("user_id") % 7 == 3) & (F.col("event_id") % 2 == 0), "n2").otherwise("n1").alias("budget"), F.lit("v1").alias("schema"),
        F.concat(F.lit("f"), F.col("event_id") % 37).alias("fixture"),
    )


@query(
    "a49_arm_aggregate",
    "arms",
    f"""{ARM_SQL}, src AS (SELECT DISTINCT user_id, arm, fixture FROM mem), {digest_sql('src', ['user_id', 'arm'], 'fixture', 'fixture')}
    SELECT user_id, arm, CASE WHEN refusal IS NULL THEN round(v, 6) END AS value, members, cont AS contaminated, p AS fixture_hash, refusal FROM ag JOIN dg3 USING (user_id, arm)""",
)
def a49(t):
    return A.arm_aggregate(arm_rows(t), ["user_id"], "mean").withColumn("value", F.round("value", 6))


UNIT_SQL = "u AS (SELECT user_id, day, arm, avg(value) AS value, bool_or(event_id % 29 = 0) AS contaminated FROM arms WHERE arm IS NOT NULL GROUP BY ALL), w AS (SELECT user_id, day, bool_or(contaminated) AS contaminated, max(CASE WHEN arm = 'PF00' THEN value END) AS p00, max(CASE WHEN arm = 'PF01' THEN value END) AS p01, max(CASE WHEN arm = 'PF10' THEN value END) AS p10, max(CASE WHEN arm = 'PF11' THEN value END) AS p11 FROM u GROUP BY ALL)"


def unit_arms(t):
    return t.arms().filter("arm is not null").groupBy("user_id", "day", "arm").agg(
        F.avg("value").alias("value"), F.bool_or(F.col("event_id") % 29 == 0).alias("contaminated")
    )


@query(
    "a50_factorial_effects",
    "arms",
    f"""{UNIT_SQL}, a AS (SELECT *, concat_ws(',', CASE WHEN p00 IS NULL THEN 'PF00' END, CASE WHEN p01 IS NULL THEN 'PF01' END, CASE WHEN p10 IS NULL THEN 'PF10' END, CASE WHEN p11 IS NULL THEN 'PF11' END) AS absent FROM w)
    SELECT user_id, day, contaminated, round(0.5 * ((p10 - p00) + (p11 - p01)), 6) AS partition_main_effect, round(0.5 * ((p01 - p00) + (p11 - p10)), 6) AS formation_main_effect,
      round(0.5 * ((p11 - p01) - (p10 - p00)), 6) AS interaction, CASE WHEN absent <> '' THEN 'absent arms: ' || absent END AS refusal FROM a""",
)
def a50(t):
    d = A.effects(unit_arms(t), ["user_id", "day"])
    return d.withColumns({n: F.round(n, 6) for n in A.EFFECTS})


@query(
    "a51_ladder_deltas",
    "arms",
    f"""{UNIT_SQL} SELECT user_id, day, 'PF10-PF00' AS step, round(p10 - p00, 6) AS delta, CASE WHEN p10 IS NULL OR p00 IS NULL THEN 'missing_arm' END AS refusal FROM w
    UNION ALL SELECT user_id, day, 'PF11-PF01', round(p11 - p01, 6), CASE WHEN p11 IS NULL OR p01 IS NULL THEN 'missing_arm' END FROM w""",
)
def a51(t):
    d = A.ladder(unit_arms(t), ["user_id", "day"], [("PF10", "PF00"), ("PF11", "PF01")])
    return d.withColumn("delta", F.round("delta", 6))


@query(
    "a52_arm_leaderboard",
    "meas1",
    """w AS (SELECT family, profile, max(runtime_ms) AS m FROM meas1 GROUP BY ALL)
    SELECT family, profile, count(*) AS arms, max(runtime_ms) AS max_abs_code, min(CASE WHEN runtime_ms = w.m THEN scene_id END) AS worst_scene_id, round(avg(p95_px), 6) AS edge_mean_mean, round(max(p95_px), 6) AS edge_mean_max,
      round(min(p99_px), 6) AS identical_min, bool_and(accepted) AS all_serialization_identical FROM meas1 JOIN w USING (family, profile) GROUP BY family, profile""",
)
def a52(t):
    d = t.meas1().select(
        "family", "profile", "scene_id", F.col("runtime_ms").alias("max_abs_code"), F.col("p95_px").alias("edge_mean"), F.col("p99_px").alias("identical"),
        F.col("accepted").alias("serialization_identical"),
    )
    d = A.leaderboard(d, ["family", "profile"])
    return d.withColumns({c: F.round(c, 6) for c in ("edge_mean_mean", "edge_mean_max", "identical_min")})


POPS = {"all": "TRUE", "non_trivial": "palette_delta > 3", "trivial": "palette_delta <= 3", "identifiable": "identifiability = 'identifiable'", "none": "palette_delta > 1000"}
RFLAGS = {"in_envelope": "quantity % 10 <> 0", "events_only": "quantity % 4 <> 0", "fixed_only": "quantity % 2 = 0", "unrelated": "quantity % 5 = 0"}


@query(
    "a53_recall",
    "meas",
    "x AS ("
    + " UNION ALL ".join(f"SELECT '{p}' AS population, '{f}' AS flag, count(*) FILTER (WHERE {pc}) AS arms, count(*) FILTER (WHERE {pc} AND {fc}) AS hits FROM meas" for p, pc in POPS.items() for f, fc in RFLAGS.items())
    + ") SELECT population, flag, arms, hits, CASE WHEN arms > 0 THEN round(hits / arms::DOUBLE, 6) END AS recall FROM x",
)
def a53(t):
    rows = t.meas().withColumns({f: F.expr(c.replace("<>", "!=")) for f, c in RFLAGS.items()})
    d = A.recall(rows, {p: F.expr(c) for p, c in POPS.items()}, list(RFLAGS))
    return d.withColumn("recall", F.round("recall", 6))


FIELDS = ["raw", "denoised", "trimmed", "deconvolved", "unused"]


@query(
    "a54_field_contribution",
    "meas",
    """f(field) AS (VALUES ('raw'), ('denoised'), ('trimmed'), ('deconvolved'), ('unused')),
    a AS (SELECT list_filter([CASE WHEN quantity % 2 = 0 THEN 'raw' END, CASE WHEN quantity % 3 = 0 THEN 'denoised' END, CASE WHEN quantity % 5 = 0 THEN 'trimmed' END, CASE WHEN quantity % 7 = 0 THEN 'deconvolved' END], lambda v: v IS NOT NULL) AS fs FROM meas),
    e AS (SELECT unnest(fs) AS field, len(fs) = 1 AS sole FROM a)
    SELECT f.field, count(e.field) AS matched, count(*) FILTER (WHERE sole) AS sole_source FROM f LEFT JOIN e USING (field) GROUP BY f.field""",
)
def a54(t):
    q = F.col("quantity")
    fields = F.filter(F.array(*[F.when(q % m == 0, n) for n, m in zip(FIELDS, (2, 3, 5, 7))]), lambda v: v.isNotNull())
    return A.field_contribution(t.meas().select(fields.alias("fs")), "fs", FIELDS)


@query(
    "a55_pruning_totals",
    "meas",
    """SELECT family, count(*) AS arms, count(*) FILTER (WHERE quantity % 6 > 0) AS arms_with_budget_pruning, sum(quantity % 6)::BIGINT AS budget_removed, sum(palette_delta)::BIGINT AS dominated_removed,
      count(*) FILTER (WHERE quantity % 4 > 0) AS arms_losing_a_true_candidate, count(*) FILTER (WHERE quantity % 4 > 0 AND NOT accepted) AS arms_losing_the_last_true_candidate FROM meas GROUP BY family""",
)
def a55(t):
    q = F.col("quantity")
    d = t.meas().select(
        "family", (q % 6).alias("budget_removed"), F.col("palette_delta").alias("dominated_removed"), (q % 4).alias("budget_removed_truth"), F.col("accepted").alias("truth_kept")
    )
    return A.pruning_totals(d, ["family"])


@query(
    "a56_corpus_composition",
    "meas",
    """SELECT coalesce(CASE WHEN g = 7 THEN 'class' WHEN g = 11 THEN 'status' WHEN g = 13 THEN 'identifiability' ELSE 'profile' END) AS axis,
      coalesce(class, status, identifiability, profile) AS value, n AS rows, gr AS groups FROM
      (SELECT class, status, identifiability, profile, grouping(class, status, identifiability, profile) AS g, count(*) AS n, count(DISTINCT group_id) AS gr
       FROM meas GROUP BY GROUPING SETS ((class), (status), (identifiability), (profile)))""",
)
def a56(t):
    d = by_axes(t.meas(), ["class", "status", "identifiability", "profile"])
    return d.groupBy("axis", "value").agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups"))


@query(
    "a57_artifact_determinism",
    "runs",
    """k AS (SELECT DISTINCT input, artifact FROM runs), s AS (SELECT k.*, r.range AS repeat, coalesce(runs.digest, 'MISSING') AS digest FROM k CROSS JOIN range(0, 3) r LEFT JOIN runs ON runs.input = k.input AND runs.artifact = k.artifact AND runs.repeat = r.range),
    f AS (SELECT input, min(artifact) AS a0 FROM k GROUP BY input)
    SELECT input, artifact, artifact = a0 AS declared, count(DISTINCT digest) = 1 AS deterministic, count(*) FILTER (WHERE digest = 'MISSING') AS missing, string_agg(substr(digest, 1, 8), ',' ORDER BY repeat) AS digests
    FROM s JOIN f USING (input) GROUP BY input, artifact, a0""",
)
def a57(t):
    first = t.runs().groupBy("input").agg(F.min("artifact").alias("a0"))
    runs = t.runs().join(first, "input").withColumn("declared", F.col("artifact") == F.col("a0"))
    d = artifact_determinism(runs, repeats=3)
    short = F.array_join(F.transform("digests", lambda s: F.substring(s, 1, 8)), ",")
    return d.withColumn("digests", short)


@query(
    "a58_run_determinism",
    "meas",
    """r AS (SELECT family || '/' || (quantity % 10) AS preset, (cell_id % 3)::INT AS run, CASE WHEN cell_id % 3 = 2 THEN 4 ELSE 1 END AS workers, sha256(CASE WHEN (quantity % 10) % 2 = 0 THEN max(quantity)::VARCHAR ELSE string_agg(DISTINCT palette_delta::VARCHAR, ',' ORDER BY palette_delta::VARCHAR) END) AS digest FROM meas WHERE group_id % 5 > 0 OR cell_id < 7 GROUP BY family, quantity % 10, cell_id % 3)
    SELECT preset, count(*) FILTER (WHERE workers = 1) AS isolated_repeats, count(*) FILTER (WHERE workers > 1) AS parallel_runs, count(DISTINCT digest) = 1 AS all_equal,
      count(*) FILTER (WHERE workers = 1) = 2 AND count(*) FILTER (WHERE workers > 1) = 1 AND count(DISTINCT digest) = 1 AS gate_met FROM r GROUP BY preset""",
)
def a58(t):
    d = (
        t.meas()
        .filter((F.col("group_id") % 5 > 0) | (F.col("cell_id") < 7))
        .groupBy(F.concat_ws("/", "family", F.col("quantity") % 10).alias("preset"), (F.col("cell_id") % 3).alias("run"))
        .agg(F.sha2(F.when(F.max("quantity") % 2 == 0, F.max("quantity").cast("string")).otherwise(F.array_join(F.array_sort(F.collect_set(F.col("palette_delta").cast("string"))), ",")), 256).alias("digest"))
        .withColumn("workers", F.when(F.col("run") == 2, 4).otherwise(1))
    )
    return run_determinism(d)
