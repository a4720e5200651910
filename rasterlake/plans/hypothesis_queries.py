"""Posterior mass, beams, envelopes, levels and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import hypotheses as H
from rasterlake.operators.geometry import signed_area
from rasterlake.plans.functions_queries import r6
from rasterlake.registry import query

U_SQL = """h AS (SELECT *, memory_bytes % 4 = 0 AS budget_pruned FROM hyp),
  un AS (SELECT DISTINCT image_id, ['complete', 'certified', 'empirical', 'unknown'][1 + image_id % 4] AS mode, image_id % 9 AS hidden, 100.5 + image_id % 7 AS hidden_bits, (image_id % 5) / 4.0::DOUBLE AS hidden_mass FROM hyp),
  b AS (SELECT image_id, min(total_bits) AS ref FROM h GROUP BY 1), m AS (SELECT h.*, ref, pow(2.0, greatest(-1074, least(1023, ref - total_bits))) AS mass FROM h JOIN b USING (image_id)),
  im AS (SELECT image_id, ref, sum(mass) AS expl, sum(CASE WHEN budget_pruned THEN mass ELSE 0 END) AS pruned, count(*) AS members FROM m GROUP BY ALL),
  u AS (SELECT im.*, mode, CASE mode WHEN 'complete' THEN 0.0 WHEN 'certified' THEN pow(2.0, greatest(-1074, least(1023, ref - hidden_bits))) * hidden WHEN 'empirical' THEN hidden_mass END AS hid,
     CASE WHEN mode IN ('complete', 'certified') THEN 'certified' WHEN mode = 'empirical' THEN 'empirical' ELSE 'unknown' END AS st FROM im JOIN un USING (image_id)),
  cl AS (SELECT image_id, 'delivery' AS level, delivery AS class_id, sum(mass) AS mass FROM m GROUP BY ALL UNION ALL SELECT image_id, 'topology', topology_class, sum(mass) FROM m GROUP BY ALL
     UNION ALL SELECT image_id, 'formation', formation_class, sum(mass) FROM m GROUP BY ALL)"""


def unexplored(t):
    i = F.col("image_id")
    names = F.array(*[F.lit(n) for n in ("complete", "certified", "empirical", "unknown")])
    return t.hyp().select("image_id").distinct().select(
        i, F.element_at(names, (i % 4 + 1).cast("int")).alias("mode"), (i % 9).alias("hidden"), (i % 7 + 100.5).alias("hidden_bits"),
        (i % 5 / 4.0).alias("hidden_mass"), F.lit(3).alias("topology_bound"), F.lit(2).alias("formation_bound"),
    )


def scored(t):
    return t.hyp().withColumn("budget_pruned", F.col("memory_bytes") % 4 == 0)


@query(
    "a59_class_posteriors",
    "hyp",
    f"""{U_SQL} SELECT image_id, level, class_id, round(mass, 6) AS mass, round(mass / expl, 6) AS normalized, st AS bound_status, round(mass / (expl + hid), 6) AS lower_bound FROM cl JOIN u USING (image_id)""",
)
def a59(t):
    classes, _ = H.posterior(scored(t), unexplored(t))
    return classes.select(
        "image_id", "level", "class_id", r6(F.col("mass"), "mass"), r6(F.col("normalized"), "normalized"),
        F.col("lower_bound.status").alias("bound_status"), r6(F.col("lower_bound.value"), "lower_bound"),
    )


ENT = "CASE WHEN {p} <= 1.0 / {n} THEN log2({n}.0::DOUBLE) WHEN {p} >= 1 - 1e-15 THEN 0.0 ELSE -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) + (1 - {p}) * log2({n} - 1.0::DOUBLE) END"


@query(
    "a59_posterior_summary",
    "hyp",
    f"""{U_SQL}, tp AS (SELECT image_id, max(CASE WHEN level = 'topology' THEN mass END) AS tt, max(CASE WHEN level = 'formation' THEN mass END) AS tf FROM cl GROUP BY 1),
    z AS (SELECT *, least(1.0, greatest(0.0, tt / (expl + hid))) AS pt, least(1.0, greatest(0.0, tf / (expl + hid))) AS pf FROM u JOIN tp USING (image_id))
    SELECT image_id, members, mode, round(ref, 6) AS reference_bits, round(expl, 6) AS explored_mass, round(pruned, 6) AS pruned_mass, round(hid, 6) AS unexplored_mass, round(expl / (expl + hid), 6) AS retained_lower_bound, st AS bound_status,
      CASE WHEN hid IS NOT NULL THEN round({ENT.format(p='pt', n=3)}, 5) END AS topology_entropy_bound, CASE WHEN hid IS NOT NULL THEN round({ENT.format(p='pf', n=2)}, 5) END AS formation_entropy_bound FROM z""",
)
def a59b(t):
    _, d = H.posterior(scored(t), unexplored(t))
    real = ["reference_bits", "explored_mass", "pruned_mass", "unexplored_mass", "retained_lower_bound"]
    five = lambda c: F.round(c, 5).alias(c)
    return d.select("image_id", "members", "mode", "bound_status", *[r6(F.col(c), c) for c in real], five("topology_entropy_bound"), five("formation_entropy_bound"))


@query(
    "a60_lost_mass",
    "hyp",
    """w AS (SELECT image_id, exp(-(total_bits - min(total_bits) OVER (PARTITION BY image_id)) / 8) AS w, memory_bytes > 30 AS dropped FROM hyp)
    SELECT image_id, count(*) AS candidates, CASE WHEN bool_or(dropped) THEN round(sum(CASE WHEN dropped THEN w ELSE 0 END) / sum(w), 6) END AS lost_mass FROM w GROUP BY image_id""",
)
def a60(t):
    d = H.lost_mass(t.hyp(), ["image_id"], "total_bits", F.col("memory_bytes") > 30)
    return d.withColumn("lost_mass", F.round("lost_mass", 6))


@query("t01_palette_beam", "hyp", "SELECT image_id, hypothesis_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY total_bits, hypothesis_id)::INT AS rank FROM hyp) WHERE rank <= 3")
def t01(t):
    return H.palette_beam(t.hyp(), "image_id", "total_bits", "hypothesis_id", 3).select("image_id", "hypothesis_id", "rank")


# the sequential scan as a recursive walk over the ordered candidates
SCAN_SQL = """uq AS (SELECT image_id, hypothesis_id, total_bits, topology_class, formation_class, memory_bytes, row_number() OVER (PARTITION BY image_id ORDER BY total_bits, hypothesis_id) AS p
     FROM (SELECT *, row_number() OVER (PARTITION BY image_id, delivery ORDER BY total_bits, hypothesis_id) AS d FROM hyp) WHERE d = 1),
  sc(image_id, p, used, taken, scan) AS (SELECT DISTINCT image_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM uq UNION ALL
     SELECT s.image_id, u.p, CASE WHEN taken < {cnt} AND used + memory_bytes <= {cap} THEN used + memory_bytes ELSE used END, CASE WHEN taken < {cnt} AND used + memory_bytes <= {cap} THEN taken + 1 ELSE taken END,
       CASE WHEN taken >= {cnt} THEN 'candidate_budget' WHEN used + memory_bytes <= {cap} THEN 'considered' ELSE 'memory_budget' END FROM sc s JOIN uq u ON u.image_id = s.image_id AND u.p = s.p + 1)"""


@query("w08_memory_scan", "hyp", f"RECURSIVE {SCAN_SQL.format(cnt=2, cap=60)} SELECT image_id, hypothesis_id, scan FROM sc JOIN uq USING (image_id, p)")
def w08(t):
    best = F.min(F.struct("total_bits", "hypothesis_id", "memory_bytes"))
    unique = t.hyp().groupBy("image_id", "delivery").agg(best.alias("b")).select("image_id", "b.*")
    d = H.memory_scan(unique, "image_id", ["total_bits", "hypothesis_id"], "memory_bytes", 60, 2)
    return d.select("image_id", "hypothesis_id", "scan")


BEAM = H.BeamConfig(width=3, within_best_bits=30.0, min_topology_classes=2, min_formation_classes=2, max_candidates=4, max_bytes=100)
BEAM_SQL = f"""{SCAN_SQL.format(cnt=4, cap=100)}, cs AS (SELECT uq.*, scan FROM sc JOIN uq USING (image_id, p)), co AS (SELECT *, min(total_bits) OVER (PARTITION BY image_id) AS best FROM cs WHERE scan = 'considered'),
  el AS (SELECT * FROM co WHERE total_bits <= best + 30),
  ls AS (SELECT image_id, list(hypothesis_id ORDER BY p) AS ids, list(topology_class ORDER BY p) AS ts, list(formation_class ORDER BY p) AS fs FROM el GROUP BY image_id),
  s1 AS (SELECT *, list_filter(range(1, len(ids) + 1), lambda i: list_position(ts, ts[i]) = i)[1:2] AS sel FROM ls),
  s2 AS (SELECT *, list_filter(range(1, len(ids) + 1), lambda i: list_position(fs, fs[i]) = i)[1:2] AS ff FROM s1),
  s3 AS (SELECT *, list_concat(sel, list_filter(ff, lambda i: NOT list_contains(sel, i))[1:3 - len(sel)]) AS sel2 FROM s2),
  s4 AS (SELECT *, list_concat(sel2, list_filter(range(1, len(ids) + 1), lambda i: NOT list_contains(sel2, i))[1:3 - len(sel2)]) AS sel3 FROM s3),
  kp AS (SELECT image_id, unnest(list_transform(sel3, lambda i: ids[i])) AS hypothesis_id, 'kept' AS status FROM s4),
  stt AS (SELECT h.image_id, h.hypothesis_id, CASE WHEN kp.status IS NOT NULL THEN 'kept' WHEN el.image_id IS NOT NULL THEN 'beam_width' WHEN co.image_id IS NOT NULL THEN 'bit_margin' WHEN cs.scan IS NOT NULL THEN cs.scan ELSE 'delivery_equivalent' END AS status
    FROM hyp h LEFT JOIN cs USING (image_id, hypothesis_id) LEFT JOIN co USING (image_id, hypothesis_id) LEFT JOIN el USING (image_id, hypothesis_id) LEFT JOIN kp USING (image_id, hypothesis_id))"""


@query("t02_diverse_beam", "hyp", f"RECURSIVE {BEAM_SQL} SELECT image_id, hypothesis_id, status FROM stt")
def t02(t):
    return H.diverse_beam(t.hyp(), BEAM).select("image_id", "hypothesis_id", "status")


STATUSES = ["kept", "beam_width", "bit_margin", "memory_budget", "candidate_budget", "delivery_equivalent"]


@query(
    "t02_beam_ledger",
    "hyp",
    f"RECURSIVE {BEAM_SQL} SELECT image_id, count(*) AS presented, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES) + " FROM stt GROUP BY image_id",
)
def t02b(t):
    return H.status_ledger(H.diverse_beam(t.hyp(), BEAM), "image_id", STATUSES)


ENV_SQL = """pr AS (SELECT l_suppkey AS image_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT, l_quantity::BIGINT) AS candidate_id, 'g' || (l_partkey % 90) AS digest, l_quantity > 2 AS valid,
     l_partkey % 90 + 40 * l_discount AS lower, CASE WHEN l_linenumber = 7 THEN l_partkey % 90 + 8 END AS achievable, ['sig:' || l_returnflag, 'field:' || (l_partkey % 3), 'conn:' || l_linestatus] AS classes FROM lineitem),
  v AS (SELECT *, row_number() OVER (PARTITION BY image_id, digest ORDER BY candidate_id) AS d FROM pr WHERE valid), uq AS (SELECT *, min(achievable) OVER (PARTITION BY image_id) AS best FROM v WHERE d = 1),
  al AS (SELECT * FROM uq WHERE NOT coalesce(best < lower, false)), qc AS (SELECT image_id, digest, lower, unnest(classes) AS c FROM al),
  qt AS (SELECT DISTINCT image_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY image_id, c ORDER BY lower, digest) AS r FROM qc) WHERE r <= 2),
  nq AS (SELECT image_id, count(*) AS n FROM qt GROUP BY 1),
  fl AS (SELECT image_id, digest FROM (SELECT al.image_id, al.digest, row_number() OVER (PARTITION BY al.image_id ORDER BY lower, al.digest) AS r FROM al ANTI JOIN qt USING (image_id, digest)) LEFT JOIN nq USING (image_id) WHERE r + coalesce(n, 0) <= 12)"""


def envelope_rows(t):
    p = F.col("l_partkey")
    return t.table("lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", p, F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.rint("l_quantity").cast("bigint")).alias("candidate_id"),
        F.concat(F.lit("g"), p % 90).alias("digest"), (F.col("l_quantity") > 2).alias("valid"), (p % 90 + F.col("l_discount") * 40).alias("lower"),
        F.when(F.col("l_linenumber") == 7, p % 90 + 8).alias("achievable"),
        F.array(F.concat(F.lit("sig:"), "l_returnflag"), F.concat(F.lit("field:"), p % 3), F.concat(F.lit("conn:"), "l_linestatus")).alias("classes"),
    )


@query(
    "t03_envelope_prune",
    "",
    f"""{ENV_SQL}, k AS (SELECT * FROM qt UNION SELECT * FROM fl)
    SELECT pr.image_id, pr.candidate_id, CASE WHEN NOT pr.valid THEN 'invalid' WHEN uq.image_id IS NULL THEN 'duplicate' WHEN al.image_id IS NULL THEN 'dominated' WHEN k.image_id IS NULL THEN 'budget' ELSE 'kept' END AS status
    FROM pr LEFT JOIN uq USING (image_id, candidate_id) LEFT JOIN al USING (image_id, candidate_id) LEFT JOIN k ON k.image_id = pr.image_id AND k.digest = pr.digest""",
)
def t03(t):
    return H.prune_envelope(envelope_rows(t), F.col("classes"), H.EnvelopeConfig(budget=12)).select("image_id", "candidate_id", "status")


@query("w12_quota_rank", "", f"{ENV_SQL} SELECT image_id, digest FROM (SELECT DISTINCT image_id, digest FROM (SELECT image_id, digest, row_number() OVER (PARTITION BY image_id, c ORDER BY lower, digest) AS r FROM (SELECT image_id, digest, min(lower) AS lower, substr(digest, 2)::INT % 3 AS c FROM pr GROUP BY image_id, digest)) WHERE r <= 2)")
def w12(t):
    rows = envelope_rows(t).groupBy("image_id", "digest").agg(F.min("lower").alias("lower"))
    cls = F.array(F.concat(F.lit("field:"), F.substring("digest", 2, 9).cast("int") % 3))
    return H.quota_keep(rows, "image_id", cls, "lower", "digest", 2)


EV_SQL = "ev AS (SELECT l_suppkey * 10 + l_linenumber AS image_id, l_returnflag AS kind, (l_partkey % 23 * 22 % 513) / 512.0::DOUBLE AS level, l_discount AS persistence FROM lineitem)"
PL_SQL = "mk AS (SELECT DISTINCT image_id, floor(level * 512 + 0.5)::INT AS q FROM ev UNION SELECT image_id, 0 FROM ev UNION SELECT image_id, 512 FROM ev), nx AS (SELECT *, lead(q) OVER (PARTITION BY image_id ORDER BY q) AS hi FROM mk), pl AS (SELECT image_id, q / 512.0::DOUBLE AS lo, hi / 512.0::DOUBLE AS hi, floor((q + hi) / 2.0 + 0.5)::INT AS representative FROM nx WHERE hi > q + 1)"


def crit_events(t):
    p = F.col("l_partkey")
    return t.table("lineitem").select(
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("image_id"), F.col("l_returnflag").alias("kind"),
        (p % 23 * 22 % 513 / 512.0).alias("level"), F.col("l_discount").alias("persistence"),
    )


@query("w10_plateaus", "", f"{EV_SQL}, {PL_SQL} SELECT image_id, lo, hi, representative FROM pl")
def w10(t):
    return H.plateaus(crit_events(t))


@query(
    "t04_candidate_levels",
    "",
    f"""{EV_SQL}, {PL_SQL}, a AS (SELECT image_id, representative AS q, 'persistence_plateau' AS origin, hi - lo AS persistence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY hi - lo DESC, lo) AS r FROM pl) WHERE r <= 6),
    e AS (SELECT image_id, floor(level * 512 + 0.5)::INT AS q, persistence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY persistence DESC, level, kind) AS r FROM ev WHERE persistence >= 0.02) WHERE r <= 8),
    x AS (SELECT * FROM a UNION ALL SELECT image_id, q + 1, 'before_event', persistence FROM e UNION ALL SELECT image_id, greatest(q - 1, 0), 'after_event', persistence FROM e UNION ALL SELECT DISTINCT image_id, 256, 'fixed_smoke', 0.0 FROM ev)
    SELECT image_id, q, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, round(max(persistence), 6) AS persistence FROM x WHERE q > 0 AND q < 512 GROUP BY image_id, q""",
)
def t04(t):
    d = H.candidate_levels(crit_events(t))
    return d.select("image_id", "q", F.array_join("origins", ",").alias("origins"), r6(F.col("persistence"), "persistence"))


@query(
    "t05_policy_search",
    "meas",
    """r AS (SELECT group_id, quantity AS a, palette_delta * 100 + group_id % 97 AS b, palette_delta >= 9 AND channel_delta >= 7 AND quantity > 20 AS bad FROM meas), lv AS (SELECT DISTINCT a AS level FROM r),
    st AS (SELECT level, max(b) FILTER (WHERE NOT bad) AS f, min(b) FILTER (WHERE bad) AS fb FROM lv JOIN r ON a <= level GROUP BY level),
    sf AS (SELECT level, max(b) AS b FROM st JOIN r ON a <= level AND NOT bad AND b < fb GROUP BY level), gd AS (SELECT level AS x, f AS y FROM st WHERE f IS NOT NULL UNION SELECT level, b FROM sf),
    sc AS (SELECT x, y, count(DISTINCT group_id) AS ga, count(DISTINCT CASE WHEN bad THEN group_id END) AS gc, count(*) AS ra FROM gd JOIN r ON a <= x AND b <= y GROUP BY x, y),
    e AS (SELECT *, (SELECT count(DISTINCT group_id) FROM r) AS gt, (SELECT count(*) FROM r) AS rt FROM sc), o AS (SELECT *, gc = 0 AND ga >= 459 AND ga / gt::DOUBLE >= 0.2 AND ra / rt::DOUBLE >= 0.1 AS ok FROM e),
    bst AS (SELECT x, y FROM o WHERE ok ORDER BY ra DESC, ga DESC, x, y LIMIT 1)
    SELECT x AS max_first, y AS max_second, ga AS groups_accepted, gc AS groups_catastrophic, ra AS renders_accepted, gt AS groups_total, rt AS renders_total, round(ga / gt::DOUBLE, 6) AS source, round(ra / rt::DOUBLE, 6) AS render, ok AS eligible,
      (x, y) IN (SELECT (x, y) FROM bst) AS chosen FROM o""",
)
def t05(t):
    bad = (F.col("palette_delta") >= 9) & (F.col("channel_delta") >= 7) & (F.col("quantity") > 20)
    rows = t.meas().select("group_id", F.col("quantity").alias("p"), (F.col("palette_delta") * 100 + F.col("group_id") % 97).alias("s"), bad.alias("bad"))
    grid = H.policy_grid(rows, "p", "s", "bad")
    d = H.choose_policy(H.score_policies(rows, grid, "p", "s", "bad"), 459, 0.2, 0.1)
    return d.withColumns({"source": F.round("source", 6), "render": F.round("render", 6)})


@query(
    "a69_ambiguity_retention",
    "hyp",
    """c AS (SELECT image_id, topology_class || formation_class AS class_id, bool_or(memory_bytes > 25) AS event_driven FROM hyp GROUP BY ALL), sg AS (SELECT image_id, arg_min(topology_class || formation_class, (total_bits, hypothesis_id)) AS class_id FROM hyp GROUP BY 1),
    p AS (SELECT a.image_id AS a, b.image_id AS b, a.class_id AS sig_a, b.class_id AS sig_b FROM sg a JOIN sg b ON b.image_id = a.image_id + 1),
    k AS (SELECT p.*, (SELECT count(*) FROM c WHERE image_id = p.a AND class_id IN (sig_a, sig_b)) AS na, (SELECT count(*) FROM c WHERE image_id = p.b AND class_id IN (sig_a, sig_b)) AS nb,
       (SELECT count(*) FROM c WHERE image_id = p.a AND NOT event_driven AND class_id IN (sig_a, sig_b)) AS fa, (SELECT count(*) FROM c WHERE image_id = p.b AND NOT event_driven AND class_id IN (sig_a, sig_b)) AS fb FROM p)
    SELECT a, b, sig_a, sig_b, sig_a <> sig_b AS is_topology_pair, CASE WHEN sig_a <> sig_b THEN na = 2 END AS retained_from_a, CASE WHEN sig_a <> sig_b THEN nb = 2 END AS retained_from_b,
      CASE WHEN sig_a <> sig_b THEN fa = 2 END AS fixed_only_from_a, CASE WHEN sig_a <> sig_b THEN fb = 2 END AS fixed_only_from_b FROM k""",
)
def a69(t):
    h = t.hyp().withColumn("class_id", F.concat("topology_class", "formation_class"))
    classes = h.groupBy("image_id", "class_id").agg(F.bool_or(F.col("memory_bytes") > 25).alias("event_driven"))
    sig = h.groupBy("image_id").agg(F.min_by("class_id", F.struct("total_bits", "hypothesis_id")).alias("class_id"))
    ids = sig.select(F.col("image_id").alias("a"))
    pairs = ids.join(ids.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    return H.ambiguity_retention(pairs, classes, sig)


SUP_SQL = """su AS (SELECT image_id || '/low' AS score_id, image_id, x, y FROM px8s WHERE alpha < 0.3 UNION ALL SELECT image_id || '/high', image_id, x, y FROM px8s WHERE alpha > 0.6 UNION ALL SELECT image_id || '/mid', image_id, x, y FROM px8s WHERE alpha BETWEEN 0.2 AND 0.7),
  so AS (SELECT image_id || '/' || k AS score_id, image_id, CASE WHEN k = 'mid' AND image_id % 3 = 0 THEN 'prior' ELSE 'evidence' END AS role, (image_id % 10 + len(k))::DOUBLE AS value FROM (SELECT DISTINCT image_id FROM px8s) CROSS JOIN (SELECT unnest(['low', 'high', 'mid']) AS k)),
  rq AS (SELECT image_id || '/low' AS a, image_id || '/high' AS b FROM (SELECT DISTINCT image_id FROM px8s) UNION ALL SELECT image_id || '/low', image_id || '/mid' FROM (SELECT DISTINCT image_id FROM px8s) UNION ALL SELECT image_id || '/high', (image_id + 1) || '/low' FROM (SELECT DISTINCT image_id FROM px8s WHERE image_id + 1 IN (SELECT image_id FROM px8s))),
  sh AS (SELECT a, b, count(*) AS n FROM rq JOIN su p ON p.score_id = a JOIN su q ON q.score_id = b AND q.image_id = p.image_id AND q.x = p.x AND q.y = p.y GROUP BY a, b)"""


def support_tables(t):
    px = t.px8s()
    sid = lambda k: F.concat(F.col("image_id"), F.lit(f"/{k}"))
    part = lambda k, cond: px.filter(cond).select(sid(k).alias("score_id"), "image_id", "x", "y")
    supports = part("low", "alpha < 0.3").unionByName(part("high", "alpha > 0.6")).unionByName(part("mid", "alpha between 0.2 and 0.7"))
    ids = px.select("image_id").distinct()
    kinds = F.explode(F.array(F.lit("low"), F.lit("high"), F.lit("mid")))
    scores = ids.select("image_id", kinds.alias("k")).select(
        F.concat(F.col("image_id"), F.lit("/"), F.col("k")).alias("score_id"), "image_id",
        F.when((F.col("k") == "mid") & (F.col("image_id") % 3 == 0), "prior").otherwise("evidence").alias("role"),
        (F.col("image_id") % 10 + F.length("k")).cast("double").alias("value"),
    )
    nxt = ids.join(ids.select((F.col("image_id") - 1).alias("image_id")), "image_id")
    req = ids.select(sid("low").alias("a"), sid("high").alias("b")).unionByName(ids.select(sid("low").alias("a"), sid("mid").alias("b")))
    req = req.unionByName(nxt.select(sid("high").alias("a"), F.concat(F.col("image_id") + 1, F.lit("/low")).alias("b")))
    return req, scores, supports


@query("j14_support_overlap", "px8s", f"{SUP_SQL} SELECT a, b, coalesce(n, 0) AS shared FROM rq LEFT JOIN sh USING (a, b)")
def j14(t):
    req, _, supports = support_tables(t)
    return H.support_overlap(req, supports)


@query(
    "a70_additive_scores",
    "px8s",
    f"""{SUP_SQL}, z AS (SELECT rq.a, rq.b, coalesce(n, 0) AS shared, p.value + q.value AS v, CASE WHEN p.image_id <> q.image_id THEN 'different_images' WHEN p.role <> q.role THEN 'different_roles' WHEN coalesce(n, 0) > 0 THEN 'shared_pixels' END AS refusal
      FROM rq LEFT JOIN sh USING (a, b) JOIN so p ON p.score_id = rq.a JOIN so q ON q.score_id = rq.b) SELECT a, b, shared, refusal, CASE WHEN refusal IS NULL THEN v END AS total FROM z""",
)
def a70(t):
    return H.add_disjoint(*support_tables(t))


@query(
    "a71_partition_truth",
    "segments",
    """ar AS (SELECT s.chain_id, 0.5 * (sum(x1 * y2 - x2 * y1) + max(e.px * f.py - f.px * e.py)) AS area FROM segments s JOIN (SELECT chain_id, arg_max(px, k) AS px, arg_max(py, k) AS py FROM chain GROUP BY 1) e USING (chain_id)
      JOIN (SELECT chain_id, arg_min(px, k) AS px, arg_min(py, k) AS py FROM chain GROUP BY 1) f USING (chain_id) GROUP BY s.chain_id),
    fc AS (SELECT chain_id % 5 AS scene_id, chain_id % 4 AS face_id, chain_id % 4 = 0 AS exterior, 'c' || (chain_id % 4 % 3) AS paint, sum(area) AS a, count(*) FILTER (WHERE area < 0 AND chain_id % 4 <> 0) AS h FROM ar GROUP BY ALL)
    SELECT scene_id, count(*) FILTER (WHERE NOT exterior) AS visible_faces, sum(h)::BIGINT AS holes, count(DISTINCT CASE WHEN NOT exterior THEN paint END) AS palette, round(sum(CASE WHEN NOT exterior THEN a ELSE 0 END), 3) AS total_ink FROM fc GROUP BY scene_id""",
)
def a71(t):
    c = F.col("chain_id")
    loops = signed_area(t.chain(), ["chain_id"], "k").select(
        (c % 5).alias("scene_id"), (c % 4).alias("face_id"), (c % 4 == 0).alias("exterior"), F.concat(F.lit("c"), c % 4 % 3).alias("paint"), "area"
    )
    return H.partition_truth(loops).withColumn("total_ink", F.round("total_ink", 3))
