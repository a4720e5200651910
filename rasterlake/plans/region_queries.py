"""Regions, adjacency, signatures, lattice boundaries and skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import fields as W, regions as R
from rasterlake.plans.field_queries import thin_sql
from rasterlake.plans.functions_queries import r6
from rasterlake.plans.raster_sql import EIGHT, FOUR, nb
from rasterlake.registry import query


def cc(src: str, out: str, label: str, conn: int) -> str:
    """Recursive flood of every pixel; region = least reached pixel id."""
    near = "abs(p.x - c.x) + abs(p.y - c.y) = 1" if conn == 4 else "greatest(abs(p.x - c.x), abs(p.y - c.y)) = 1"
    return f"""{out}_c(image_id, s, x, y, l) AS (SELECT image_id, y::BIGINT * 1048576 + x, x, y, {label} FROM {src} WHERE {label} IS NOT NULL
      UNION SELECT c.image_id, c.s, p.x, p.y, c.l FROM {out}_c c JOIN {src} p ON p.image_id = c.image_id AND p.{label} = c.l AND {near}),
    {out} AS (SELECT image_id, x, y, any_value(l) AS {label}, min(s)::BIGINT AS region FROM {out}_c GROUP BY image_id, x, y)"""


@query("r01_regions_8", "bin8", f"RECURSIVE f AS (SELECT image_id, x, y, 1 AS label FROM bin8 WHERE inside), {cc('f', 'rg', 'label', 8)} SELECT image_id, x, y, region FROM rg")
def r01(t):
    px = t.bin8().withColumn("label", F.when(F.col("inside"), 1))
    return R.regions(px, "label", 8).select("image_id", "x", "y", "region")


@query("r01_regions_4", "labels4", f"RECURSIVE {cc('labels4', 'rg', 'label', 4)} SELECT image_id, x, y, label, region FROM rg")
def r01b(t):
    return R.regions(t.labels4(), "label", 4).select("image_id", "x", "y", "label", "region")


@query("r01_region_sizes", "grid", None)
def r01c(t):
    px = t.grid().withColumn("label", F.floor(F.col("v") * 4).cast("int"))
    return R.region_sizes(px, "label", 4)


RIM = "(x = 0)::INT + (y = 0)::INT + (x = 7)::INT + (y = 7)::INT"
RAG = f"""{cc('labels4', 'rg', 'label', 4)}, nd AS (SELECT image_id, region, any_value(label) AS label, count(*) AS pixels, sum({RIM})::BIGINT AS border_segments, false AS is_exterior FROM rg GROUP BY image_id, region),
  nr AS (SELECT * FROM nd UNION ALL SELECT DISTINCT image_id, -1, NULL, 0, 32, true FROM rg),
  pr AS (SELECT a.image_id, a.region AS p, b.region AS q FROM rg a JOIN rg b ON b.image_id = a.image_id AND b.region <> a.region AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))),
  eg AS (SELECT image_id, least(p, q) AS a, greatest(p, q) AS b, count(*)::BIGINT AS shared_segments FROM pr GROUP BY ALL UNION ALL SELECT image_id, -1, region, border_segments FROM nd WHERE border_segments > 0)"""


@query("r05_rag_nodes", "labels4", f"RECURSIVE {RAG} SELECT image_id, region, label, pixels, border_segments, is_exterior FROM nr")
def r05(t):
    return R.adjacency_graph(t.labels4())[0]


@query("r05_rag_edges", "labels4", f"RECURSIVE {RAG} SELECT image_id, a, b, shared_segments FROM eg")
def r05b(t):
    return R.adjacency_graph(t.labels4())[1]


EXT = f"""{cc('labels4', 'r0', 'label', 4)}, rim AS (SELECT DISTINCT image_id, region FROM r0 WHERE label = 1 AND {RIM} > 0), mn AS (SELECT image_id, min(region) AS m FROM rim GROUP BY 1),
  rg AS (SELECT r0.image_id, x, y, label, CASE WHEN rim.region IS NOT NULL THEN mn.m ELSE r0.region END AS region FROM r0 LEFT JOIN rim ON rim.image_id = r0.image_id AND rim.region = r0.region LEFT JOIN mn ON mn.image_id = r0.image_id)"""


@query(
    "r05_rag_with_exterior",
    "labels4",
    f"""RECURSIVE {EXT}, g AS (SELECT image_id, region, any_value(label) AS label, count(*) AS pixels, sum({RIM})::BIGINT AS border_segments FROM rg GROUP BY image_id, region), x AS (SELECT image_id, min(region) AS ext FROM g WHERE label = 1 GROUP BY 1)
    SELECT g.image_id, region, label, pixels, border_segments, coalesce(region = ext, false) AS is_exterior FROM g LEFT JOIN x USING (image_id) UNION ALL SELECT image_id, -1, NULL, 0, 32, true FROM (SELECT DISTINCT image_id FROM g) ANTI JOIN x USING (image_id)""",
)
def r05c(t):
    return R.adjacency_graph(t.labels4(), exterior=1)[0]


@query("r06_region_neighbours", "labels4", f"RECURSIVE {RAG} SELECT image_id, a AS region, b AS neighbour FROM eg UNION ALL SELECT image_id, b, a FROM eg")
def r06(t):
    return R.region_neighbours(R.adjacency_graph(t.labels4())[1])


def sig_sql(src: str, conn: int, out: str = "sg") -> str:
    return f"""{out}_f AS (SELECT image_id, x, y, 1 AS label FROM {src} WHERE inside), {cc(f'{out}_f', f'{out}_fg', 'label', conn)}, {out}_b AS (SELECT image_id, x, y, 1 AS label FROM {src} WHERE NOT inside), {cc(f'{out}_b', f'{out}_bg', 'label', 12 - conn)},
    {out}_n AS (SELECT image_id, count(DISTINCT region) AS c FROM {out}_fg GROUP BY 1), {out}_h AS (SELECT image_id, count(*) AS h FROM (SELECT image_id, region FROM {out}_bg GROUP BY 1, 2 HAVING NOT bool_or({RIM} > 0)) GROUP BY 1),
    {out} AS (SELECT i.image_id, coalesce(c, 0) AS components, coalesce(h, 0) AS holes FROM (SELECT DISTINCT image_id FROM {src}) i LEFT JOIN {out}_n USING (image_id) LEFT JOIN {out}_h USING (image_id))"""


@query("r07_signature_4", "bin8", f"RECURSIVE {sig_sql('bin8', 4)} SELECT image_id, components, holes, components - holes AS euler FROM sg")
def r07(t):
    return R.signature(t.bin8(), 4).select("image_id", "components", "holes", "euler")


@query("r07_signature_8", "bin8", f"RECURSIVE {sig_sql('bin8', 8)} SELECT image_id, components, holes, components - holes AS euler FROM sg")
def r07b(t):
    return R.signature(t.bin8(), 8).select("image_id", "components", "holes", "euler")


QUAD = "(CASE WHEN inside THEN 1 ELSE 0 END)"


@query("a28_euler_number", "bin8", f"RECURSIVE {sig_sql('bin8', 4)}, {sig_sql('bin8', 8, 's8')} SELECT sg.image_id, (sg.components - sg.holes)::BIGINT AS euler_4, (s8.components - s8.holes)::BIGINT AS euler_8 FROM sg JOIN s8 USING (image_id)")
def a28(t):
    a, b = R.euler_number(t.bin8(), 4).withColumnRenamed("euler", "euler_4"), R.euler_number(t.bin8(), 8).withColumnRenamed("euler", "euler_8")
    return a.join(b, "image_id")


CURVE = [64, 128, 192, 256, 320, 384, 448]


@query(
    "a28_euler_curve",
    "grid",
    f"""b AS (SELECT image_id, lv AS level, x, y, (floor(v * 512 + 0.5) >= lv)::INT AS i FROM grid CROSS JOIN (SELECT unnest({CURVE}) AS lv)),
    p AS (SELECT *, lead(i) OVER (PARTITION BY image_id, level, y ORDER BY x) AS e, lead(i) OVER (PARTITION BY image_id, level, x ORDER BY y) AS s FROM b), q AS (SELECT *, lead(e) OVER (PARTITION BY image_id, level, x ORDER BY y) AS se FROM p)
    SELECT image_id, level, sum(i - i * coalesce(e, 0) - i * coalesce(s, 0) + i * coalesce(e, 0) * coalesce(s, 0) * coalesce(se, 0))::BIGINT AS euler FROM q GROUP BY image_id, level""",
)
def a28b(t):
    return R.euler_curve(t.grid(), "v", CURVE, 4)


@query("r08_persistence_events", "px8s", None)
def r08(t):
    return R.persistence_events(t.px8s(), "alpha", 4)


@query("r08_tie_batches", "px8s", "b AS (SELECT image_id, floor(alpha * 512 + 0.5) AS q, count(*) AS n FROM px8s GROUP BY 1, 2) SELECT image_id, count(*) FILTER (WHERE n > 1) AS tie_batches, max(n) AS largest_batch_pixels FROM b GROUP BY 1")
def r08b(t):
    return R.tie_batches(t.px8s(), "alpha")


@query(
    "r09_cost_bounds",
    "px8s",
    """b AS (SELECT *, alpha >= 0.4 AS inside, least(1.0, alpha * 1.1) AS pred FROM px8s)
    SELECT image_id, round(sum(CASE WHEN inside THEN pow(greatest(0.5 - alpha, 0), 2) ELSE pow(greatest(alpha - 0.5, 0), 2) END), 6) AS lower, CASE WHEN bool_and((pred >= 0.5) = inside) THEN round(sum(pow(pred - alpha, 2)), 6) END AS achievable FROM b GROUP BY 1""",
)
def r09(t):
    px = t.px8s().withColumns({"inside": F.col("alpha") >= 0.4, "pred": F.least(F.lit(1.0), F.col("alpha") * 1.1)})
    d = R.cost_bounds(px, 0.5, predicted="pred")
    return d.select("image_id", r6(F.col("lower"), "lower"), r6(F.col("achievable"), "achievable"))


@query(
    "r10_topology_code_bits",
    "bin8",
    f"""RECURSIVE {sig_sql('bin8', 4)}, {nb('bin8', 'nn', ['inside'], clamp=False)}, st AS (SELECT image_id, sum((inside <> coalesce(e_inside, false))::INT + (inside <> coalesce(s_inside, false))::INT + (x = 0 AND inside)::INT + (y = 0 AND inside)::INT)::BIGINT AS steps FROM nn GROUP BY 1)
    SELECT image_id, steps, round(log2(components + 1.0::DOUBLE) + log2(holes + 1.0::DOUBLE) + (components + holes) * 6 + steps * log2(3.0::DOUBLE), 6) AS bits FROM st JOIN sg USING (image_id)""",
)
def r10(t):
    d = R.code_bits(t.bin8(), R.signature(t.bin8(), 4))
    return d.withColumn("bits", F.round("bits", 6))


OPT = "opt AS (SELECT image_id, x, y, label, 0.25 + alpha / 2 AS weight, alpha FROM labels4 JOIN px8 USING (image_id, x, y))"


@query(
    "r11_pruned_regions",
    "labels4",
    f"""RECURSIVE {OPT}, {cc('labels4', 'rg', 'label', 4)}, j AS (SELECT opt.*, region FROM opt JOIN rg USING (image_id, x, y)), {nb('j', 'nj', ['region', 'label'], clamp=False)},
    co AS (SELECT image_id, region, sum(CASE WHEN (coalesce(e_region = region, false) OR coalesce(w_region = region, false)) AND (coalesce(n_region = region, false) OR coalesce(s_region = region, false)) THEN weight ELSE 0 END) AS c FROM nj GROUP BY ALL),
    wk AS (SELECT image_id, region FROM co WHERE c < 3), tc AS (SELECT image_id, region, label, unnest([e_label, w_label, n_label, s_label]) AS cand FROM nj JOIN wk USING (image_id, region)),
    sh AS (SELECT image_id, region, cand, count(*) AS shared FROM tc WHERE cand <> label GROUP BY ALL),
    ct AS (SELECT sh.image_id, sh.region, cand, round(sum(weight * pow(code - (64 * cand + 32), 2) / 65025.0) - any_value(shared) * 0.25, 9) AS cost FROM sh JOIN j USING (image_id, region) JOIN px8 p ON p.image_id = j.image_id AND p.x = j.x AND p.y = j.y GROUP BY sh.image_id, sh.region, cand),
    pk AS (SELECT image_id, region, arg_min(cand, (cost, cand)) AS pick FROM ct GROUP BY ALL)
    SELECT j.image_id, x, y, label, coalesce(pick, label) AS pruned FROM j LEFT JOIN pk USING (image_id, region)""",
)
def r11(t):
    px = t.px8()
    option = lambda k: F.struct(F.lit(k).alias("label"), ((F.col("code") - (64 * k + 32)) * (F.col("code") - (64 * k + 32))).alias("d2"))
    d = px.select(
        "image_id", "x", "y", F.least(F.lit(3), F.floor(F.col("alpha") * 4).cast("int")).alias("label"), (F.col("alpha") / 2 + 0.25).alias("weight"),
        F.array(*[option(k) for k in range(4)]).alias("options"),
    )
    return R.prune_unsupported(d, 3.0).select("image_id", "x", "y", "label", "pruned")


# one merge per image: the region of pixel (0,0) keeps, the region of (3,3) goes
EDIT = f"{RAG}, ed AS (SELECT a.image_id, a.region AS keep, CASE WHEN a.image_id % 7 = 0 THEN 99999999 ELSE b.region END AS remove, a.label AS lab FROM rg a JOIN rg b USING (image_id) WHERE a.x = 0 AND a.y = 0 AND b.x = 3 AND b.y = 3), ju AS (SELECT ed.*, CASE WHEN n.region IS NULL THEN 'unknown_region' WHEN eg.a IS NULL THEN 'not_adjacent' END AS refusal FROM ed LEFT JOIN nd n ON n.image_id = ed.image_id AND n.region = remove LEFT JOIN eg ON eg.image_id = ed.image_id AND eg.a = least(keep, remove) AND eg.b = greatest(keep, remove))"


def merge_edits(t):
    reg = R.regions(t.labels4())
    at = lambda x, n: reg.filter((F.col("x") == x) & (F.col("y") == x)).select("image_id", F.col("region").alias(n))
    e = at(0, "keep").join(at(3, "remove"), "image_id")
    return e.withColumn("remove", F.when(F.col("image_id") % 7 == 0, F.lit(99999999).cast("bigint")).otherwise(F.col("remove")))


@query("r12_merge_ledger", "labels4", f"RECURSIVE {EDIT} SELECT ju.image_id, keep, remove, refusal, CASE WHEN refusal IS NULL THEN (SELECT count(*) FROM rg WHERE rg.image_id = ju.image_id AND rg.region = ju.remove) ELSE 0 END AS affected_pixels FROM ju")
def r12(t):
    return R.merge_regions(t.labels4(), merge_edits(t))[1]


@query("r12_merged_labels", "labels4", f"RECURSIVE {EDIT} SELECT rg.image_id, x, y, CASE WHEN ju.refusal IS NULL AND rg.region = ju.remove THEN ju.lab ELSE rg.label END AS label FROM rg JOIN ju USING (image_id)")
def r12b(t):
    return R.merge_regions(t.labels4(), merge_edits(t))[0]


@query(
    "r12_split_ledger",
    "labels4",
    f"""RECURSIVE {cc('labels4', 'rg', 'label', 4)}, tg AS (SELECT image_id, region AS target FROM rg WHERE x = 4 AND y = 4), mv AS (SELECT image_id, target, CASE WHEN image_id % 9 = 0 THEN 2 ELSE 9 END AS new_label, x, y FROM rg JOIN tg USING (image_id) WHERE (region = target AND x <= 4) OR (image_id % 11 = 0 AND x = 0 AND y = 0)),
    su AS (SELECT rg.image_id, rg.x, rg.y, (mv.x IS NOT NULL)::INT AS m FROM rg JOIN tg ON tg.image_id = rg.image_id AND rg.region = tg.target LEFT JOIN mv ON mv.image_id = rg.image_id AND mv.x = rg.x AND mv.y = rg.y), {cc('su', 'pc', 'm', 4)},
    fa AS (SELECT mv.image_id, any_value(new_label) AS nl, count(DISTINCT (mv.x, mv.y)) AS asked, (SELECT count(*) FROM su WHERE su.image_id = mv.image_id) AS size, (SELECT count(*) FROM su WHERE su.image_id = mv.image_id AND m = 1) AS hit,
      (SELECT count(DISTINCT region) FROM pc WHERE pc.image_id = mv.image_id) AS pieces FROM mv GROUP BY mv.image_id),
    z AS (SELECT fa.*, CASE WHEN (SELECT count(*) FROM rg WHERE rg.image_id = fa.image_id AND rg.label = nl) > 0 THEN 'label_already_present' WHEN hit <> asked THEN 'pixel_outside_region' WHEN asked >= size THEN 'not_a_strict_subset' WHEN pieces <> 2 THEN 'disconnected_split' END AS refusal FROM fa)
    SELECT image_id, refusal, CASE WHEN refusal IS NULL THEN asked ELSE 0 END AS affected_pixels FROM z""",
)
def r12c(t):
    reg = R.regions(t.labels4())
    tgt = reg.filter("x = 4 and y = 4").select("image_id", F.col("region").alias("target"))
    moves = reg.join(tgt, "image_id").filter(((F.col("region") == F.col("target")) & (F.col("x") <= 4)) | ((F.col("image_id") % 11 == 0) & (F.col("x") == 0) & (F.col("y") == 0)))
    moves = moves.select("image_id", F.col("target").alias("region"), F.when(F.col("image_id") % 9 == 0, 2).otherwise(9).alias("new_label"), "x", "y")
    return R.split_regions(t.labels4(), moves)[1]


@query(
    "r12_assign_ledger",
    "labels4",
    """e AS (SELECT DISTINCT image_id, (image_id % 5)::INT AS to_label, image_id % 4 = 0 AS transparent FROM labels4), c AS (SELECT image_id, label AS to_label, count(*) AS n FROM labels4 GROUP BY ALL), z AS (SELECT e.*, n, CASE WHEN n IS NULL THEN 'unknown_label' WHEN to_label = 1 AND NOT transparent THEN 'opaque_exterior' WHEN to_label <> 1 AND transparent THEN 'transparent_interior' END AS refusal FROM e LEFT JOIN c USING (image_id, to_label))
    SELECT image_id, to_label, refusal, CASE WHEN refusal IS NULL THEN n ELSE 0 END AS affected_pixels FROM z""",
)
def r12d(t):
    e = t.labels4().select("image_id").distinct().select("image_id", (F.col("image_id") % 5).cast("int").alias("to_label"), (F.col("image_id") % 4 == 0).alias("transparent"))
    return R.assign_paint(t.labels4(), e, exterior=1)


SCRIPT = [
    {"op": "merge", "keep": 0, "remove": 1}, {"op": "protect", "label": 3}, {"op": "merge", "keep": 2, "remove": 0},
    {"op": "restore", "checkpoint": 1}, {"op": "assign", "label": 2},
]


@query(
    "r13_edit_script",
    "bin8",
    """b AS (SELECT image_id, x, y, CASE WHEN y = 0 THEN 0 WHEN y = 1 THEN 1 WHEN y >= 6 THEN 3 WHEN inside AND image_id % 3 = 0 THEN 1 ELSE 2 END AS label FROM bin8),
    c AS (SELECT image_id, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 2) AS n2 FROM b GROUP BY 1)
    SELECT image_id, n0 + n1 AS first_two, n2 FROM c""",
)
def r13(t):
    label = F.when(F.col("y") == 0, 0).when(F.col("y") == 1, 1).when(F.col("y") >= 6, 3).when(F.col("inside") & (F.col("image_id") % 3 == 0), 1).otherwise(2)
    px = t.bin8().select("image_id", "x", "y", label.alias("label"))
    final, _ = R.run_script(px, SCRIPT)
    d = final.groupBy("image_id")
    return d.agg(F.count_if(F.col("label").isin(0, 1)).alias("first_two"), F.count_if(F.col("label") == 2).alias("n2"))


@query("r13_edit_script_ledger", "bin8", None)
def r13b(t):
    label = F.when(F.col("y") == 0, 0).when(F.col("y") == 1, 1).when(F.col("y") >= 6, 3).when(F.col("inside") & (F.col("image_id") % 3 == 0), 1).otherwise(2)
    return R.run_script(t.bin8().select("image_id", "x", "y", label.alias("label")), SCRIPT)[1]


# by image: a script that runs, a label in two places, labels that do not touch, a missing label, another base scene
LAYOUT_SQL = """ly AS (SELECT image_id, x, y, image_id % 5 AS kind, CASE WHEN image_id % 5 = 1 AND x = 4 AND y = 4 THEN 1 WHEN image_id % 5 = 2 AND y = 7 THEN 1 WHEN y = 0 THEN 0 WHEN y = 1 AND image_id % 5 NOT IN (2, 3) THEN 1 WHEN y >= 6 THEN 3 ELSE 2 END AS label FROM bin8)"""
EDITS = [
    {"op": "protect", "label": 3}, {"op": "merge", "keep": 0, "remove": 1}, {"op": "split", "label": 2, "move": "y >= 4", "new_label": 5}, {"op": "assign", "label": 5},
    {"op": "restore", "checkpoint": 2}, {"op": "split", "label": 2, "move": "x < 3", "new_label": 6},
]


def edited(t):
    kind, x, y = F.col("image_id") % 5, F.col("x"), F.col("y")
    label = F.when((kind == 1) & (x == 4) & (y == 4), 1).when((kind == 2) & (y == 7), 1).when(y == 0, 0).when((y == 1) & ~kind.isin(2, 3), 1).when(y >= 6, 3).otherwise(2)
    px = t.bin8().select("image_id", "x", "y", label.alias("label"))
    meant = R.scene_digest(px.withColumn("label", F.when((kind == 4) & (x == 0), 7).otherwise(F.col("label"))))
    return R.run_script(px, EDITS, base=meant)


@query("r13_script_pixels", "bin8", f"{LAYOUT_SQL} SELECT image_id, x, y, CASE WHEN kind <> 0 THEN label WHEN y <= 1 THEN 0 WHEN y >= 6 THEN 3 WHEN x < 3 THEN 6 ELSE 2 END AS label FROM ly")
def r13c(t):
    return edited(t)[0]


@query(
    "r13_script_ledger",
    "bin8",
    f"""{LAYOUT_SQL}, st(kind, step, op, refusal, changed) AS (VALUES (0, 0, 'protect', NULL, 0), (0, 1, 'merge', NULL, 8), (0, 2, 'split', NULL, 16), (0, 3, 'assign', NULL, 0), (0, 4, 'restore', NULL, 16), (0, 5, 'split', NULL, 12),
      (1, 0, 'protect', NULL, 0), (1, 1, 'merge', 'ambiguous_label', 0), (2, 0, 'protect', NULL, 0), (2, 1, 'merge', 'not_adjacent', 0), (3, 0, 'protect', NULL, 0), (3, 1, 'merge', 'unknown_label', 0), (4, -1, 'base', 'base_mismatch', 0))
    SELECT image_id, step, op, refusal, changed::BIGINT AS changed, kind = 0 AS script_applied FROM (SELECT DISTINCT image_id, kind FROM ly) JOIN st USING (kind)""",
)
def r13d(t):
    return edited(t)[1]


LATTICE = f"""{cc('labels4', 'rg', 'label', 4)}, lb AS (SELECT DISTINCT * FROM (
   SELECT a.image_id, a.x + 1 AS sx, a.y + 1 AS sy, a.x + 1 AS ex, a.y AS ey, b.region AS "left", a.region AS "right" FROM rg a JOIN rg b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1 AND b.region <> a.region
   UNION ALL SELECT a.image_id, a.x, a.y + 1, a.x + 1, a.y + 1, b.region, a.region FROM rg a JOIN rg b ON b.image_id = a.image_id AND b.x = a.x AND b.y = a.y + 1 AND b.region <> a.region
   UNION ALL SELECT image_id, x + 1, 0, x, 0, -1, region FROM rg WHERE y = 0 UNION ALL SELECT image_id, x, 8, x + 1, 8, -1, region FROM rg WHERE y = 7
   UNION ALL SELECT image_id, 0, y, 0, y + 1, -1, region FROM rg WHERE x = 0 UNION ALL SELECT image_id, 8, y + 1, 8, y, -1, region FROM rg WHERE x = 7))"""


@query("r14_lattice_boundaries", "labels4", f"RECURSIVE {LATTICE} SELECT image_id, sx, sy, ex, ey, lb.left, lb.right FROM lb")
def r14(t):
    return R.lattice_boundaries(t.labels4())


@query("r15_junctions", "labels4", f"RECURSIVE {LATTICE} SELECT image_id, x, y, count(*) AS degree FROM (SELECT image_id, sx AS x, sy AS y FROM lb UNION ALL SELECT image_id, ex, ey FROM lb) GROUP BY ALL HAVING count(*) <> 2")
def r15(t):
    return R.junctions(R.lattice_boundaries(t.labels4()))


LOOPS = f"""{LATTICE}, he AS (SELECT *, CASE WHEN ex - sx = 1 THEN 0 WHEN ey - sy = -1 THEN 1 WHEN ex - sx = -1 THEN 2 ELSE 3 END AS hd FROM (SELECT image_id, sx, sy, ex, ey, lb.left AS face FROM lb UNION ALL SELECT image_id, ex, ey, sx, sy, lb.right FROM lb)),
  hi AS (SELECT *, (sy::BIGINT * 1048576 + sx) * 4 + hd AS id FROM he), nx AS (SELECT a.image_id, a.face, a.id, arg_min(b.id, ((b.hd + 4 - a.hd) % 4, b.id)) AS nid FROM hi a JOIN hi b ON b.image_id = a.image_id AND b.face = a.face AND b.sx = a.ex AND b.sy = a.ey GROUP BY ALL),
  wk(image_id, face, st, id) AS (SELECT image_id, face, id, id FROM nx UNION SELECT w.image_id, w.face, w.st, n.nid FROM wk w JOIN nx n ON n.image_id = w.image_id AND n.face = w.face AND n.id = w.id),
  lp AS (SELECT image_id, face, st AS id, min(id) AS loop FROM wk GROUP BY image_id, face, st)"""


@query("r16_face_loops", "labels4", f"RECURSIVE {LOOPS} SELECT image_id, face, loop, count(*) AS edges, sum(sx * ey - ex * sy) / 2.0::DOUBLE AS signed_area FROM hi JOIN lp USING (image_id, face, id) GROUP BY image_id, face, loop")
def r16(t):
    return R.face_loops(R.lattice_boundaries(t.labels4()))


@query(
    "r17_integrity_audit",
    "labels4",
    f"""RECURSIVE {LATTICE}, bad AS (SELECT image_id, sx, sy, ex, ey, lb.left, CASE WHEN (sx + 3 * sy + image_id) % 41 = 0 THEN lb.left WHEN (sx + sy + image_id) % 53 = 0 THEN 777 ELSE lb.right END AS "right" FROM lb WHERE (sx * 5 + sy * 7 + ex + image_id) % 61 <> 0),
    fc AS (SELECT image_id, region AS face FROM rg GROUP BY ALL UNION SELECT DISTINCT image_id, -1 FROM rg), us AS (SELECT DISTINCT image_id, unnest([bad.left, bad.right]) AS face FROM bad)
    SELECT image_id, 'same_face_both_sides' AS rule, count(*) AS violations FROM bad WHERE bad.left = bad.right GROUP BY 1 UNION ALL SELECT image_id, 'unknown_face', count(*) FROM us ANTI JOIN fc USING (image_id, face) GROUP BY 1
    UNION ALL SELECT image_id, 'face_without_loop', count(*) FROM fc ANTI JOIN us USING (image_id, face) GROUP BY 1
    UNION ALL SELECT image_id, 'open_vertex', count(*) FROM (SELECT image_id, x, y FROM (SELECT image_id, sx AS x, sy AS y FROM bad UNION ALL SELECT image_id, ex, ey FROM bad) GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1""",
)
def r17(t):
    lb = R.lattice_boundaries(t.labels4())
    i, sx, sy = F.col("image_id"), F.col("sx"), F.col("sy")
    right = F.when((sx + sy * 3 + i) % 41 == 0, F.col("left")).when((sx + sy + i) % 53 == 0, F.lit(777).cast("bigint")).otherwise(F.col("right"))
    bad = lb.filter((sx * 5 + sy * 7 + F.col("ex") + i) % 61 != 0).withColumn("right", right)
    faces = R.regions(t.labels4()).select("image_id", F.col("region").alias("face")).distinct()
    faces = faces.unionByName(faces.select("image_id").distinct().withColumn("face", F.lit(R.OUTSIDE).cast("bigint")))
    loops = R.half_edges(bad).select("image_id", "face").distinct()
    return R.audit(bad, loops, faces)


# each sixth image is whole, the others have one kind of damage
AUDIT_SQL = f"""{LOOPS}, ar AS (SELECT hi.image_id, hi.id, sx, sy, ex, ey, hi.face, (ey::BIGINT * 1048576 + ex) * 4 + (hd + 2) % 4 AS twin, nid AS next, loop FROM hi JOIN nx ON nx.image_id = hi.image_id AND nx.face = hi.face AND nx.id = hi.id JOIN lp ON lp.image_id = hi.image_id AND lp.face = hi.face AND lp.id = hi.id),
  mu AS (SELECT image_id, id, sx, sy, ex, ey, CASE WHEN image_id % 6 = 4 AND id % 31 = 0 THEN face + 1 ELSE face END AS face, CASE WHEN image_id % 6 = 2 AND id % 41 = 0 THEN id ELSE twin END AS twin, CASE WHEN image_id % 6 = 1 AND id % 37 = 0 THEN twin ELSE next END AS next, CASE WHEN image_id % 6 = 3 AND id % 29 = 0 THEN loop + 1 ELSE loop END AS loop
    FROM ar WHERE NOT (image_id % 6 = 5 AND id % 43 = 0)),
  fc AS (SELECT image_id, region AS face FROM rg GROUP BY ALL UNION SELECT DISTINCT image_id, -1 FROM rg),
  fo AS (SELECT a.*, b.id AS bi, b.sx AS bsx, b.sy AS bsy FROM mu a LEFT JOIN mu b ON b.image_id = a.image_id AND b.id = a.next), cr AS (SELECT a.*, b.id AS bi, b.sx AS bsx, b.sy AS bsy, b.ex AS bex, b.ey AS bey, b.face AS bf, b.twin AS bt FROM mu a LEFT JOIN mu b ON b.image_id = a.image_id AND b.id = a.twin),
  un AS (SELECT image_id, id AS p, next AS q FROM mu UNION SELECT image_id, next, id FROM mu), ob(image_id, id, m) AS (SELECT image_id, id, id FROM mu UNION SELECT o.image_id, un.q, o.m FROM ob o JOIN un ON un.image_id = o.image_id AND un.p = o.id AND o.m < un.q),
  oc AS (SELECT image_id, id, min(m) AS orbit FROM (SELECT * FROM ob UNION ALL SELECT image_id, id, id FROM mu) GROUP BY 1, 2), mo AS (SELECT mu.*, orbit, sy::BIGINT * 1048576 + sx AS v, ey::BIGINT * 1048576 + ex AS w FROM mu JOIN oc USING (image_id, id)),
  vn AS (SELECT image_id, v AS p, w AS q FROM mo UNION SELECT image_id, w, v FROM mo), vo(image_id, v, m) AS (SELECT image_id, p, p FROM vn UNION SELECT o.image_id, vn.q, o.m FROM vo o JOIN vn ON vn.image_id = o.image_id AND vn.p = o.v),
  vc AS (SELECT image_id, v, min(m) AS part FROM vo GROUP BY 1, 2), eu AS (SELECT mo.image_id, part, 2 * count(DISTINCT mo.v) - count(*) + 2 * count(DISTINCT orbit) AS twice FROM mo JOIN vc ON vc.image_id = mo.image_id AND vc.v = mo.v GROUP BY 1, 2),
  ru AS (SELECT image_id, 'successor_unknown' AS rule FROM fo WHERE bi IS NULL UNION ALL SELECT image_id, 'successor_elsewhere' FROM fo WHERE ex <> bsx OR ey <> bsy
    UNION ALL SELECT a.image_id, 'not_entered_once' FROM mu a LEFT JOIN (SELECT image_id, next, count(*) AS n FROM mu GROUP BY 1, 2) b ON b.image_id = a.image_id AND b.next = a.id WHERE coalesce(n, 0) <> 1
    UNION ALL SELECT image_id, 'twin_unknown' FROM cr WHERE bi IS NULL UNION ALL SELECT image_id, 'twin_no_involution' FROM cr WHERE bt <> id OR twin = id UNION ALL SELECT image_id, 'twin_not_reversed' FROM cr WHERE NOT (sx = bex AND sy = bey AND ex = bsx AND ey = bsy)
    UNION ALL SELECT image_id, 'same_face_both_sides' FROM cr WHERE face = bf UNION ALL SELECT image_id, 'loop_of_several_orbits' FROM mo GROUP BY image_id, loop HAVING count(DISTINCT orbit) > 1 UNION ALL SELECT image_id, 'orbit_of_several_loops' FROM mo GROUP BY image_id, orbit HAVING count(DISTINCT loop) > 1
    UNION ALL SELECT image_id, 'loop_of_several_faces' FROM mu GROUP BY image_id, loop HAVING count(DISTINCT face) > 1 UNION ALL SELECT image_id, 'unknown_face' FROM (SELECT DISTINCT image_id, face FROM mu) ANTI JOIN fc USING (image_id, face)
    UNION ALL SELECT image_id, 'face_without_loop' FROM fc ANTI JOIN mu USING (image_id, face) UNION ALL SELECT image_id, 'euler_identity' FROM eu WHERE twice <> 4)"""


@query("r17_arrangement_audit", "labels4", f"RECURSIVE {AUDIT_SQL} SELECT image_id, rule, count(*) AS violations FROM ru GROUP BY 1, 2")
def r17b(t):
    c = F.col
    kind = lambda k, n: (c("image_id") % 6 == k) & (c("id") % n == 0)
    a = R.arrangement(R.lattice_boundaries(t.labels4())).filter(~kind(5, 43))
    damaged = a.select(
        "image_id", "id", "sx", "sy", "ex", "ey", F.when(kind(4, 31), c("face") + 1).otherwise(c("face")).alias("face"), F.when(kind(2, 41), c("id")).otherwise(c("twin")).alias("twin"),
        F.when(kind(1, 37), c("twin")).otherwise(c("next")).alias("next"), F.when(kind(3, 29), c("loop") + 1).otherwise(c("loop")).alias("loop"),
    )
    faces = R.regions(t.labels4()).select("image_id", F.col("region").alias("face")).distinct()
    return R.audit_arrangement(damaged, faces.unionByName(faces.select("image_id").distinct().withColumn("face", F.lit(R.OUTSIDE).cast("bigint"))))


@query(
    "r18_rebuilt_regions",
    "labels4",
    f"""RECURSIVE {LATTICE}, v AS (SELECT image_id, sx AS x, least(sy, ey) AS y, CASE WHEN ey < sy THEN lb.left ELSE lb.right END AS east, CASE WHEN ey < sy THEN lb.right ELSE lb.left END AS west FROM lb WHERE sx = ex AND (sx + 3 * sy + image_id) % 37 <> 0),
    d AS (SELECT rg.*, east, west, last_value(east IGNORE NULLS) OVER (PARTITION BY rg.image_id, rg.y ORDER BY rg.x ROWS UNBOUNDED PRECEDING) AS carried, last_value(east IGNORE NULLS) OVER (PARTITION BY rg.image_id, rg.y ORDER BY rg.x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rg LEFT JOIN v USING (image_id, x, y))
    SELECT image_id, x, y, carried IS DISTINCT FROM region AS region_differs, west IS NOT NULL AND before IS NOT NULL AND west <> before AS owner_differs FROM d""",
)
def r18(t):
    lb = R.lattice_boundaries(t.labels4()).filter((F.col("sx") != F.col("ex")) | ((F.col("sx") + F.col("sy") * 3 + F.col("image_id")) % 37 != 0))
    return R.rebuild_regions(lb, R.regions(t.labels4()))


def skeleton_sql() -> str:
    thin = thin_sql(10).replace("SELECT image_id, x, y, (v >= 0.45)::INT AS i FROM grid", "SELECT image_id, x, y, inside::INT AS i FROM bin8")
    return f"""{thin}, sk AS (SELECT image_id, x, y FROM u20 WHERE i = 1), dg AS (SELECT a.image_id, a.x, a.y, count(b.x) AS degree FROM sk a LEFT JOIN sk b ON b.image_id = a.image_id AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 GROUP BY ALL),
    dl AS (SELECT *, (degree <> 2)::INT AS label FROM dg), {cc('dl', 'rg', 'label', 8)}, pt AS (SELECT rg.*, degree FROM rg JOIN dg USING (image_id, x, y))"""


@query("r19_skeleton_nodes", "bin8", f"RECURSIVE {skeleton_sql()} SELECT image_id, region AS node, count(*) AS pixels, max(degree)::INT AS max_degree FROM pt WHERE label = 1 GROUP BY ALL")
def r19(t):
    thin = W.thin(t.bin8())
    return R.skeleton_graph(thin, W.distance_transform(t.bin8()).filter("inside").select("image_id", "x", "y", "d2"))[0]


@query(
    "r19_skeleton_edges",
    "bin8",
    f"""RECURSIVE {skeleton_sql()}, dt AS (SELECT f.image_id, f.x, f.y, min((f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y)) AS d2 FROM bin8 f JOIN bin8 b ON b.image_id = f.image_id AND NOT b.inside WHERE f.inside GROUP BY ALL),
    w AS (SELECT image_id, region, 2 * sqrt(d2::DOUBLE) - 1 AS w, row_number() OVER (PARTITION BY image_id, region ORDER BY d2) - 1 AS i, count(*) OVER (PARTITION BY image_id, region) AS n FROM pt JOIN dt USING (image_id, x, y) WHERE label = 0),
    en AS (SELECT a.image_id, a.region, count(DISTINCT b.region) AS e FROM pt a JOIN pt b ON b.image_id = a.image_id AND b.label = 1 AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 WHERE a.label = 0 GROUP BY ALL)
    SELECT w.image_id, w.region AS edge, any_value(n) AS pixels, coalesce(any_value(e), 0) AS end_nodes, any_value(e) IS NULL AS is_cycle, round(max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN w END), 6) AS median_width FROM w LEFT JOIN en USING (image_id, region) GROUP BY w.image_id, w.region""",
)
def r19b(t):
    thin = W.thin(t.bin8())
    d = R.skeleton_graph(thin, W.distance_transform(t.bin8()).filter("inside").select("image_id", "x", "y", "d2"))[1]
    return d.withColumn("median_width", F.round("median_width", 6))


PID = "({y}::BIGINT * 1048576 + {x})"
WAY = "((({y} + 1) * 3 + {x} + 1) - CASE WHEN ({y} + 1) * 3 + {x} + 1 > 4 THEN 1 ELSE 0 END)"
TRACE_SQL = f"""{{skeleton}}, cy AS (SELECT image_id, region FROM pt GROUP BY 1, 2 HAVING max(label) = 0 EXCEPT SELECT a.image_id, a.region FROM pt a JOIN pt b ON b.image_id = a.image_id AND b.label = 1 AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 WHERE a.label = 0),
    sp AS (SELECT pt.image_id, x, y, {PID.format(x='x', y='y')} AS id, CASE WHEN label = 1 OR (cy.region IS NOT NULL AND {PID.format(x='x', y='y')} = pt.region) THEN pt.region END AS node FROM pt LEFT JOIN cy ON cy.image_id = pt.image_id AND cy.region = pt.region),
    nbr AS (SELECT a.image_id, a.id AS a, b.id AS b, a.node AS an, b.node AS bn, {WAY.format(x='(b.x - a.x)', y='(b.y - a.y)')} AS way, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS step FROM sp a JOIN sp b ON b.image_id = a.image_id AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1),
    wk(image_id, edge, start, prev, cur, node, k, len) AS (SELECT image_id, a * 8 + way, an, a, b, bn, 1, step FROM nbr WHERE an IS NOT NULL AND bn IS NULL
      UNION ALL SELECT w.image_id, w.edge, w.start, w.cur, n.b, n.bn, w.k + 1, w.len + n.step FROM wk w JOIN nbr n ON n.image_id = w.image_id AND n.a = w.cur AND n.b <> w.prev WHERE w.node IS NULL),
    fin AS (SELECT w.*, n.a * 8 + n.way AS back FROM wk w JOIN nbr n ON n.image_id = w.image_id AND n.a = w.cur AND n.b = w.prev WHERE w.node IS NOT NULL), ed AS (SELECT * FROM fin WHERE edge <= back),
    po AS (SELECT wk.image_id, wk.edge, wk.k, wk.cur AS id FROM wk JOIN ed USING (image_id, edge) UNION ALL SELECT image_id, edge, 0, edge // 8 FROM ed)"""


def traced(t):
    inside = W.distance_transform(t.bin8()).filter("inside").select("image_id", "x", "y", "d2")
    return R.trace_skeleton(W.thin(t.bin8()), inside)


@query("r19_traced_nodes", "bin8", f"RECURSIVE {TRACE_SQL.format(skeleton=skeleton_sql())}, dg2 AS (SELECT image_id, unnest([start, node]) AS node FROM ed), dc AS (SELECT image_id, node, count(*) AS degree FROM dg2 GROUP BY 1, 2) SELECT sp.image_id, sp.node, round(avg(x) + 0.5, 6) AS x, round(avg(y) + 0.5, 6) AS y, count(*) AS pixels, coalesce(any_value(degree), 0) AS degree FROM sp LEFT JOIN dc ON dc.image_id = sp.image_id AND dc.node = sp.node WHERE sp.node IS NOT NULL GROUP BY sp.image_id, sp.node")
def r19c(t):
    return traced(t)[0].withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(
    "r19_traced_edges",
    "bin8",
    f"""RECURSIVE {TRACE_SQL.format(skeleton=skeleton_sql())}, dt AS (SELECT f.image_id, {PID.format(x='f.x', y='f.y')} AS id, min((f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y)) AS d2 FROM bin8 f JOIN bin8 b ON b.image_id = f.image_id AND NOT b.inside WHERE f.inside GROUP BY ALL),
    wi AS (SELECT image_id, edge, 2 * greatest(sqrt(d2::DOUBLE) - 0.5, 0.5) AS w, row_number() OVER (PARTITION BY image_id, edge ORDER BY d2) - 1 AS i, count(*) OVER (PARTITION BY image_id, edge) AS n FROM po JOIN dt USING (image_id, id)),
    md AS (SELECT image_id, edge, floor(greatest(max(CASE WHEN i = least(n // 2, n - 1) THEN w END), 1) * 64 + 0.5) / 64 AS width FROM wi GROUP BY 1, 2)
    SELECT image_id, edge, start, node AS "end", (k - 1)::BIGINT AS pixels, round(len, 6) AS length, width FROM ed JOIN md USING (image_id, edge)""",
)
def r19d(t):
    return traced(t)[1].withColumn("length", F.round("length", 6))


@query("r19_traced_points", "bin8", f"RECURSIVE {TRACE_SQL.format(skeleton=skeleton_sql())} SELECT image_id, edge, k::BIGINT AS k, (id % 1048576)::INT AS x, (id // 1048576)::INT AS y FROM po")
def r19e(t):
    return traced(t)[2]


@query(
    "r20_topology_edit",
    "bin8",
    f"""RECURSIVE {sig_sql('bin8', 4)}, d AS (SELECT a.image_id, b.components - a.components AS dc, b.holes - a.holes AS dh FROM sg a JOIN sg b ON b.image_id = a.image_id + 1)
    SELECT image_id, dc AS d_components, dh AS d_holes, abs(dc) + abs(dh) AS steps, CASE WHEN (dc, dh) = (-1, 0) THEN 'bridge_close' WHEN (dc, dh) = (1, 0) THEN 'gap_open' WHEN (dc, dh) = (0, 1) THEN 'hole_open' WHEN (dc, dh) = (0, -1) THEN 'hole_fill' WHEN (dc, dh) = (0, 0) THEN 'identity'
      ELSE 'compound(c' || format('{{:+d}}', dc) || ',h' || format('{{:+d}}', dh) || ')' END AS name FROM d""",
)
def r20(t):
    s = R.signature(t.bin8(), 4)
    nxt = s.select((F.col("image_id") - 1).alias("image_id"), F.col("components").alias("c2"), F.col("holes").alias("h2"))
    dc, dh = F.col("c2") - F.col("components"), F.col("h2") - F.col("holes")
    return s.join(nxt, "image_id").select("image_id", dc.alias("d_components"), dh.alias("d_holes"), (F.abs(dc) + F.abs(dh)).alias("steps"), R.edit_name(dc, dh).alias("name"))


@query("r21_roi_pixels", "grid", "SELECT g.image_id, x, y, round(v, 6) AS v FROM grid g JOIN (SELECT s_suppkey AS image_id, (s_suppkey % 40)::INT AS x0, (s_suppkey % 30)::INT AS y0 FROM supplier) r USING (image_id) WHERE x >= x0 - 2 AND x < x0 + 12 AND y >= y0 - 2 AND y < y0 + 9")
def r21(t):
    k = F.col("s_suppkey")
    x0, y0 = (k % 40).cast("int"), (k % 30).cast("int")
    rois = t.table("supplier").select(k.alias("image_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 10).alias("x1"), (y0 + 7).alias("y1"))
    return R.roi_pixels(t.grid(), rois, 2).select("image_id", "x", "y", r6(F.col("v"), "v"))


@query(
    "w07_run_lengths",
    "bin8",
    """o AS (SELECT image_id, y * 8 + x AS i, inside, lag(inside) OVER (PARTITION BY image_id ORDER BY y, x) AS p FROM bin8), s AS (SELECT * FROM o WHERE p IS NULL OR p <> inside)
    SELECT image_id, row_number() OVER w - 1 AS k, inside, (coalesce(lead(i) OVER w, 64) - i)::BIGINT AS length FROM s WINDOW w AS (PARTITION BY image_id ORDER BY i)""",
)
def w07(t):
    return R.run_lengths(t.bin8())


@query(
    "w11_canonical_labels",
    "labels4",
    """f AS (SELECT image_id, label, min(y * 8 + x) AS f FROM labels4 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label <> 2, f) - 1 AS k, bool_or(label = 2) OVER (PARTITION BY image_id) AS has FROM f)
    SELECT image_id, x, y, label, (k + CASE WHEN has THEN 0 ELSE 1 END)::INT AS canonical FROM labels4 JOIN r USING (image_id, label)""",
)
def w11(t):
    return R.canonical_labels(t.labels4(), exterior=2).select("image_id", "x", "y", "label", "canonical")
