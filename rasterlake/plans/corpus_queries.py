"""Sources and sinks, splits, completeness and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import corpus as K
from rasterlake.operators.digests import digest_sql
from rasterlake.plans.functions_queries import r6
from rasterlake.registry import query
from rasterlake.sources import config, images as S


@query("s01_pixel_scan", "px8", "SELECT image_id, x, y, round(alpha * 1.2 - 0.6, 6) AS v FROM px8")
def s01(t):
    d = S.pixels_from_array(t.table("embeddings"), "vec_id", "embedding", 8)
    v = F.least(F.lit(0.6), F.greatest(F.lit(-0.6), F.col("v").cast("double")))
    return d.select("image_id", "x", "y", r6(v, "v"))


@query(
    "s02_ingest_limits",
    "",
    """d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT * 180 * (CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END) AS w, l_partkey % 8000 + 100 * l_linenumber AS h, round(l_extendedprice * 800)::BIGINT AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, w AS width, h AS height, CASE WHEN b > 67108864 THEN 'encoded_too_large' WHEN w = 0 OR h = 0 THEN 'empty' WHEN w > 8192 OR h > 8192 THEN 'dimension_too_large'
      WHEN w * h > 8000000 THEN 'too_many_pixels' END AS kind FROM d""",
)
def s02(t):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    w = F.rint("l_quantity").cast("bigint") * 180 * F.when(p % 50 == 0, 0).otherwise(1)
    d = t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.alias("width"), (p % 8000 + n * 100).alias("height"),
        F.round(F.col("l_extendedprice") * 800).cast("bigint").alias("bytes"),
    )
    limits = S.DecodeLimits(max_pixels=8_000_000)
    refusal = S.ingest_refusal(limits, F.col("width"), F.col("height"), F.col("bytes"))
    d = d.withColumn("refusal", refusal)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "width", "height", F.col("refusal.kind").alias("kind"))


@query(
    "s03_manifest_verification",
    "manifest files",
    """SELECT coalesce(m.name, f.name) AS name, CASE WHEN m.name IS NULL THEN 'not_in_manifest' WHEN f.name IS NULL THEN 'missing' WHEN f.width IS NULL OR f.height IS NULL THEN 'invalid'
      WHEN f.width <> m.width OR f.height <> m.height THEN 'dimension_mismatch' WHEN f.sha256 <> m.sha256 THEN 'hash_mismatch' ELSE 'ok' END AS status
    FROM manifest m FULL JOIN files f ON f.name = m.name""",
)
def s03(t):
    return S.verify_manifest(t.manifest(), t.files())


@query(
    "s04_journal_read",
    "",
    """h AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'old' ELSE 'v2' END AS head FROM events WHERE user_id % 7 <> 0 GROUP BY user_id)
    SELECT 'r' || e.user_id AS report_id, 'e' || event_id AS key, value AS payload, CASE WHEN head IS NULL THEN 'no_header' WHEN head <> 'v2' THEN 'header_mismatch' END AS refusal
    FROM events e LEFT JOIN h USING (user_id)""",
)
def s04(t):
    e = t.table("events")
    report = F.concat(F.lit("r"), "user_id")
    js = lambda tag, key, payload: F.to_json(F.struct(F.lit(tag).alias("tag"), report.alias("report_id"), key.alias("key"), payload.alias("payload")))
    heads = e.filter(F.col("user_id") % 7 != 0).select("user_id").distinct()
    head = heads.select(js("Header", F.when(F.col("user_id") % 5 == 0, "old").otherwise("v2"), F.lit(None).cast("double")).alias("line"))
    rows = e.select(js("Row", F.concat(F.lit("e"), "event_id"), F.col("value")).alias("line"))
    return S.parse_journal(head.unionByName(rows), "v2")


@query(
    "s05_canonical_report",
    "meas1",
    f"""src AS (SELECT family, profile, group_id, scene_id, cell_id, '{{"accepted":' || accepted || ',"cell_id":' || cell_id || ',"class":"' || class || '","group_id":' || group_id || ',"palette_delta":' || palette_delta || ',"reason":' || coalesce('"' || reason || '"', 'null') || ',"scene_id":' || scene_id || '}}' AS line FROM meas1),
    {digest_sql('src', ['family', 'profile'], 'group_id, scene_id, cell_id', 'line')}
    SELECT family, profile, p AS digest FROM dg3""",
)
def s05(t):
    cols = ["group_id", "scene_id", "cell_id", "accepted", "class", "palette_delta", "reason"]
    return S.report_digest(t.meas1(), ["family", "profile"], K.KEY, cols)


@query("s06_artifact_inventory", "", None)
def s06(t):
    return S.artifact_inventory(t.spark, t.dir, ["lineitem.parquet", "orders.parquet"])


@query(
    "s07_gate_load",
    "meas",
    """g AS (SELECT family AS section, 'bits_' || quantity AS key, CASE WHEN quantity = 50 AND family = 'MACHINERY' THEN 'inf'::DOUBLE ELSE max(palette_delta)::DOUBLE END AS gate, CASE WHEN family = 'BUILDING' AND quantity < 5 THEN 'placeholder' ELSE 'frozen' END AS status FROM meas GROUP BY family, quantity)
    SELECT section, key, status, CASE WHEN status <> 'frozen' THEN 'placeholder_section' WHEN isinf(gate) THEN 'non_finite_value' END AS refusal FROM g""",
)
def s07(t):
    q, f = F.col("quantity"), F.col("family")
    g = t.meas().groupBy("family", "quantity").agg(F.max("palette_delta").cast("double").alias("m")).select(
        f.alias("section"), F.concat(F.lit("bits_"), q).alias("key"),
        F.when((q == 50) & (f == "MACHINERY"), F.lit(float("inf"))).otherwise(F.col("m")).alias("gate"),
        F.when((f == "BUILDING") & (q < 5), "placeholder").otherwise("frozen").alias("status"),
    )
    return config.gate_findings(g).drop("gate")


# ---- joins on keys ----------------------------------------------------------
EXPECTED_SQL = "ex AS (SELECT g.group_id, s.scene_id, c.cell_id FROM (SELECT o_orderkey AS group_id FROM orders WHERE o_orderkey % 2 = 0) g JOIN (SELECT DISTINCT l_orderkey, l_suppkey AS scene_id FROM lineitem) s ON s.l_orderkey = g.group_id CROSS JOIN (SELECT range + 1 AS cell_id FROM range(0, 7)) c)"


def expected(t):
    groups = t.table("orders").filter(F.col("o_orderkey") % 2 == 0).select(F.col("o_orderkey").alias("group_id"))
    scenes = t.table("lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("scene_id")).distinct()
    cells = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint")))
    return groups.join(scenes, "group_id").select("group_id", "scene_id", cells.alias("cell_id"))


@query("j08_pending_work", "meas", f"{EXPECTED_SQL} SELECT group_id, scene_id, cell_id FROM ex ANTI JOIN meas USING (group_id, scene_id, cell_id)")
def j08(t):
    return K.pending(expected(t), t.meas(), K.KEY)


@query("j09_outside_population", "meas", f"{EXPECTED_SQL} SELECT group_id, scene_id, cell_id, quantity FROM meas ANTI JOIN ex USING (group_id, scene_id, cell_id)")
def j09(t):
    return K.outside_population(expected(t), t.meas(), K.KEY).select(*K.KEY, "quantity")


FNV_SQL = """list_reduce(list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::UHUGEINT),
        lambda acc, b: (xor(acc, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"""


def split_sql(family: str) -> str:
    b = f"({FNV_SQL.format(s=family)} % 100)"
    return f"CASE WHEN {b} < 55 THEN 'development' WHEN {b} < 75 THEN 'calibration' ELSE 'sealed_audit' END"


@query(
    "j11_job_product",
    "",
    f"""g AS (SELECT o_orderkey AS group_id, l_suppkey AS scene_id, 'gt-split-v1/' || p_name AS fam FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    s AS (SELECT *, {split_sql('fam')} AS split FROM g), c AS (SELECT (16 * (1 << range))::INT AS cell_size_px, unnest(['exact-clip', 'tiny']) AS profile FROM range(0, 6))
    SELECT group_id, scene_id, cell_size_px, profile FROM s CROSS JOIN c WHERE split = 'calibration' AND ('0x' || substr(sha256('source-shard/v1/' || group_id), 1, 16))::UBIGINT % 8 = 3 AND cell_size_px = 128""",
)
def j11(t):
    g = (
        t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_orderkey").alias("group_id"), F.col("l_suppkey").alias("scene_id"), "p_name").distinct()
    )
    cells = t.spark.createDataFrame([(16 * 2**k, p) for k in range(6) for p in ("exact-clip", "tiny")], "cell_size_px int, profile string")
    d = K.job_list(K.split_rows(g, "p_name"), cells, "calibration", 3, 8, size=128)
    return d.select("group_id", "scene_id", "cell_size_px", "profile")


@query(
    "g01_leak_free_split",
    "",
    f"SELECT p_partkey, p_name, {split_sql('f')} AS split FROM (SELECT *, 'gt-split-v1/' || p_name || p_brand AS f FROM part)",
)
def g01(t):
    d = t.table("part").withColumn("family", F.concat("p_name", "p_brand"))
    return K.split_rows(d, "family").select("p_partkey", "p_name", "split")


@query(
    "g02_held_out_profile",
    "",
    f"SELECT p_partkey, p_type AS profile, split FROM (SELECT *, {split_sql('f')} AS split FROM (SELECT *, 'gt-split-v1/' || p_name || p_brand AS f FROM part)) WHERE split = 'development' AND p_type IN ('ECONOMY')",
)
def g02(t):
    d = t.table("part").withColumn("family", F.concat("p_name", "p_brand")).withColumn("profile", F.col("p_type"))
    return K.held_out_violations(K.split_rows(d, "family"), ["ECONOMY"]).select("p_partkey", "profile", "split")


@query(
    "g03_contamination",
    "meas",
    """r AS (SELECT group_id, unnest(list_filter([CASE WHEN profile = 'R' AND quantity < 10 THEN 'backend_is_judged' END, CASE WHEN status = 'P' AND quantity > 45 THEN 'observation_is_judged' END, CASE WHEN cell_id = scene_id % 50 THEN 'shared_implementation' END], lambda v: v IS NOT NULL)) AS reason FROM meas)
    SELECT g.group_id, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, count(reason) > 0 AS contaminated FROM (SELECT DISTINCT group_id FROM meas) g LEFT JOIN r USING (group_id) GROUP BY g.group_id""",
)
def g03(t):
    q = F.col("quantity")
    reasons = {
        "backend_is_judged": (F.col("profile") == "R") & (q < 10),
        "observation_is_judged": (F.col("status") == "P") & (q > 45),
        "shared_implementation": F.col("cell_id") == F.col("scene_id") % 50,
    }
    return K.contamination(t.meas(), ["group_id"], reasons).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "g04_population_completeness",
    "meas",
    f"""{EXPECTED_SQL}, n AS (SELECT group_id, scene_id, cell_id, count(*) AS c FROM meas GROUP BY ALL)
    SELECT group_id, scene_id, cell_id, CASE WHEN c IS NULL THEN 'missing' WHEN ex.k IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem, coalesce(c, 0) AS copies
    FROM (SELECT *, 1 AS k FROM ex) ex FULL JOIN n USING (group_id, scene_id, cell_id) WHERE c IS NULL OR ex.k IS NULL OR c > 1""",
)
def g04(t):
    return K.key_completeness(expected(t), t.meas(), K.KEY)


@query(
    "g04_population_verdict",
    "meas",
    f"""{EXPECTED_SQL}, e2 AS (SELECT group_id % 100 AS shard, * FROM ex), m2 AS (SELECT group_id % 100 AS shard, * FROM meas), n AS (SELECT shard, group_id, scene_id, cell_id, count(*) AS c FROM m2 GROUP BY ALL),
    p AS (SELECT shard, count(*) FILTER (WHERE c IS NULL) AS missing, count(*) FILTER (WHERE k IS NULL) AS unexpected, count(*) FILTER (WHERE c > 1 AND k IS NOT NULL) AS duplicate FROM (SELECT *, 1 AS k FROM e2) e FULL JOIN n USING (shard, group_id, scene_id, cell_id) GROUP BY shard),
    tt AS (SELECT shard, count(*) AS rows, count(DISTINCT group_id) AS groups FROM m2 GROUP BY shard)
    SELECT shard, coalesce(rows, 0) AS rows, coalesce(groups, 0) AS groups, coalesce(missing, 0) AS missing, coalesce(unexpected, 0) AS unexpected, coalesce(duplicate, 0) AS duplicate,
      coalesce(missing, 0) + coalesce(unexpected, 0) + coalesce(duplicate, 0) = 0 AND rows = 2400 AND groups = 800 AS complete FROM tt FULL JOIN p USING (shard)""",
)
def g04b(t):
    shard = (F.col("group_id") % 100).alias("shard")
    e, m = expected(t).select("*", shard), t.meas().select("*", shard)
    return K.population_verdict(e, m, ["shard", *K.KEY], ["shard"], groups=800, count=2400)


@query(
    "g05_seal_state",
    "",
    """l AS (SELECT conv_id AS generation, turn AS seq, CASE WHEN role = 'user' THEN 'open' WHEN length(text) % 5 = 0 THEN 'burn' ELSE 'seal' END AS action, sha256(text) AS ch, CASE WHEN length(text) % 7 = 0 THEN '' ELSE 'p1' END AS ph, 'g' || (conv_id % 3) AS gh FROM conversations),
    a AS (SELECT generation, arg_max(action, seq) AS action, arg_max(ch, seq) AS ch, arg_max(ph, seq) AS ph, arg_max(gh, seq) AS gh FROM l GROUP BY 1),
    c AS (SELECT conv_id AS generation, sha256(arg_max(text, turn) || CASE WHEN conv_id % 3 = 0 THEN '!' ELSE '' END) AS ch, 'p1' AS ph, 'g' || (conv_id % 4) AS gh FROM conversations GROUP BY conv_id),
    f AS (SELECT a.generation, action, CASE WHEN a.ch = '' THEN 'incomplete:corpus_hash' WHEN a.ch <> c.ch THEN 'changed:corpus_hash' WHEN a.ph = '' THEN 'incomplete:prereg_hash' WHEN a.ph <> c.ph THEN 'changed:prereg_hash'
       WHEN a.gh = '' THEN 'incomplete:gates_hash' WHEN a.gh <> c.gh THEN 'changed:gates_hash' END AS fin FROM a JOIN c USING (generation))
    SELECT generation, CASE WHEN action = 'burn' OR (action = 'open' AND fin LIKE 'changed%') THEN 'burned' WHEN action = 'open' THEN 'opened' ELSE 'sealed' END AS state,
      CASE WHEN action = 'burn' THEN 'already_burned' WHEN action = 'open' THEN fin ELSE 'still_sealed' END AS finding FROM f""",
)
def g05(t):
    c = t.table("conversations")
    n = F.length("text")
    log = c.select(
        F.col("conv_id").alias("generation"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "open").when(n % 5 == 0, "burn").otherwise("seal").alias("action"),
        F.sha2("text", 256).alias("corpus_hash"), F.when(n % 7 == 0, "").otherwise("p1").alias("prereg_hash"),
        F.concat(F.lit("g"), F.col("conv_id") % 3).alias("gates_hash"),
    )
    current = c.groupBy(F.col("conv_id").alias("generation")).agg(F.max_by("text", "turn").alias("last")).select(
        "generation", F.sha2(F.concat("last", F.when(F.col("generation") % 3 == 0, "!").otherwise("")), 256).alias("corpus_hash"), F.lit("p1").alias("prereg_hash"),
        F.concat(F.lit("g"), F.col("generation") % 4).alias("gates_hash"),
    )
    return K.seal_states(log, current)


@query(
    "g06_header_identity",
    "meas",
    """e AS (SELECT c_custkey AS group_id, c_mktsegment AS family, '1-URGENT' AS class FROM customer),
    d AS (SELECT DISTINCT group_id, family, class FROM meas)
    SELECT DISTINCT group_id, unnest(list_filter([CASE WHEN e.group_id IS NULL THEN 'unknown_key' END, CASE WHEN d.family IS DISTINCT FROM e.family AND e.group_id IS NOT NULL THEN 'family' END, CASE WHEN d.class IS DISTINCT FROM e.class AND e.group_id IS NOT NULL THEN 'class' END], lambda v: v IS NOT NULL)) AS mismatch
    FROM d LEFT JOIN e USING (group_id)""",
)
def g06(t):
    e = t.table("customer").select(F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("family"), F.lit("1-URGENT").alias("class"))
    return K.header_mismatches(t.meas(), e, ["group_id"], ["family", "class"])


@query(
    "g08_shard_balance",
    "meas",
    "SELECT (('0x' || substr(sha256('source-shard/v1/' || group_id), 1, 16))::UBIGINT % 16)::INT AS shard, count(*) AS rows, count(DISTINCT group_id) AS groups FROM meas GROUP BY 1",
)
def g08(t):
    return K.shard_balance(t.meas(), 16)


# ---- set operations ---------------------------------------------------------


@query(
    "u01_same_population",
    "meas",
    """a AS (SELECT DISTINCT group_id, scene_id, cell_id FROM meas WHERE quantity > 3), b AS (SELECT DISTINCT group_id, scene_id, cell_id FROM meas WHERE quantity < 49)
    SELECT *, only_left = 0 AND only_right = 0 AS same_population FROM (SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left,
      (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right)""",
)
def u01(t):
    return K.same_population(t.meas().filter("quantity > 3"), t.meas().filter("quantity < 49"), K.KEY)


FAM = "profile || '-' || quantity || '-' || size_px || '-' || cell_id"


@query("u02_absent_families", "meas", f"SELECT {FAM} AS fam FROM meas WHERE NOT accepted EXCEPT SELECT {FAM} FROM meas WHERE accepted")
def u02(t):
    d = t.meas().withColumn("fam", F.concat_ws("-", "profile", "quantity", "size_px", "cell_id"))
    return K.absent_families(d.filter("not accepted"), d.filter("accepted"), "fam")


@query(
    "u03_shard_union",
    "meas",
    """s AS (SELECT *, group_id % 8 AS shard, CASE WHEN group_id % 8 = 5 THEN 'v1' ELSE 'v2' END AS h1, 'x' AS h2 FROM meas WHERE group_id % 8 <> 6), g AS (SELECT group_id, scene_id, cell_id, count(*) AS c, min((quantity, palette_delta)) AS lo, max((quantity, palette_delta)) AS hi FROM s GROUP BY ALL)
    SELECT 'header_mismatch' AS finding, (count(DISTINCT h1) > 1)::BIGINT + (count(DISTINCT h2) > 1)::BIGINT AS count FROM s UNION ALL SELECT 'missing_shard', 8 - count(DISTINCT shard) FROM s
    UNION ALL SELECT 'duplicate_row', count(*) FROM g WHERE c > 1 AND lo = hi UNION ALL SELECT 'conflicting_row', count(*) FROM g WHERE c > 1 AND lo <> hi""",
)
def u03(t):
    s = t.meas().withColumn("shard", F.col("group_id") % 8).filter("shard != 6").withColumns(
        {"h1": F.when(F.col("shard") == 5, "v1").otherwise("v2"), "h2": F.lit("x")}
    )
    return K.shard_union(s, K.KEY, ["quantity", "palette_delta"], ["h1", "h2"], 8)


@query("u04_class_inclusion", "meas", f"SELECT DISTINCT {FAM} AS fam FROM meas WHERE mandatory AND {FAM} NOT IN (SELECT {FAM} FROM meas WHERE accepted AND NOT catastrophic)")
def u04(t):
    d = t.meas().withColumn("fam", F.concat_ws("-", "profile", "quantity", "size_px", "cell_id"))
    return K.not_included(d.filter("mandatory"), d.filter("accepted and not catastrophic"), ["fam"])


@query(
    "u05_labelling_difference",
    "labels4",
    """SELECT a.image_id, a.x, a.y, a.label AS before, b.label AS after FROM labels4 a FULL JOIN (SELECT image_id - 1 AS image_id, x, y, label FROM labels4) b USING (image_id, x, y) WHERE a.label IS DISTINCT FROM b.label AND a.image_id IS NOT NULL AND b.image_id IS NOT NULL
    UNION ALL SELECT b.image_id, b.x, b.y, NULL, b.label FROM (SELECT image_id - 1 AS image_id, x, y, label FROM labels4) b ANTI JOIN labels4 USING (image_id, x, y)
    UNION ALL SELECT a.image_id, a.x, a.y, a.label, NULL FROM labels4 a ANTI JOIN (SELECT image_id - 1 AS image_id, x, y FROM labels4) b USING (image_id, x, y)""",
)
def u05(t):
    return K.labelling_difference(t.labels4(), t.labels4().withColumn("image_id", F.col("image_id") - 1))


@query(
    "u06_document_drift",
    "runs",
    """a AS (SELECT input, artifact, repeat AS r, digest FROM runs WHERE repeat < 2 AND (input, artifact) NOT IN (SELECT (source, lang) FROM documents WHERE doc_id % 97 = 0)), b AS (SELECT input, artifact, repeat - 1 AS r, digest FROM runs WHERE repeat > 0),
    i AS (SELECT coalesce(a.input, b.input) AS input, a.input IS NOT NULL AS ia, b.input IS NOT NULL AS ib FROM (SELECT DISTINCT input FROM a) a FULL JOIN (SELECT DISTINCT input FROM b) b USING (input)),
    l AS (SELECT coalesce(a.input, b.input) AS input, coalesce(a.artifact, b.artifact) AS artifact, a.input IS NOT NULL AS ia, b.input IS NOT NULL AS ib FROM (SELECT DISTINCT input, artifact FROM a) a FULL JOIN (SELECT DISTINCT input, artifact FROM b) b ON a.input = b.input AND a.artifact = b.artifact),
    d AS (SELECT coalesce(a.input, b.input) AS input, coalesce(a.artifact, b.artifact) AS artifact, coalesce(a.r, b.r) AS r, a.digest AS da, b.digest AS db FROM a FULL JOIN b ON a.input = b.input AND a.artifact = b.artifact AND a.r = b.r)
    SELECT input, p.path, CASE WHEN ia THEN '<object>' ELSE '<absent>' END AS before, CASE WHEN ib THEN '<object>' ELSE '<absent>' END AS after FROM i CROSS JOIN (SELECT unnest(['/normative', '/schema']) AS path) p WHERE ia <> ib
    UNION ALL SELECT input, '/schema/v', '1', '2' FROM i WHERE ia AND ib AND length(input) % 2 = 1
    UNION ALL SELECT l.input, '/normative/' || artifact, CASE WHEN l.ia THEN '<object>' ELSE '<absent>' END, CASE WHEN l.ib THEN '<object>' ELSE '<absent>' END FROM l JOIN i USING (input) WHERE i.ia AND i.ib AND l.ia <> l.ib
    UNION ALL SELECT d.input, '/normative/' || d.artifact || '/' || r || CASE WHEN da IS NULL OR db IS NULL THEN '' ELSE '/files/digest' END,
       CASE WHEN da IS NULL THEN '<absent>' WHEN db IS NULL THEN '<object>' ELSE da END, CASE WHEN db IS NULL THEN '<absent>' WHEN da IS NULL THEN '<object>' ELSE db END
     FROM d JOIN l ON l.input = d.input AND l.artifact = d.artifact WHERE l.ia AND l.ib AND da IS DISTINCT FROM db""",
)
def u06(t):
    def docs(runs, version):
        leaf = F.struct(F.struct("digest").alias("files"))
        inner = runs.groupBy("input", "artifact").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rep").cast("string"), leaf))).alias("m"))
        tree = inner.groupBy("input").agg(F.map_from_entries(F.collect_list(F.struct("artifact", "m"))).alias("m"))
        parts = [F.struct(version.alias("v")).alias("schema"), F.col("m").alias("normative"), F.lit("noise").alias("informational")]
        return tree.select("input", F.to_json(F.struct(*parts)).alias("doc"))

    gone = t.table("documents").filter("doc_id % 97 = 0").select(F.col("source").alias("input"), F.col("lang").alias("artifact")).distinct()
    first = t.runs().filter("repeat < 2").withColumn("rep", F.col("repeat")).join(gone, ["input", "artifact"], "left_anti")
    second = t.runs().filter("repeat > 0").withColumn("rep", F.col("repeat") - 1)
    return K.document_drift(docs(first, F.lit(1)), docs(second, F.length("input") % 2 + 1), "input", "doc")


@query(
    "u07_co_change",
    "changes",
    """n AS (SELECT change_set, replace(path, '\\', '/') AS path, kind, at_base, turn FROM changes), f AS (SELECT *, path LIKE 'configs/%' AND NOT (kind = 'A' AND NOT at_base) AS gate, path LIKE 'crates/%' AS code FROM n)
    SELECT change_set, arg_min(path, turn) FILTER (WHERE gate) AS gate_path, arg_min(path, turn) FILTER (WHERE code) AS code_path FROM f GROUP BY change_set HAVING bool_or(gate) AND bool_or(code)""",
)
def u07(t):
    return K.co_change_violations(t.changes(), "configs/", "crates/")
