"""Verdicts, certificates, guards and sweeps over the measurement rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import reliability as R
from rasterlake.operators.quantiles import index_quantiles, metric_quantiles
from rasterlake.plans.functions_queries import cp_sql, r6
from rasterlake.registry import query

FLAGS = """bool_or(mandatory) AS seen, bool_or(mandatory AND accepted) AS ga,
    bool_or(mandatory AND accepted AND catastrophic) AS gc, count(*) AS n, count(*) FILTER (WHERE accepted) AS na"""
COUNTS = """count(*) FILTER (WHERE seen) AS groups_total, count(*) FILTER (WHERE ga) AS groups_accepted,
    count(*) FILTER (WHERE gc) AS groups_catastrophic, sum(n)::BIGINT AS renders_total, sum(na)::BIGINT AS renders_accepted"""
CERT = """groups_total, groups_accepted, groups_catastrophic, renders_total, renders_accepted,
    round(CASE WHEN groups_total > 0 THEN groups_accepted / groups_total::DOUBLE ELSE 0 END, 6) AS coverage_per_source,
    round(CASE WHEN renders_total > 0 THEN renders_accepted / renders_total::DOUBLE ELSE 0 END, 6) AS coverage_per_render,
    round(cp.upper, 6) AS catastrophic_risk_upper, 459::BIGINT AS required_groups, greatest(459 - groups_accepted, 0)::BIGINT AS group_deficit,
    greatest(459 - groups_accepted, 0) = 0 AND cp.upper < 0.01 AS contract_met, NULL::VARCHAR AS likelihood_refusal"""
# without a declared residual model nothing is certified
CERT_NONE = CERT.replace("greatest(459 - groups_accepted, 0) = 0 AND cp.upper < 0.01 AS", "false AS").replace("NULL::VARCHAR", "'no residual model declared'")
CERT_COLS = [
    "groups_total", "groups_accepted", "groups_catastrophic", "renders_total", "renders_accepted", "required_groups",
    "group_deficit", "contract_met", "likelihood_refusal",
]


def cert_select(df, *keys):
    rounded = [r6(F.col(c), c) for c in ("coverage_per_source", "coverage_per_render", "catastrophic_risk_upper")]
    return df.select(*keys, *CERT_COLS, *rounded)


@query(
    "a11_index_quantiles",
    "meas",
    """v AS (SELECT family, price, row_number() OVER (PARTITION BY family ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM meas)
    SELECT family, n, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN price END) AS median_floor,
      max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN price END) AS p95_floor,
      max(CASE WHEN i = ceil((n - 1) * 0.95) THEN price END) AS p95_ceil, max(CASE WHEN i = ceil((n - 1) * 0.99) THEN price END) AS p99_ceil
    FROM v GROUP BY family, n""",
)
def a11(t):
    specs = {"median_floor": ("floor", 0.5), "p95_floor": ("floor", 0.95), "p95_ceil": ("ceil", 0.95), "p99_ceil": ("ceil", 0.99)}
    return index_quantiles(t.meas(), ["family"], "price", specs)


@query(
    "a34_group_verdict",
    "meas",
    f"""g AS (SELECT group_id, {FLAGS} FROM meas WHERE profile <> 'R' GROUP BY group_id)
    SELECT group_id, CASE WHEN gc THEN 'accepted_catastrophic' WHEN ga THEN 'accepted_clean' ELSE 'abstained' END AS verdict FROM g WHERE seen""",
)
def a34(t):
    return R.group_verdicts(t.meas())


@query(
    "a35_risk_coverage",
    "meas",
    f"""RECURSIVE g AS (SELECT family, size_px, group_id, {FLAGS} FROM meas WHERE profile <> 'R' GROUP BY ALL),
    s AS (SELECT family, size_px, family || '/' || size_px AS id, {COUNTS} FROM g GROUP BY ALL),
    trials AS (SELECT id, groups_catastrophic AS k, groups_accepted AS n FROM s), {cp_sql(0.99)}
    SELECT family, size_px, {CERT} FROM s JOIN cp USING (id)""",
)
def a35(t):
    return cert_select(R.risk_coverage(t.meas(), ["family", "size_px"], F.lit("block"), F.lit(True)), "family", "size_px")


@query(
    "j12_bucket_membership",
    "meas",
    f"""RECURSIVE b(bucket, lo, hi, classes) AS (VALUES ('small', 16, 64, ['identifiable']), ('target', 128, 512, ['identifiable']),
        ('all', 16, 512, ['identifiable', 'equivalent_family'])),
    m AS (SELECT b.bucket, meas.* FROM meas JOIN b ON size_px BETWEEN lo AND hi AND list_contains(classes, identifiability)),
    g AS (SELECT bucket, group_id, {FLAGS} FROM m WHERE profile <> 'R' GROUP BY ALL), s AS (SELECT bucket, bucket AS id, {COUNTS} FROM g GROUP BY ALL),
    trials AS (SELECT id, groups_catastrophic AS k, groups_accepted AS n FROM s), {cp_sql(0.99)}
    SELECT bucket, {CERT_NONE} FROM s JOIN cp USING (id)""",
)
def j12(t):
    from rasterlake.sources.config import BUCKETS, bucket_table

    rows = t.meas().join(
        F.broadcast(bucket_table(t.spark, BUCKETS)),  # a handful of preregistered rows
        F.col("size_px").between(F.col("min_size_px"), F.col("max_size_px"))
        & F.array_contains("identifiability_in", F.col("identifiability")),
    )
    return cert_select(R.risk_coverage(rows, ["bucket"], F.lit(None).cast("string"), F.lit(False)), "bucket")


@query(
    "a36_confidence_guard",
    "meas",
    """SELECT group_id, scene_id, cell_id, quantity, CASE WHEN reason IS NULL THEN 'no residual model declared'
      WHEN class IN ('1-URGENT', '2-HIGH') THEN 'diagnostic residual model iid'
      WHEN NOT accepted THEN 'uncalibrated residual model block' END AS refusal FROM meas""",
)
def a36(t):
    model = F.when(F.col("reason").isNull(), F.lit(None)).when(F.col("class").isin("1-URGENT", "2-HIGH"), "iid").otherwise("block")
    return t.meas().select("group_id", "scene_id", "cell_id", "quantity", R.confidence_guard(model, F.col("accepted")).alias("refusal"))


@query(
    "w09_threshold_sweep",
    "meas",
    f"""RECURSIVE u AS (SELECT *, CASE WHEN quantity % 5 <> 3 THEN quantity::DOUBLE END AS s FROM meas WHERE profile <> 'R'), th AS (SELECT DISTINCT s AS threshold FROM u WHERE s IS NOT NULL),
    tot AS (SELECT count(*) AS renders_total, count(DISTINCT CASE WHEN mandatory THEN group_id END) AS groups_total FROM u),
    sw AS (SELECT threshold, threshold AS id, count(DISTINCT CASE WHEN mandatory THEN group_id END) AS groups_accepted,
        count(DISTINCT CASE WHEN mandatory AND catastrophic THEN group_id END) AS groups_catastrophic, count(*) AS renders_accepted,
        sum(samples)::BIGINT AS samples, sum(at95)::BIGINT AS at95, sum(at99)::BIGINT AS at99, count(*) FILTER (WHERE max_px > 0.5) AS over
      FROM th JOIN u ON s >= threshold GROUP BY threshold),
    trials AS (SELECT id, groups_catastrophic AS k, groups_accepted AS n FROM sw), {cp_sql(0.99)},
    j AS (SELECT sw.*, tot.*, cp.upper, greatest(459 - groups_accepted, 0) = 0 AND cp.upper < 0.01 AS contract_met FROM sw CROSS JOIN tot JOIN cp USING (id)),
    e AS (SELECT *, contract_met AND groups_accepted / groups_total::DOUBLE >= 0.5 AND renders_accepted / renders_total::DOUBLE >= 0.05
       AND at95 >= ceil((samples - 1) * 0.95) + 1 AND at99 >= ceil((samples - 1) * 0.99) + 1 AND over = 0 AND groups_catastrophic = 0 AS eligible FROM j)
    SELECT threshold, groups_accepted, groups_catastrophic, renders_accepted, samples, at95, at99, over, round(upper, 6) AS catastrophic_risk_upper,
      round(groups_accepted / groups_total::DOUBLE, 6) AS coverage_per_source, contract_met, eligible, coalesce(threshold = (SELECT min(threshold) FROM e WHERE eligible), false) AS selected FROM e""",
)
def w09(t):
    gates = R.SweepGates(0.5, 0.05, 0.5)
    rows = t.meas().withColumn("score", F.when(F.col("quantity") % 5 != 3, F.col("quantity")))
    d = R.threshold_sweep(rows, "score", gates)
    return d.select(
        "threshold", "groups_accepted", "groups_catastrophic", "renders_accepted", "samples", "at95", "at99", "over",
        r6(F.col("catastrophic_risk_upper"), "catastrophic_risk_upper"), r6(F.col("coverage_per_source"), "coverage_per_source"), "contract_met", "eligible", "selected",
    )
