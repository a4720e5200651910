"""Streaming jobs drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators.reliability import RiskTarget
from rasterlake.plans.functions_queries import cp_sql
from rasterlake.plans.reliability_queries import CERT, COUNTS, FLAGS, cert_select
from rasterlake.registry import query
from rasterlake.streaming import journal as J

KEY = "concat_ws('/', user_id, event_type, date_format(ts, 'yyyy-MM-dd'))"
KEY_SQL = "j AS (SELECT concat_ws('/', user_id, event_type, CAST(ts AS DATE)::VARCHAR) AS key, value AS payload, ts, event_id FROM events), f AS (SELECT key, arg_min(payload, (ts, event_id)) AS first FROM j GROUP BY key)"


def drained(t):
    """The events as they arrive in three parts of each day; the stream is resumed after each of them."""
    events = t.table("events")
    folder, store, state = (J.new_folder(t.spark, n) for n in ("arrivals", "store", "state"))
    for part in range(3):
        J.arrive(events.filter(F.expr(f"hour(ts) div 8 = {part}")), folder, part)
        rows = J.read_stream(t.spark, folder, events.schema, "*.parquet")
        J.ingest(rows.select(F.expr(KEY).alias("key"), F.col("value").alias("payload"), F.col("ts").alias("at"), F.col("event_id").alias("id")), store, state)
    return store


@query("x01_journal_store", "", f"{KEY_SQL} SELECT key, first AS payload FROM f")
def x01(t):
    return J.stored(t.spark, drained(t)).select("key", "payload")


@query("x01_journal_quarantine", "", f"{KEY_SQL} SELECT key, payload FROM j JOIN f USING (key) WHERE payload <> first")
def x01b(t):
    return J.quarantined(t.spark, drained(t)).select("key", "payload")


V_SQL = """v AS (SELECT l_orderkey AS group_id, l_returnflag AS profile, l_linestatus = 'O' AS accepted, l_discount >= 0.09 AND l_tax >= 0.07 AS catastrophic, l_linenumber <= 4 AS mandatory FROM lineitem WHERE l_returnflag <> 'R')"""


@query(
    "x02_running_verdicts",
    "",
    f"{V_SQL} SELECT group_id, CASE WHEN bool_or(accepted AND catastrophic) THEN 'accepted_catastrophic' WHEN bool_or(accepted) THEN 'accepted_clean' ELSE 'abstained' END AS verdict FROM v WHERE mandatory GROUP BY group_id",
)
def x02(t):
    s = outcomes(J.read_stream(t.spark, t.dir, t.table("lineitem").schema, "lineitem.parquet"))
    out, state = J.new_folder(t.spark, "verdicts"), J.new_folder(t.spark, "state")
    J.running_verdicts(s, out, state)
    return J.latest_verdicts(t.spark, out)


def outcomes(line):
    return line.select(
        F.col("l_orderkey").alias("group_id"), F.col("l_returnflag").alias("profile"), (F.col("l_linestatus") == "O").alias("accepted"),
        ((F.col("l_discount") >= 0.09) & (F.col("l_tax") >= 0.07)).alias("catastrophic"), (F.col("l_linenumber") <= 4).alias("mandatory"),
    )


@query(
    "x02_running_certificate",
    "",
    f"""RECURSIVE {V_SQL.replace("FROM lineitem WHERE", ", (l_linenumber - 1) // 3 AS part FROM lineitem WHERE")}, g AS (SELECT p.range AS batch, group_id, {FLAGS} FROM v JOIN range(0, 3) p ON v.part <= p.range GROUP BY ALL),
    s AS (SELECT batch, batch AS id, {COUNTS} FROM g GROUP BY batch), trials AS (SELECT id, groups_catastrophic AS k, groups_accepted AS n FROM s), {cp_sql(0.99)} SELECT batch, {CERT} FROM s JOIN cp USING (id)""",
)
def x02b(t):
    line = t.table("lineitem")
    folder, out, state = (J.new_folder(t.spark, n) for n in ("arrivals", "certificates", "state"))
    for part in range(3):
        J.arrive(line.filter(F.expr(f"(l_linenumber - 1) div 3 = {part}")), folder, part)
        J.running_certificate(outcomes(J.read_stream(t.spark, folder, line.schema, "*.parquet")), out, state)
    return cert_select(J.certificates(t.spark, out, F.lit("block"), F.lit(True), RiskTarget()), "batch")


@query(
    "x03_progress",
    "",
    f"{KEY_SQL}, e AS (SELECT DISTINCT concat_ws('/', user_id, k, CAST(ts AS DATE)::VARCHAR) AS key FROM events CROSS JOIN (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error']) AS k)) SELECT key FROM e ANTI JOIN f USING (key)",
)
def x03(t):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")]))
    e = t.table("events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), kinds.alias("k"))
    expected = e.select(F.concat_ws("/", "user_id", "k", "day").alias("key")).distinct()
    return J.progress(expected, J.stored(t.spark, drained(t)))
