"""Streams over several batches beside one pass over all rows."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from rasterlake.operators import reliability as R
from rasterlake.streaming import journal as J

ROW = "key string, payload double, at int, id int"


def test_journal_keeps_the_first_batch_and_quarantines_conflicts(spark):
    folder, store, state = (J.new_folder(spark, n) for n in ("in", "store", "state"))
    batches = [
        [("a", 1.0, 5, 1), ("a", 2.0, 3, 2), ("b", None, 1, 1), ("h", 7.0, 1, 0)] + [("h", 7.0 if i % 3 else 8.0, 2, i) for i in range(50)],
        [("a", 2.0, 0, 0), ("a", 9.0, 0, 0), ("b", None, 9, 9), ("b", 4.0, 1, 1), ("c", 3.0, 1, 1)],
        [],
        [("c", 3.0, 0, 0), ("a", 1.0, 7, 7)],
    ]
    schema = spark.createDataFrame([], ROW).schema
    for k, rows in enumerate(batches):
        J.arrive(spark.createDataFrame(rows, ROW).repartition(2), folder, k)
        J.ingest(J.read_stream(spark, folder, schema, "*.parquet"), store, state)
    kept = {r.key: r.payload for r in J.stored(spark, store).collect()}
    assert kept == {"a": 2.0, "b": None, "h": 7.0, "c": 3.0}
    bad = Counter((r.key, r.payload) for r in J.quarantined(spark, store).collect())
    assert bad == {("a", 1.0): 2, ("a", 9.0): 1, ("b", 4.0): 1, ("h", 8.0): 17}
    assert J.stored(spark, store).filter("key = 'c'").first().batch == 1
    # nothing new: nothing is read or written again
    before = J.stored(spark, store).count() + J.quarantined(spark, store).count()
    J.ingest(J.read_stream(spark, folder, schema, "*.parquet"), store, state)
    assert J.stored(spark, store).count() + J.quarantined(spark, store).count() == before


def test_certificates_of_a_stream_equal_those_of_its_rows(spark):
    rng = random.Random(1)
    columns = "group_id long, profile string, accepted boolean, catastrophic boolean, mandatory boolean"
    rows = [(rng.randrange(40), rng.choice("NAR"), rng.random() < 0.3, rng.random() < 0.2, rng.random() < 0.7) for _ in range(400)]
    parts = [rows[:150], rows[150:160], rows[160:]]
    folder, out, state = (J.new_folder(spark, n) for n in ("in", "out", "state"))
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, columns)
        J.arrive(df, folder, k)
        J.running_certificate(J.read_stream(spark, folder, df.schema, "*.parquet"), out, state)
    got = J.certificates(spark, out, F.lit("block"), F.lit(True)).orderBy("batch").collect()
    for k, r in enumerate(got):
        upto = spark.createDataFrame(sum(parts[: k + 1], []), columns)
        (want,) = R.risk_coverage(upto.withColumn("one", F.lit(1)), ["one"], F.lit("block"), F.lit(True)).collect()
        assert {c: r[c] for c in J.COUNTS} == {c: want[c] for c in J.COUNTS} and abs(r.catastrophic_risk_upper - want.catastrophic_risk_upper) < 1e-12
    assert len(got) == 3


def test_journal_tells_nan_from_null_and_counts_per_batch(spark):
    folder, store, state = (J.new_folder(spark, n) for n in ("in", "store", "state"))
    nan = float("nan")
    batches = [[("a", None, 1, 1), ("a", nan, 2, 2), ("b", nan, 1, 1)], [("a", nan, 3, 3), ("a", nan, 4, 4), ("b", nan, 2, 2)]]
    for k, rows in enumerate(batches):
        J.arrive(spark.createDataFrame(rows, ROW), folder, k)
        J.ingest(J.read_stream(spark, folder, spark.createDataFrame([], ROW).schema, "*.parquet"), store, state)
    kept = {r.key: (r.payload is None, r.batch) for r in J.stored(spark, store).collect()}
    assert kept == {"a": (True, 0), "b": (False, 0)}
    assert Counter((r.key, r.batch) for r in J.quarantined(spark, store).collect()) == {("a", 0): 1, ("a", 1): 2}
