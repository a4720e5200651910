"""The beam moves hypotheses once, and images too large for a list get the same statuses."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rasterlake.operators import hypotheses as H
from tests.test_growth_r03 import moved


def hypotheses(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(700):
        image = rnd.choice([None, *range(40)])
        row = (image, f"h{k}", rnd.choice(["d0", "d1", "d2", "d3", "d4", "d5", None]), rnd.choice("xyz"), rnd.choice("uv"), rnd.randrange(60) / 2, rnd.choice([None, *range(1, 70)]))
        rows += [row] * (1 + (k % 9 == 0))
    return spark.createDataFrame(rows, "image_id long, hypothesis_id string, delivery string, topology_class string, formation_class string, total_bits double, memory_bytes long")


def test_lists_and_rounds_agree(spark, monkeypatch):
    df, cfg = hypotheses(spark), H.BeamConfig(3, 14.0, 2, 2, 4, 100)
    got = []
    for most in (256, 15, 0):
        monkeypatch.setattr(H, "LISTED_ROWS", most)
        d = H.diverse_beam(df, cfg)
        assert d.columns == [*df.columns, "status"]
        got.append(sorted(map(tuple, d.collect()), key=str))
    assert got[0] == got[1] == got[2]
    assert {r[-1] for r in got[0]} == {"kept", "beam_width", "bit_margin", "memory_budget", "candidate_budget", "delivery_equivalent"}


def test_the_beam_moves_hypotheses_once(spark):
    df = hypotheses(spark)
    n = df.filter("image_id is not null").count()
    beam = H.diverse_beam(df)
    assert moved(beam) == n
    assert moved(H.status_ledger(beam.filter("image_id is not null"), "image_id", ["kept"])) <= n + 41
    assert beam.filter(F.col("image_id").isNull() & (F.col("status") != "delivery_equivalent")).isEmpty()
