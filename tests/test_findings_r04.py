"""Cases of the fourth round."""

from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import functions as F

from rasterlake.operators import chains as H, contours as C, gradients as G, hypotheses as Y
from rasterlake.plans.chain_queries import fit_sql
from test_growth_r03 import moved


def test_a_covariance_that_is_zero_but_for_rounding_points_as_in_the_sql(spark):
    rng = random.Random(1)
    rows = [(c, k, None if c == 29 and k % 7 == 3 else round(rng.expovariate(1)) / 4 / 10, float(k)) for c in range(30) for k in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE chain (chain_id BIGINT, k BIGINT, px DOUBLE, py DOUBLE)")
    con.executemany("INSERT INTO chain VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"WITH {fit_sql('4 PRECEDING AND CURRENT ROW', 'l')} SELECT chain_id, k, round(0.5 * atan2(2 * sxy, sxx - syy), 4) FROM l WHERE k > 0").fetchall()
    points = spark.createDataFrame(rows, "chain_id long, k long, px double, py double")
    got = H.side_fits(points, 4).filter("k > 0").select("chain_id", "k", F.round("left_angle", 4)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_an_image_of_any_size_tries_every_list_of_stops(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_PIXELS", 10)
    monkeypatch.setattr(G, "BUDGETS", ((5, (2, 4, 8)), (20, (2, 4)), (30, (4,))), raising=False)
    px = spark.createDataFrame([(n, x, y, 90 + 3 * x, 40 + 2 * y, 90, 255) for n in range(2) for x in range(4 + n) for y in range(4)], "image_id long, x int, y int, r int, g int, b int, a int")
    got = {r.image_id: sorted((m.kind, len(m.stops)) for m in r.models) for r in G.colour_candidates(px).collect()}
    every = sorted([("solid", 1), *[(k, n) for k in ("linear", "radial") for n in (2, 4, 8)]])
    assert [k for k, _ in got[0]].count("solid") == 1 and got == {0: every, 1: every}


def test_the_centre_of_a_large_image_is_found_from_all_pixels(spark):
    dots = spark.range(300 * 256).select(F.lit(1).alias("image_id"), (F.col("id") % 300).alias("x"), F.expr("id div 300").alias("y"))
    px = dots.select("*", *[F.when(F.col("x") % 2 == 1, 255).otherwise(0).alias(c) for c in "rgb"])
    (r,) = G.radial_centre(px).collect()
    assert r.error > 1000  # at every second pixel all are alike


def test_a_candidate_of_the_envelope_moves_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(k % 3, f"c{k:05}", f"g{k % 7}", None if k == 5 else k % 10 > 0, float(k % 50), 40.0 if k % 9 == 0 else None) for k in range(6000)]
        df = spark.createDataFrame(rows, "image_id long, candidate_id string, digest string, valid boolean, lower double, achievable double")
        d = Y.prune_envelope(df, F.array(F.concat(F.lit("c"), F.substring("digest", 2, 1))), Y.EnvelopeConfig(budget=4, per_class=0))
        assert moved(d.select("image_id", "candidate_id", "status")) < 2 * 6000
        got = {r.candidate_id: r.status for r in d.collect()}
        assert len(got) == 6000 and got["c00000"] == "invalid" and got["c00005"] == "duplicate"  # not known to be valid
        assert sorted(got.values()).count("kept") == 12 and sum(s in ("kept", "budget", "dominated") for s in got.values()) == 21
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def shuffled(spark) -> int:
    """Rows that all stages so far have written for others."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_points_and_segments_lie_in_few_cells(spark):
    xs = [random.Random(k).uniform(0, 50) for k in range(401)]
    segs = spark.createDataFrame([(1, k, xs[k], float(k), xs[k + 1], k + 1.0) for k in range(400)], "chain_id long, sid long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, k, xs[k] + 0.4, k + 0.3, 1.0, 0.0, 2.5, 1.0, 2.0) for k in range(400)], "chain_id long, k long, px double, py double, nx double, ny double, halfwidth double, weight_ds double, corr_length double")
    before = shuffled(spark)
    (r,) = H.residual_code(points, segs).collect()
    rows = shuffled(spark) - before
    assert r.samples == 400 and rows < 2600, rows
    near = {r.k: (r.sid, r.distance) for r in H.nearest_segment(points, segs).collect()}

    def distance(px, py, k):
        dx = xs[k + 1] - xs[k]
        t = min(1.0, max(0.0, ((px - xs[k]) * dx + py - k) / (dx * dx + 1)))
        return math.hypot(xs[k] + t * dx - px, k + t - py)

    for k in range(400):
        d, sid = min((distance(xs[k] + 0.4, k + 0.3, j), j) for j in range(400))
        assert near[k][0] == sid and math.isclose(near[k][1], d, rel_tol=1e-9)


def test_boundary_points_and_their_probes_move_once(spark):
    rows = [(1, x, y, max(0.0, min(1.0, 0.5 + (9 - math.hypot(x - 21, y - 11)) / 5))) for x in range(40) for y in range(23)]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, v double")
    d = C.boundary_observations(px, 0.5, "v", noise=0.01)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        rows = moved(d)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    got = d.collect()
    assert len(got) > 100 and all(r.nx * (21.5 - r.px) + r.ny * (11.5 - r.py) > 0 for r in got)
    assert rows < 4000, rows


def test_patches_give_what_the_pixels_give(spark):
    rng = random.Random(3)
    field = spark.createDataFrame([(1, x, y, rng.random()) for x in range(40) for y in range(23)], "image_id long, x int, y int, v double")
    points = spark.createDataFrame([(1, k, rng.uniform(0.5, 39.5), rng.uniform(0.5, 22.5), rng.uniform(-1, 1), rng.uniform(-1, 1)) for k in range(300)], "image_id long, pid long, px double, py double, ox double, oy double")
    at = lambda c: F.floor((F.col(c) - 0.5) / C.PATCH).alias(f"__t{c[1]}")
    d = points.select("*", at("px"), at("py")).join(C.patches(field, ["v"]), ["image_id", "__tx", "__ty"])
    got = {r.pid: r.a for r in d.select("pid", C.in_patch(F.col("px") + F.col("ox"), F.col("py") + F.col("oy"), "v").alias("a")).collect()}
    moved_points = points.withColumns({"px": F.col("px") + F.col("ox"), "py": F.col("py") + F.col("oy")})
    want = {r.pid: r.a for r in C.bilinear(moved_points, field, "v", "a").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
