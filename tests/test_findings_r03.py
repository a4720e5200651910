"""Cases of the third round: missing channels, windows without spread, empty courts."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import functions as F

from rasterlake.operators import chains as H, courts as C, evidence as V, gradients as G
from rasterlake.sources.fixtures import Lake

PX = "image_id long, x int, y int"


def test_an_image_without_a_channel_keeps_its_row_of_residuals(spark):
    rows = [(i, x, 0, 1.0, 0.1 if i else None, 0.1 if i else None, None) for i in range(2) for x in range(4)]
    mix = spark.createDataFrame(rows, f"{PX}, pa double, residual double, signed double, refusal string")
    got = {r.image_id: r for r in V.residual_indicators(mix).collect()}
    assert (got[0].mean_codes, got[0].p95_codes, got[0].mixed_mass, got[0].mean_run_px) == (None, None, None, 1.0)
    assert math.isclose(got[1].p95_codes, 25.5) and got[1].mixed_mass == 0 and got[1].mean_run_px == 4


def test_a_profile_keeps_the_channels_that_an_image_has(spark):
    rows = [(1, x, y, None, 40 * x, 200) for x in range(4) for y in range(4)]
    px = spark.createDataFrame(rows, f"{PX}, r int, g int, b int")
    profile = G.profile(px, G.direction(px), G.linear_offset())
    got = profile.collect()
    assert len(got) == 64 and {r.r for r in got} == {None}
    assert len({(r.g, r.b) for r in got}) == 1 and None not in (got[0].g, got[0].b)
    (ends,) = G.end_colours(profile).collect()
    assert math.isclose(ends.b0, got[0].b) and math.isclose(ends.g1, got[0].g)


def test_residuals_that_are_zero_or_missing_have_no_correlation(spark):
    rows = [(i, x, y, *[0.5 if i else None] * 4, *[0.1] * 4, *[0.5] * 4) for i in range(2) for x in range(4) for y in range(4)]
    px = spark.createDataFrame(rows, ", ".join([PX, *[f"{k}{c} double" for k in "pqm" for c in "rgba"]]))
    priors = px.select("image_id").distinct().select("image_id", *[F.lit(0.0).alias(k) for k in V.PRIORS])
    got = {r.image_id: r for r in V.raster_likelihood(px, V.LikelihoodConfig((0.1,) * 4, 3), priors).collect()}
    assert (got[0].lag_x, got[0].lag_y, got[0].deadzone, got[0].iid_bits) == (0.0, 0.0, None, None)
    assert (got[1].lag_x, got[1].lag_y, got[1].deadzone) == (0.0, 0.0, 64)
    flat = spark.createDataFrame([(1, x, y, 0.0) for x in range(3) for y in range(3)], f"{PX}, r double")
    assert [(r.lag_x, r.lag_y) for r in V.lag_correlation(flat).collect()] == [(0.0, 0.0)]


def test_codec_spread_of_a_missing_channel_is_unknown(spark):
    rows = [(1, x, y, None, 1, 2, 3) for x in range(4) for y in range(4)]
    res = spark.createDataFrame(rows, f"{PX}, dr int, dg int, db int, da int")
    for codec in V.CODECS:
        (r,) = V.codec_spread(res, ["image_id"], codec).collect()
        assert (r.dc_rms, r.ac_rms) == (None, None) and r.alpha_rms > 0


def test_gates_of_no_admitted_row_are_unknown(spark):
    fields = "admitted boolean, catastrophic boolean, p95_px double, p99_px double, max_px double, palette_delta long, channel_delta long, bits_per_block double, runtime_ms long"
    rows = spark.createDataFrame([(False, False, 0.1, 0.2, 0.3, 1, 1, 5.0, 10)], fields)
    (r,) = C.derive_gates(rows).collect()
    assert (r.paint_delta_codes, r.p95_px, r.runtime_p95_ms) == (None, None, None)


def test_half_cents_and_half_units_go_to_the_even_number(spark, tmp_path):
    line = [(1, 1, 1, k, q, 10.0, d, 0.045, "A", "O", datetime.datetime(2024, 1, 1)) for k, (q, d) in enumerate([(2.5, 0.125), (3.5, 0.375), (4.6, 0.03)], 1)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, "1-URGENT", "O")], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    t = Lake(spark, str(tmp_path))
    assert [(r.palette_delta, r.quantity) for r in t.meas().orderBy("cell_id").collect()] == [(12, 2), (38, 4), (3, 5)]
    assert sorted(r.memory_bytes for r in t.hyp().collect()) == [2, 4, 5]


def test_a_side_of_equal_px_points_one_way(spark):
    points = spark.createDataFrame([(c, k, px, float(k)) for c, px in enumerate((0.1, 7.3, 33.37)) for k in range(2, 40)] + [(c, k, 1.7 * k, float(k)) for c in range(3) for k in range(2)], "chain_id long, k long, px double, py double")
    got = H.side_fits(points, 4).filter("k >= 6").collect()
    assert len(got) == 3 * 34 and all(math.isclose(r.left_angle, math.pi / 2) for r in got)


def test_a_mean_between_two_codes_takes_the_upper_one(spark):
    # sums of the same pixels (codes 8 and 9) in two orders
    df = spark.createDataFrame([(0.0025799793601651183,), (0.0025799793601651187,)], "r double")
    stops = F.array(F.struct(F.lit(0.0).alias("offset"), "r"))
    assert [r[0] for r in df.select(G.code_at(stops, F.lit(0.0), "r")).collect()] == [9, 9]


def test_candidates_are_collected_once(spark):
    px = spark.createDataFrame([(n, x, y, 20 * x, 30 * y, n, 255) for n in range(3) for x in range(4) for y in range(4)], f"{PX}, r int, g int, b int, a int")
    assert "collect_list" not in G.colour_models(px)._jdf.queryExecution().analyzed().toString()


def test_without_a_complete_pixel_only_the_straight_line_is_tried(spark):
    profile = spark.createDataFrame([(n, b, None if n else b / 64, 0.2, 0.3) for n in range(2) for b in range(64)], "image_id long, bin int, r double, g double, b double")
    got = sorted((r.image_id, r.budget) for r in G.stop_lists(profile).collect())
    assert got == [(0, 2), (0, 4), (0, 8), (1, 2)]
