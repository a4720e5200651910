"""Invariants and hand-made cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import hashing, stats
from rasterlake.operators import chains as C, corpus as K, fields as W, hypotheses as H, regions as R
from rasterlake.operators.prefix import running
from rasterlake.operators.quantiles import index_quantiles
from rasterlake.operators.digests import ordered_digest
from rasterlake.operators.reliability import SweepGates, risk_coverage, threshold_sweep
from rasterlake.session import cut
from rasterlake.sources import images as I


def grid_rows(image, rows, on="#"):
    return [(image, x, y, c == on) for y, r in enumerate(rows) for x, c in enumerate(r)]


SCHEMA = "image_id long, x int, y int, inside boolean"


def flood(cells, conn):
    left, n = set(cells), 0
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    while left:
        n += 1
        stack = [left.pop()]
        while stack:
            x, y = stack.pop()
            for dx, dy in steps:
                if (x + dx, y + dy) in left:
                    left.discard((x + dx, y + dy))
                    stack.append((x + dx, y + dy))
    return n


def test_known_bounds():
    got = stats.upper_bound([0, 0, 1], [100, 300, 100], 0.95)
    assert np.allclose(got, [0.0295130496, 0.0099360819, 0.0465598115], atol=1e-9)
    assert list(stats.upper_bound([0, 3], [0, 3], 0.99)) == [1.0, 1.0]
    big = stats.upper_bound([0], [10**7], 0.99)[0]
    assert abs(big - (1 - 0.01 ** (1 / 10**7))) < 1e-12


def test_required_groups(spark):
    row = spark.range(1).select(stats.required_groups(F.lit(0.99), F.lit(0.01)).alias("n")).first()
    assert row.n == 459


@pytest.mark.parametrize("groups,deficit,met", [(459, 0, True), (458, 1, False)])
def test_contract_needs_459_clean_groups(spark, groups, deficit, met):
    rows = spark.range(groups).select(
        F.col("id").alias("group_id"), F.lit("A").alias("profile"), F.lit(True).alias("mandatory"), F.lit(True).alias("accepted"), F.lit(False).alias("catastrophic"), F.lit("b").alias("bucket")
    )
    row = risk_coverage(rows, ["bucket"], F.lit("block"), F.lit(True)).first()
    assert (row.group_deficit, row.contract_met) == (deficit, met)


def test_fnv_vectors(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select(hashing.fnv1a64(F.col("s")).cast("string").alias("h")).collect()
    assert [int(r.h) for r in rows] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


def test_euler_matches_components_on_all_3x3(spark):
    rows = [(k, i % 3, i // 3, bool(k >> i & 1)) for k in range(512) for i in range(9)]
    px = cut(spark.createDataFrame(rows, SCHEMA))
    for conn in (4, 8):
        want = {}
        for k in range(512):
            fg = {(i % 3, i // 3) for i in range(9) if k >> i & 1}
            bg = {(x, y) for x in range(-1, 4) for y in range(-1, 4)} - fg
            want[k] = (flood(fg, conn), flood(bg, 12 - conn) - 1)
        local = {r.image_id: r.euler for r in R.euler_number(px, conn).collect()}
        sig = {r.image_id: (r.components, r.holes) for r in R.signature(px, conn).collect()}
        assert sig == want
        assert local == {k: c - h for k, (c, h) in want.items()}


def test_ring_diagonal_and_stripe(spark):
    rows = grid_rows(1, ["#####", "#...#", "#.#.#", "#...#", "#####"]) + grid_rows(2, ["#.", ".#"]) + grid_rows(3, ["...", "###", "..."])
    px = spark.createDataFrame(rows, SCHEMA)
    got = {r.image_id: (r.components, r.holes, r.euler) for r in R.signature(px, 4).collect()}
    assert got == {1: (2, 1, 1), 2: (2, 0, 2), 3: (1, 0, 1)}
    assert {r.image_id: r.components for r in R.signature(px, 8).collect()}[2] == 1


def test_regions_across_tiles(spark):
    rows = [(1, x, 0, True) for x in range(200)] + [(1, x, 2, x != 130) for x in range(200)]
    px = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.when(F.col("inside"), 1))
    got = R.regions(px, "label", 4).groupBy("region").count().collect()
    assert sorted(r["count"] for r in got) == [69, 130, 200]


def merge_tree(values, conn):
    """Direct union-find over descending levels, for comparison."""
    h, w = values.shape
    birth, root, events = {}, {}, []

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    for level in sorted(set(values.flat), reverse=True):
        batch = [(x, y) for y in range(h) for x in range(w) if values[y, x] == level]
        for p in batch:
            root[p], birth[p] = p, level
        for x, y in batch:
            for dx, dy in steps:
                q = (x + dx, y + dy)
                if q in root:
                    a, b = find((x, y)), find(q)
                    if a != b:
                        if min(birth[a], birth[b]) > level:
                            events.append(("merge", int(level), int(min(birth[a], birth[b]) - level)))
                        if birth[a] < birth[b]:
                            a, b = b, a
                        root[b] = a
        events += [("birth", int(level), 0) for r in {find(p) for p in batch} if birth[r] == level]
    return sorted(events)


def test_persistence_equals_union_find(spark):
    rng = random.Random(3)
    images = {k: np.array([[rng.randrange(6) * 80 for _ in range(7)] for _ in range(6)]) for k in range(12)}
    rows = [(k, x, y, v[y, x] / 512.0) for k, v in images.items() for y in range(6) for x in range(7)]
    px = spark.createDataFrame([(k, x, y, float(v)) for k, x, y, v in rows], "image_id long, x int, y int, v double")
    got = R.persistence_events(px, "v", 4).collect()
    for k, v in images.items():
        up = sorted(("birth" if r.kind == "component_birth" else "merge", round(r.level * 512), round(r.persistence * 512)) for r in got if r.image_id == k and r.kind in ("component_birth", "bridge_merge"))
        down = sorted(("birth" if r.kind == "gap_birth" else "merge", round((1 - r.level) * 512), round(r.persistence * 512)) for r in got if r.image_id == k and r.kind in ("gap_birth", "gap_merge"))
        assert up == merge_tree(v, 4)
        assert down == merge_tree(512 - v, 8)


def test_scan_rounds_equal_a_walk(spark):
    rng = random.Random(5)
    rows = [(k, float(i), f"h{i}", rng.randrange(1, 60)) for k in range(6) for i in range(40)] + [(9, float(i), f"h{i}", 10 + i % 7) for i in range(4500)]
    df = spark.createDataFrame(rows, "image_id long, total_bits double, hypothesis_id string, memory_bytes long")
    got = {(r.image_id, r.hypothesis_id): r.scan for r in H.memory_scan(df, "image_id", ["total_bits", "hypothesis_id"], "memory_bytes", 150, 7).collect()}
    for image in {r[0] for r in rows}:
        used = taken = 0
        for _, _, h, need in (r for r in rows if r[0] == image):
            fits = taken < 7 and used + need <= 150
            assert got[image, h] == ("candidate_budget" if taken >= 7 else "considered" if fits else "memory_budget")
            used, taken = used + need * fits, taken + fits


def test_certificate_needs_a_calibrated_model(spark):
    rows = spark.range(600).select(F.col("id").alias("group_id"), F.lit("A").alias("profile"), F.lit(True).alias("mandatory"), F.lit(True).alias("accepted"), F.lit(False).alias("catastrophic"))
    cases = [(F.lit(None).cast("string"), True, False), (F.lit("iid"), True, False), (F.lit("block"), False, False), (F.lit("block"), True, True)]
    for model, calibrated, met in cases:
        row = risk_coverage(rows, [], model, F.lit(calibrated)).first()
        assert row.contract_met is met and (row.likelihood_refusal is None) is met


def test_rows_without_a_score_stay_in_the_totals(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("group_id"), F.lit("A").alias("profile"), F.lit(True).alias("mandatory"), F.lit(False).alias("catastrophic"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).alias("score"), F.lit(10).alias("samples"), F.lit(10).alias("at95"), F.lit(10).alias("at99"), F.lit(0.1).alias("max_px"), F.lit(True).alias("accepted"),
    )
    row = threshold_sweep(rows, "score", SweepGates(0.4, 0.4, 0.5)).first()
    assert (row.groups_total, row.renders_total, row.coverage_per_source, row.eligible) == (1000, 1000, 0.5, True)


def test_thinning_leaves_the_frame(spark):
    full = grid_rows(1, ["#####"] * 5) + grid_rows(2, ["##", "##"])
    left = {(r.image_id, r.x, r.y) for r in W.thin(spark.createDataFrame(full, SCHEMA)).collect() if r.inside}
    frame = {(1, x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4)}
    assert frame <= left and {p for p in left if p[0] == 2} == {(2, x, y) for x in (0, 1) for y in (0, 1)}


def test_correlation_length_beyond_one_block(spark):
    rows = [("slow", k, float(k)) for k in range(100)] + [("flat", k, 1.0) for k in range(9)] + [("short", k, float(k)) for k in range(3)] + [("saw", k, float(k % 2)) for k in range(40)]
    chain = spark.createDataFrame(rows, "chain_id string, k long, px double")
    got = {r.chain_id: (r.lag, r.length) for r in C.correlation_length(chain, "px", 0.5).collect()}
    v = np.arange(100) - 49.5
    want = next(lag for lag in range(1, 50) if (v[: 100 - lag] * v[lag:]).sum() / (v * v).sum() < 1 / np.e)
    assert want > 8 and got == {"slow": (want, want * 0.5), "flat": (1, 0.5), "short": (1, 0.5), "saw": (1, 0.5)}


def test_digest_tree_of_four_levels(spark):
    def fold(texts, width):
        level = [f"{len(t)}:{t}" for t in texts]
        while True:
            level = [hashlib.sha256("\n".join(level[i : i + width]).encode()).hexdigest() for i in range(0, len(level), width)]
            if len(level) == 1:
                return level[0]

    groups = {"a": [f"t{i:04d}" for i in range(200)], "b": ["only"], "c": [f"u{i}" for i in range(5)]}
    rows = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "g string, t string")
    got = {r.g: r.digest for r in ordered_digest(rows, ["g"], ["t"], F.col("t"), fan_out=4).collect()}
    assert got == {g: fold(sorted(ts), 4) for g, ts in groups.items()}


def test_beta_function_of_large_counts():
    # a coin thrown 4e8 times: the normal limit with continuity correction
    n, k = 4e8, 2e8 + 10_000
    assert abs(stats.incomplete_beta([k], [n - k + 1], [0.5])[0] - 0.1586673524) < 1e-7
    for a, b, x in ((2, 3, 0.3), (30, 4, 0.95), (1, 60, 0.01)):  # the chance of at least a successes in a + b - 1 trials
        n = a + b - 1
        want = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
        assert abs(stats.incomplete_beta([a], [b], [x])[0] - want) < 1e-12


def test_running_total_and_quantiles_on_one_hot_key(spark):
    rows = [("hot", i, (i * 37) % 101) for i in range(500)] + [(f"k{i}", i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r.g, r.i): r.s for r in running(df, ["g"], ["i"], {"s": "v"}).collect()}
    total = 0
    for g, i, v in rows[:500]:
        total += v
        assert got[(g, i)] == total
    q = {r.g: r for r in index_quantiles(df, ["g"], "v", {"m": ("floor", 0.5), "p": ("ceil", 0.95)}).collect()}
    vals = sorted(v for g, _, v in rows if g == "hot")
    assert (q["hot"].m, q["hot"].p) == (vals[250], vals[int(np.ceil(499 * 0.95))])


def test_distance_transform_brute_force(spark):
    rng = random.Random(1)
    cells = {(x, y): rng.random() < 0.8 for x in range(12) for y in range(9)}
    px = spark.createDataFrame([(1, x, y, v) for (x, y), v in cells.items()], SCHEMA)
    for r in W.distance_transform(px).collect():
        want = min((r.x - x) ** 2 + (r.y - y) ** 2 for (x, y), v in cells.items() if not v)
        assert r.d2 == (want if cells[(r.x, r.y)] else 0)


def test_stencil_is_independent_of_tiles(spark):
    from rasterlake.operators.stencil import neighbours

    rows = [(1, x, y, float((x * 7 + y * 13) % 17)) for x, y in itertools.product(range(20), range(20))]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, v double")
    pick = lambda tile: sorted(map(tuple, neighbours(df, ["image_id"], ["v"], tile=tile).select("x", "y", "e.v", "nw.v", "s.v").collect()))
    assert pick(64) == pick(4)


def test_a_cluster_must_name_a_shared_folder():
    from rasterlake import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Unset:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Unset()})()})()

    fake = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
    assert session.one_machine("local[8]") and not session.one_machine("local-cluster[3,2,1024]")


def test_documents_differ_at_any_depth(spark):
    a = '{"schema":{"v":1},"normative":{"x":{"y":{"z":{"w":1,"u":[1,2]}}},"same":{"q":1},"gone":{"k":1},"kind":{"o":1}},"informational":{"t":5}}'
    b = '{"schema":{"v":2},"normative":{"x":{"y":{"z":{"w":2,"u":[1,2]}}},"same":{"q":1},"kind":7,"new":null},"informational":{"t":6}}'
    rows = lambda j: spark.createDataFrame([("d", j)], "id string, doc string")
    got = {r.path: (r.before, r.after) for r in K.document_drift(rows(a), rows(b), "id", "doc").collect()}
    assert got == {
        "/schema/v": ("1", "2"), "/normative/x/y/z/w": ("1", "2"), "/normative/gone": ("<object>", "<absent>"),
        "/normative/kind": ("<object>", "7"), "/normative/new": ("<absent>", "null"),
    }


def test_image_scan_keeps_what_it_refuses(spark, tmp_path):
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    def png(width, height, pixels):
        lines = b"".join(b"\0" + bytes(v for p in pixels[y * width : (y + 1) * width] for v in p) for y in range(height))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    pixels = [(10 * i, 255 - i, i) for i in range(6)]
    (tmp_path / "good.png").write_bytes(png(3, 2, pixels))
    (tmp_path / "wide.png").write_bytes(png(40, 1, [(0, 0, 0)] * 40))
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = I.scan_images(spark, str(tmp_path), I.DecodeLimits(max_dimension_px=20)).collect()
    good = sorted((r.y, r.x, r.r, r.g, r.b, r.a) for r in got if r.image_id.endswith("good.png"))
    assert good == [(i // 3, i % 3, *pixels[i], 255) for i in range(6)]
    assert {r.image_id.rsplit("/", 1)[-1]: r.refusal.kind for r in got if r.refusal} == {"wide.png": "dimension_too_large", "bad.png": "undecodable"}
    files = {r.name: (r.length, r.sha256, r.declared) for r in I.artifact_inventory(spark, str(tmp_path), ["bad.png"]).collect()}
    assert files["bad.png"] == (8, hashlib.sha256(b"no image").hexdigest(), True) and not files["good.png"][2]
