"""Operators of one-off algorithms beside brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import evidence as V, fields as W, gradients as G, hypotheses as H


def brute_policies(rows):
    """(first, second) -> groups, catastrophic groups, renders, from every level and every row."""
    grid = set()
    for level in {a for _, a, _, _ in rows}:
        upto = [(b, bad) for _, a, b, bad in rows if a <= level]
        good, worst = [b for b, bad in upto if not bad], [b for b, bad in upto if bad]
        if good:
            grid.add((level, max(good)))
            below = [b for b in good if worst and b < min(worst)]
            if below:
                grid.add((level, max(below)))
    out = {}
    for x, y in grid:
        hit = [(g, bad) for g, a, b, bad in rows if a <= x and b <= y]
        out[x, y] = (len({g for g, _ in hit}), len({g for g, bad in hit if bad}), len(hit))
    return out


@pytest.mark.parametrize("seed,real", [(1, True), (2, False)])
def test_policies_equal_all_pairs(spark, seed, real):
    rng = random.Random(seed)
    value = rng.random if real else lambda: rng.randrange(6)
    rows = [(rng.randrange(25), value(), value(), rng.random() < 0.15) for _ in range(220)]
    df = spark.createDataFrame(rows, f"group_id int, p {'double' if real else 'int'}, s {'double' if real else 'int'}, bad boolean")
    scored = H.score_policies(df, H.policy_grid(df, "p", "s", "bad"), "p", "s", "bad")
    assert {(r.max_first, r.max_second): (r.groups_accepted, r.groups_catastrophic, r.renders_accepted) for r in scored.collect()} == brute_policies(rows)
    assert "Cartesian" not in scored._jdf.queryExecution().executedPlan().toString()


def mixture_rows(alpha, flatness, quant):
    h, w = alpha.shape
    return [(1, x, y, float(alpha[y, x]), float(flatness[y, x]), float(quant[y, x]), None) for y in range(h) for x in range(w)]


MIX = "image_id long, x int, y int, alpha double, flatness double, alpha_quant double, refusal string"


def interiors(spark, alpha, flatness, quant, **kw):
    return V.semi_transparent(spark.createDataFrame(mixture_rows(alpha, flatness, quant), MIX).repartition(3), **kw).collect()


def test_interior_needs_area_and_flatness_in_units_of_its_noise(spark):
    small = np.zeros((8, 8))
    small.flat[[9, 10, 17]] = 0.5
    zero, quant = np.zeros((8, 8)), np.full((8, 8), 0.004)
    assert interiors(spark, small, zero, quant) == []
    full = np.full((8, 8), 0.5)
    (r,) = interiors(spark, full, zero, quant)
    assert (r.largest_region_px, r.regions, r.coverage_span, r.thickness) == (64, 1, 0.0, 4.0)
    slope = np.full((8, 8), 0.02)
    assert interiors(spark, full, slope, np.full((8, 8), 0.002)) == []
    assert len(interiors(spark, full, slope, np.full((8, 8), 0.02))) == 1


def test_interior_shapes_equal_a_flood_across_tiles(spark):
    rng = np.random.default_rng(4)
    alpha = np.where(rng.random((90, 150)) < 0.62, 0.3 + 0.1 * rng.random((90, 150)), 0.0)
    (r,) = interiors(spark, alpha, np.zeros_like(alpha), np.ones_like(alpha), min_area=1)
    flat, best, regions = alpha > 0, None, 0
    seen = np.zeros_like(flat)
    for y, x in np.argwhere(flat):
        if seen[y, x]:
            continue
        regions += 1
        stack, own = [(y, x)], []
        seen[y, x] = True
        while stack:
            i, j = stack.pop()
            own.append((i, j))
            for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= a < 90 and 0 <= b < 150 and flat[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    stack.append((a, b))
        if best is None or len(own) > len(best):
            best = own
    members = set(best)
    outline = sum((i + a, j + b) not in members for i, j in best for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    values = np.array([alpha[p] for p in best])
    assert (r.largest_region_px, r.regions, r.flat_px) == (len(best), regions, int(flat.sum()))
    assert np.allclose([r.thickness, r.coverage, r.coverage_span], [2 * len(best) / outline, values.mean(), np.ptp(values)])


def encode(v):
    v = min(1.0, max(0.0, v))
    return int((12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5)


def test_colour_models_choose_what_made_the_image(spark):
    images = {
        1: [(x, y, 80, 120, 200) for y in range(32) for x in range(32)],
        2: [(0, 0, 80, 120, 200)],
        3: [(x, y, encode(x / 47), 0, encode(1 - x / 47)) for y in range(24) for x in range(48)],
        4: [(x, y, *[encode(np.hypot(x - 16, y - 16) / 22.627)] * 3) for y in range(33) for x in range(33)],
        5: [(x, y, *((255, 0, 0) if x < 24 else (0, 0, 255))) for y in range(16) for x in range(48)],
    }
    rows = [(k, *p, 255) for k, px in images.items() for p in px] + [(6, 0, 0, 1, 2, 3, 254)]
    random.Random(0).shuffle(rows)
    px = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    models = G.colour_models(px)
    got = {r.image_id: r for r in G.colour_choice(models).collect()}
    assert {k: r.kind for k, r in got.items()} == {1: "solid", 2: "solid", 3: "linear", 4: "radial", 5: "linear"}
    assert got[3].margin_bits > 0 and got[5].discontinuities == 1 and got[5].stop_count == 4
    again = {r.image_id: r for r in G.colour_choice(G.colour_models(px.orderBy(F.rand(3)))).collect()}
    assert {k: (r.kind, round(r.total_bits, 6)) for k, r in again.items()} == {k: (r.kind, round(r.total_bits, 6)) for k, r in got.items()}


def test_soft_paints_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    cover, px, want = [], [], {}
    for image, m in ((1, 2), (2, 5), (3, 16)):
        n = 200
        a = rng.random((n, m)) * (rng.random((n, m)) < 0.4)
        v, w, q = rng.random((n, 3)), rng.random(n) + 0.1, rng.random((n, 3)) * 0.01
        cover += [(image, i, 0, k, float(a[i, k])) for i in range(n) for k in range(m) if a[i, k] > 0]
        px += [(image, i, 0, float(w[i]), *map(float, v[i]), *map(float, q[i])) for i in range(n)]
        for ch in range(3):
            wt = w / np.maximum(q[:, ch], 1 / 510) ** 2
            normal = a.T @ (a * wt[:, None])
            normal[np.diag_indices(m)] += 1e-6 * max(1.0, normal.diagonal().max())
            want[image, ch] = np.linalg.solve(normal, a.T @ (wt * v[:, ch]))
    cover.append((4, 0, 0, 0, 0.5))
    px.append((4, 0, 0, 1.0, 0.1, 0.2, 0.3, 0.0, 0.0, 0.0))
    c = spark.createDataFrame(cover, "image_id long, x int, y int, label int, coverage double").repartition(3)
    p = spark.createDataFrame(px, "image_id long, x int, y int, weight double, vr double, vg double, vb double, qr double, qg double, qb double")
    rows = V.soft_paints(c, p, 1.0, 1e-6).collect()
    assert [r.refusal for r in rows if r.image_id == 4] == ["insufficient_support"]
    for r in rows:
        if r.image_id < 4:
            assert np.allclose([r.paint_r, r.paint_g, r.paint_b], [want[r.image_id, ch][r.label] for ch in range(3)], atol=1e-8)


def test_lowest_parabolas_equal_all_pairs():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 300):
        line = np.sort(rng.integers(0, max(1, n // 9), n))
        y = np.concatenate([np.sort(rng.choice(3 * n, k, replace=False)) for k in np.bincount(line) if k])
        g = np.where(rng.random(n) < 0.5, rng.integers(0, 20, n), -1)
        got = W.lowest_parabolas(y, line, g)
        for i in range(n):
            near = (line == line[i]) & (g >= 0)
            assert got[i] == (((y[near] - y[i]) ** 2 + g[near] ** 2).min() if near.any() else -1)


def test_distances_across_tiles_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(7)
    inside = rng.random((2, 70, 140)) < 0.985
    inside[1] = True
    px = spark.createDataFrame([(k, x, y, bool(inside[k, y, x]), "more") for k in range(2) for y in range(70) for x in range(140)], "image_id long, x int, y int, inside boolean, d string")
    d = W.distance_transform(px)
    assert d.columns == [*px.columns, "d2"]
    sites = np.argwhere(~inside[0])
    for r in d.filter("image_id = 0").collect():
        assert r.d2 == ((sites - [r.y, r.x]) ** 2).sum(axis=1).min()
    assert d.filter("image_id = 1 and d2 is not null").isEmpty() and W.distance_transform(px.limit(0)).count() == 0
