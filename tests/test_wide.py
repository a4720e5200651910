"""Rasters of several tiles and run slices beside plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import fields as W, gradients as G, regions as R
from rasterlake.sources.fixtures import WideLake

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wide(spark):
    return WideLake(spark, SF).grid().withColumn("label", F.floor(F.col("v") * 3).cast("int")).cache()


def labelled(label, conn):
    """Least pixel number of each region, by repeated minima over equal neighbours."""
    h, w = label.shape
    out = np.arange(h * w).reshape(h, w)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else [])
    while True:
        before = out.copy()
        for dy, dx in steps:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
            same = label[a] == label[b]
            low = np.minimum(out[a], out[b])
            out[a] = np.where(same, low, out[a])
            out[b] = np.where(same, np.minimum(out[a], out[b]), out[b])
        # whole regions take the least of their pixels' values
        flat = out.ravel()
        out = flat[flat].reshape(h, w)
        if (before == out).all():
            return out


@pytest.mark.parametrize("conn", [4, 8])
def test_regions_cross_tiles(wide, conn):
    got = R.regions(wide, "label", conn).select("image_id", "x", "y", "region").toPandas()
    labels = wide.select("image_id", "x", "y", "label").toPandas()
    for image, px in labels.groupby("image_id"):
        grid = np.full((208, 256), -1)
        grid[px.y, px.x] = px.label
        mine = got[got.image_id == image]
        found = np.full((208, 256), -1, dtype=np.int64)
        found[mine.y, mine.x] = mine.region
        want = labelled(grid, conn)
        pairs = set(zip(want.ravel().tolist(), found.ravel().tolist()))
        assert len(pairs) == len(np.unique(want)) == len(np.unique(found))  # one name for one region
        assert max(np.ptp(np.argwhere(want == k), axis=0).max() for k in np.unique(want)[:200]) > 64 or conn == 4


def test_thinning_crosses_tiles(spark):
    rng = np.random.default_rng(2)
    grid = np.zeros((90, 100), bool)
    for _ in range(40):
        y, x = rng.integers(0, 84), rng.integers(0, 94)
        grid[y : y + rng.integers(2, 9), x : x + rng.integers(2, 9)] = True
    px = spark.createDataFrame([(1, x, y, bool(grid[y, x])) for y in range(90) for x in range(100)], "image_id long, x int, y int, inside boolean")
    got = W.thin(px).filter("inside").select("x", "y").toPandas()
    want = grid.copy()
    while True:
        removed = 0
        for phase in (0, 1):
            p = np.pad(want, 1).astype(int)
            ring = [p[1 + dy : 91 + dy, 1 + dx : 101 + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            count = sum(ring)
            turns = sum((a == 0) & (b == 1) for a, b in zip(ring, ring[1:] + ring[:1]))
            n, e, s, w = ring[0], ring[2], ring[4], ring[6]
            side = (n * e * s == 0) & (e * s * w == 0) if phase == 0 else (n * e * w == 0) & (n * s * w == 0)
            gone = want & (count >= 2) & (count <= 6) & (turns == 1) & side
            gone[[0, -1], :] = gone[:, [0, -1]] = False
            want &= ~gone
            removed += gone.sum()
        if not removed:
            break
    assert set(zip(got.x, got.y)) == {(x, y) for y, x in np.argwhere(want)}


def test_gradient_lane_finds_a_ramp_and_a_ring(spark):
    def image(k, f):
        return [(k, x, y, *[int(255 * min(1.0, max(0.0, f(x + 0.5, y + 0.5)))) for _ in range(3)], 255) for y in range(40) for x in range(80)]

    rows = image(1, lambda x, y: x / 80) + image(2, lambda x, y: np.hypot(x - 20.25, y - 20) / 70) + image(3, lambda x, y: 0.2 if x < 40 else 0.9)
    rows += [(4, 0, 0, 1, 2, 3, 254)]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    line = {r.image_id: r for r in G.direction(px).collect()}
    assert abs(line[1].dx - 1) < 1e-6 and abs(line[1].dy) < 1e-6 and (line[1].x0, line[1].x1) == (0.5, 79.5)
    assert {r.image_id: (r.cx, r.cy) for r in G.radial_centre(px).collect()}[2] == (20.25, 20.0)
    profiles = G.profile(px, G.direction(px), G.linear_offset())
    leaps = {r.image_id: r.jumps for r in G.jumps(profiles).collect()}
    assert leaps[1] == [] and leaps[3] == [32]
    ends = {r.image_id: r for r in G.end_colours(profiles).collect()}
    assert ends[1].r0 < 0.05 and ends[1].r1 > 0.7
    assert {r.image_id: r.refusal for r in G.refusals(px).collect()} == {1: None, 2: None, 3: None, 4: "non_opaque_source"}
