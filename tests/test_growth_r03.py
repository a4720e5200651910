"""What moves between tasks: rasters as words, runs and rows, not as pixels."""

from __future__ import annotations

import random
import re

import pyspark.sql.functions as F

from rasterlake.operators import fields as W, regions as R
from rasterlake.operators.stencil import neighbours, word_rows
from rasterlake.sources.fixtures import Lake

PX = "image_id long, x int, y int"


def moved(df) -> int:
    """Rows that the exchanges of a plan wrote."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        kids = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
        todo += kids
        if p.nodeName() == "Exchange":
            total += p.metrics().apply("shuffleRecordsWritten").value()
    return total


def blobs(width: int, height: int, seed: int) -> dict[tuple[int, int], bool]:
    rnd = random.Random(seed)
    dots = {(rnd.randrange(width), rnd.randrange(height)) for _ in range(width * height // 9)}
    return {(x, y): any((x + i, y + j) in dots for i in (0, 1, 2) for j in (0, 1)) for x in range(width) for y in range(height)}


def plain_thinning(px: dict[tuple[int, int], bool]) -> dict[tuple[int, int], bool]:
    mx, my = max(x for x, _ in px), max(y for _, y in px)
    while True:
        start = px
        for phase in (0, 1):
            gone = set()
            for (x, y), v in px.items():
                p = [px.get((x + i, y + j), False) for i, j in [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]]
                n, e, s, w = p[::2]
                sides = not (n and e and s) and not (e and s and w) if phase == 0 else not (n and e and w) and not (n and s and w)
                if v and 1 <= x < mx and 1 <= y < my and 2 <= sum(p) <= 6 and sum(not a and b for a, b in zip(p, p[1:] + p[:1])) == 1 and sides:
                    gone.add((x, y))
            px = {k: v and k not in gone for k, v in px.items()}
        if px == start:
            return px


def test_thinning_moves_words(spark):
    images = {1: blobs(131, 17, 1), 2: blobs(48, 30, 2), 3: {(x, y): True for x in range(60) for y in range(40)}}
    df = spark.createDataFrame([(k, x, y, v) for k, px in images.items() for (x, y), v in px.items()], f"{PX}, inside boolean")
    got = {(r.image_id, r.x, r.y): r.inside for r in W.thin(df).collect()}
    assert got == {(k, *at): v for k, px in images.items() for at, v in plain_thinning(px).items()}
    assert word_rows(df, ["image_id"], {"inside": F.col("inside")}).count() == 3 * 17 + 30 + 2 * 40


def test_euler_curve_moves_words(spark):
    rnd = random.Random(3)
    rows = [(k, x, y, rnd.random()) for k in range(3) for x in range(100) for y in range(20)]
    df = spark.createDataFrame(rows, f"{PX}, v double").repartition(1)
    for conn in (4, 8):
        d = R.euler_curve(df, "v", [100, 256], conn)
        got = {(r.image_id, r.level): r.euler for r in d.collect()}
        for level in (100, 256):
            px = df.withColumn("inside", F.floor(F.col("v") * 512 + 0.5) >= level)
            assert {(r.image_id, level): r.euler for r in R.euler_number(px, conn).collect()}.items() <= got.items()
        assert moved(d) < 1000 + len(rows)  # the levels do not multiply the pixels


def test_grid_moves_cells(spark, tmp_path):
    line = [(k, 3 * k, 1 + k % 2, 0.05) for k in range(40)] + [(None, 1, 1, 0.05), (1, None, 1, 0.05), (1, 1, None, 0.05)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    d = Lake(spark, str(tmp_path)).grid()
    got = d.collect()
    assert len(got) == 3 * 4096 and len({(r.image_id, r.x, r.y) for r in got}) == len(got)
    assert {(r.x, r.y) for r in got if r.image_id == 2 and r.v > 0} == {(3 * k % 64, k % 64) for k in range(1, 40, 2)}
    assert moved(d) < 4096


def test_stencils_are_dealt_into_many_small_partitions(spark):
    df = spark.createDataFrame([(1, x, 0, x) for x in range(9)], f"{PX}, v int")
    near = neighbours(df, ["image_id"], ["v"])
    assert re.search(r"hashpartitioning\(image_id#\d+L, __ty#\d+L, __tx#\d+L, (\d+)\)", near._jdf.queryExecution().executedPlan().toString())[1] == "1024"
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8MB"
    assert near.count() == 9


def test_region_sizes_are_sums_of_runs(spark):
    rnd = random.Random(5)
    rows = [(k, x, y, rnd.choice([0, 1, None])) for k in range(2) for x in range(90) for y in range(12)]
    df = spark.createDataFrame(rows, f"{PX}, label int")
    for conn in (4, 8):
        want = {(r.image_id, r.label, r.region): r.n for r in R.regions(df, "label", conn).groupBy("image_id", "label", "region").agg(F.count("*").alias("n")).collect()}
        assert {(r.image_id, r.label, r.region): r.pixels for r in R.region_sizes(df, "label", conn).collect()} == want
