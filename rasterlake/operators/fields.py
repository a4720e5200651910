"""Scalar fields on rasters: interior confidence, filters, labelling, distance."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rasterlake.functions.color import CODE, clamp, observation, soft, vec_dot, vec_norm, vec_sub
from rasterlake.operators.stencil import EIGHT, FOUR, INNER_BITS, MARGIN, WORD, around, core, east, forget, once_and_more, tiled, west, with_margins, word_above, word_rows
from rasterlake.session import cut

KEYS = ["image_id"]
P = ["pr", "pg", "pb", "pa"]


@dataclass(frozen=True)
class InteriorConfig:
    gradient_scale: float = 8.0
    spread_scale: float = 12.0
    alpha_scale_codes: float = 8.0
    mixed_gradient_ratio: float = 8.0
    edge_reach_px: float = 1.5
    alpha_zero_codes: float = 1.0


def observed(px: DataFrame, blend: str = "encoded_srgb") -> DataFrame:
    """Pixel table with the premultiplied vector and its quantisation cells."""
    return px.withColumns(observation(*[F.col(c) for c in "rgba"], blend))


def interior(px: DataFrame, cfg: InteriorConfig = InteriorConfig()) -> DataFrame:
    """Gradient, spread, alpha variation, distance to mixed pixels and weight.

    Two stencils share one tile partitioning. Distances beyond the reach do not
    change the weight, so the 3x3 neighbourhood decides them all.
    """
    vec = lambda d: [F.col(f"{d}.{c}") for c in P]
    here = [F.col(c) for c in P]
    d = around(tiled(px, KEYS, halo=2), KEYS, P)
    q = [F.col(c) for c in ("qr", "qg", "qb", "qa")]
    unit = F.greatest(vec_norm(q), F.lit(0.5 * CODE))
    dx, dy = vec_sub(vec("e"), vec("w")), vec_sub(vec("s"), vec("n"))
    gradient = F.sqrt(vec_dot(dx, dx) + vec_dot(dy, dy)) * 0.5 / unit
    spread = F.greatest(*[vec_norm(vec_sub(vec(n), here)) for n in EIGHT]) / unit
    change = F.greatest(*[F.abs(F.col(f"{n}.pa") - F.col("pa")) for n in EIGHT]) * 255.0
    d = d.withColumns({"gradient": gradient, "spread": spread, "alpha_variation": change})
    d = forget(d)
    zero = cfg.alpha_zero_codes * CODE
    partial = (F.col("pa") > zero) & (F.col("pa") < 1.0 - zero)
    d = d.withColumn("mixed", partial | (F.col("gradient") > cfg.mixed_gradient_ratio))
    d = around(d, KEYS, ["mixed"], clamp=False)
    near = lambda names: F.greatest(*[F.coalesce(F.col(f"{n}.mixed"), F.lit(False)) for n in names])
    distance = (
        F.when(F.col("mixed"), 0.0).when(near(FOUR), 1.0).when(near(EIGHT[4:]), math.sqrt(2.0)).otherwise(cfg.edge_reach_px)
    )
    weight = (
        soft(F.col("gradient"), cfg.gradient_scale)
        * soft(F.col("spread"), cfg.spread_scale)
        * soft(F.col("alpha_variation"), cfg.alpha_scale_codes)
        * F.least(F.lit(1.0), distance / cfg.edge_reach_px)
    )
    d = d.withColumns({"edge_distance": distance, "gives_rgb": F.col("pa") > zero, "weight": weight})
    return core(forget(d))


# ---- filters ----------------------------------------------------------------


def binomial(px: DataFrame, v: str = "v", out: str = "out") -> DataFrame:
    """1-2-1 separable low pass with clamped borders."""
    d = around(tiled(px, KEYS), KEYS, [v])
    g = lambda n: F.col(f"{n}.{v}")
    line = lambda a, b, c: (a + b * 2.0 + c) / 4.0
    rows = [line(g("nw"), g("n"), g("ne")), line(g("w"), F.col(v), g("e")), line(g("sw"), g("s"), g("se"))]
    return core(forget(d.withColumn(out, line(*rows))))


def detail_preserving(px: DataFrame, v: str = "v", out: str = "out") -> DataFrame:
    """Local extrema stay; elsewhere the mean of the middle seven of 3x3."""
    d = around(tiled(px, KEYS), KEYS, [v])
    near = [F.col(f"{n}.{v}") for n in EIGHT]
    here = F.col(v)
    keep = (here >= F.greatest(*near)) | (here <= F.least(*near))
    ordered = F.array_sort(F.array(here, *near))
    middle = F.aggregate(F.slice(ordered, 2, 7), F.lit(0.0), lambda a, e: a + e) / 7.0
    return core(forget(d.withColumn(out, F.when(keep, here).otherwise(middle))))


def kernel_taps(kind: str, sigma: float = 1.0) -> list[float]:
    """Normalised taps: the triangle, or a Gaussian cut at three sigma."""
    if kind == "triangle":
        return [0.25, 0.5, 0.25]
    r = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(raw)
    return [t / total for t in raw]


def _convolve(d: DataFrame, taps: list[float], v: str, out: str) -> DataFrame:
    """Both passes of a separable kernel on a tiled table, borders clamped."""
    from rasterlake.operators.stencil import column_window, row_window

    r = len(taps) // 2

    def one(axis: str, w, source: str) -> Column:
        total = F.lit(0.0)
        first = F.min(axis).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        last = F.max(axis).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        lo = F.first(source).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        hi = F.last(source).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        for k, t in zip(range(-r, r + 1), taps):
            here = F.col(source) if k == 0 else F.lead(source, k).over(w)
            total = total + F.when(F.col(axis) + k < first, lo).when(F.col(axis) + k > last, hi).otherwise(here) * t
        return total

    d = d.withColumn("__row", one("x", row_window(KEYS), v))
    return d.withColumn(out, one("y", column_window(KEYS), "__row")).drop("__row")


def convolve(px: DataFrame, taps: list[float], v: str = "v", out: str = "out") -> DataFrame:
    return core(_convolve(tiled(px, KEYS, halo=len(taps) // 2), taps, v, out))


@dataclass(frozen=True)
class RefineConfig:
    iterations: int = 30
    data_weight: float = 1.0
    knee: float = 0.05
    step: float = 0.15
    deconvolutions: int = 10
    deconvolution_step: float = 0.7
    per_pass: int = 6


def _refine(px: DataFrame, v: str, out: str, iterations: int, per_pass: int, reach: int, step) -> DataFrame:
    """Run ``iterations`` stencil updates, ``per_pass`` of them per exchange."""
    d = px.withColumn("__f", F.col(v)).withColumn(out, F.col(v))
    done = 0
    while done < iterations:
        n = min(per_pass, iterations - done)
        t = tiled(d, KEYS, halo=n * reach)
        for _ in range(n):
            t = step(t)
        d = core(t)
        done += n
        if done < iterations:
            d = cut(d)  # the next pass re-tiles; keep the lineage short
    return d.drop("__f")


def tv_huber(px: DataFrame, v: str = "v", out: str = "out", cfg: RefineConfig = RefineConfig()) -> DataFrame:
    """Total-variation descent with a Huber knee, fixed steps, clamped."""

    def step(t: DataFrame) -> DataFrame:
        t = around(t, KEYS, [out], diagonal=False)
        g = (F.col(out) - F.col("__f")) * cfg.data_weight
        for n in FOUR:
            diff = F.col(out) - F.col(f"{n}.{out}")
            g = g + F.when(F.abs(diff) <= cfg.knee, diff).otherwise(F.signum(diff) * cfg.knee)
        return t.withColumn("__u", clamp(F.col(out) - g * cfg.step)).drop(*FOUR, out).withColumnRenamed("__u", out)

    return _refine(px, v, out, cfg.iterations, cfg.per_pass, 1, step)


def deconvolve(px: DataFrame, taps: list[float], v: str = "v", out: str = "out", cfg: RefineConfig = RefineConfig()) -> DataFrame:
    """Bounded Landweber iteration, projected into [0, 1] after each step."""

    def step(t: DataFrame) -> DataFrame:
        t = _convolve(t, taps, out, "__k")
        return t.withColumn("__u", clamp(F.col(out) + (F.col("__f") - F.col("__k")) * cfg.deconvolution_step)).drop(out, "__k").withColumnRenamed("__u", out)

    return _refine(px, v, out, cfg.deconvolutions, cfg.per_pass, len(taps) // 2, step)


# ---- labelling --------------------------------------------------------------


def critical_cells(d: DataFrame, v: str = "inside") -> Column:
    """The 2x2 cell down-right of a pixel has exactly one diagonal set."""
    a, b, c, e = F.col(v), F.col(f"e.{v}"), F.col(f"s.{v}"), F.col(f"se.{v}")
    return F.coalesce((a & e & ~b & ~c) | (b & c & ~a & ~e), F.lit(False))


def threshold_labelling(px: DataFrame, level: float, saddle: str, v: str = "v") -> DataFrame:
    """Foreground of a field with its critical 2x2 cells resolved as a batch.

    ``saddle``: thresholded, join_diagonal or split_diagonal. The rewrite of a
    cell is decided from the thresholded snapshot. Also flags the critical cells
    of the snapshot and those left afterwards.
    """
    d = tiled(px.withColumn("inside", F.col(v) >= level), KEYS, halo=3)
    d = around(d, KEYS, ["inside"], clamp=False)
    d = forget(d.withColumn("critical", critical_cells(d)))
    if saddle != "thresholded":
        d = around(d, KEYS, ["critical"], clamp=False)
        hit = F.greatest(F.col("critical"), *[F.coalesce(F.col(f"{n}.critical"), F.lit(False)) for n in ("w", "n", "nw")])
        d = forget(d.withColumn("inside", F.when(hit, F.lit(saddle == "join_diagonal")).otherwise(F.col("inside"))))
        d = around(d, KEYS, ["inside"], clamp=False)
        d = forget(d.withColumn("residual", critical_cells(d)))
    else:
        d = d.withColumn("residual", F.col("critical"))
    return core(d)


def smooth_labels(candidates: DataFrame, edge_bits: float = 0.25) -> DataFrame:
    """One synchronous pass of data cost plus disagreeing neighbours.

    ``candidates`` has one row per pixel with ``label`` (NULL = transparent) and
    ``costs``, an array of (label, data) over the few paints of the image.
    """
    d = around(tiled(candidates, KEYS), KEYS, ["label"], clamp=False, diagonal=False)
    near = F.array(*[F.col(f"{n}.label") for n in FOUR])

    def total(e: Column) -> Column:
        other = F.size(F.filter(near, lambda m: m.isNotNull() & (m != e["label"])))
        return F.struct((e["data"] + other * edge_bits).alias("cost"), e["label"].alias("label"))

    best = F.array_min(F.transform("costs", total))["label"]
    return core(d.withColumn("smoothed", F.when(F.col("label").isNotNull(), best)).drop(*FOUR))


LINES_ROWS = 200_000  # rows of whole columns that are worked on at once


def lowest_parabolas(y: np.ndarray, line: np.ndarray, g: np.ndarray) -> np.ndarray:
    """min((y - y')^2 + g'^2) over the rows y' of the same line that have a ``g``; -1 for a line without any.

    Rows are sorted by line and y; ``g`` is -1 where a row has none. The row that wins does not move back as y grows, so
    the middle row of every open stretch is decided in each step and bounds the search of both sides: all stretches of
    all lines together, and as many steps as the longest line has binary digits.
    """
    out = np.full(len(y), -1, np.int64)
    site = np.flatnonzero(g >= 0)
    if not len(site):
        return out
    sy, square = y[site], g[site] ** 2
    heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    ends = np.r_[heads[1:], len(y)]
    first, last = np.searchsorted(site, heads), np.searchsorted(site, ends) - 1
    some = last >= first
    low, high, left, right = heads[some], ends[some] - 1, first[some], last[some]
    while len(low):
        middle = (low + high) // 2
        size = right - left + 1
        starts = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(starts - left, size)
        cost = (np.repeat(y[middle], size) - sy[at]) ** 2 + square[at]
        best = np.minimum.reduceat(cost, starts)
        hit = np.flatnonzero(cost == np.repeat(best, size))
        winner = at[hit[np.searchsorted(hit, starts)]]
        out[middle] = best
        up, down = low < middle, middle < high
        low, high = np.r_[low[up], middle[down] + 1], np.r_[middle[up] - 1, high[down]]
        left, right = np.r_[left[up], winner[down]], np.r_[winner[up], right[down]]
    return out


def _columns(batches):
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> pa.Table:
        pixels = table.select(["image_id", "x"]).to_pandas()
        line = (pixels != pixels.shift()).any(axis=1).cumsum().to_numpy()
        g = table["__g"].fill_null(-1).to_numpy()
        best = lowest_parabolas(table["y"].to_numpy().astype(np.int64), line, g)
        return table.drop_columns(["__g"]).append_column("d2", pa.array(best, pa.int64(), mask=best < 0))

    def whole(table: pa.Table) -> int:
        """Rows before the last line, which may go on in the next batch."""
        keys = table.select(["image_id", "x"]).to_pandas()
        return int(((keys != keys.iloc[-1]).any(axis=1)).to_numpy().nonzero()[0].max(initial=-1)) + 1

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LINES_ROWS:
            table = pa.Table.from_batches(held)
            n = whole(table)
            if n:
                yield from solve(table.slice(0, n)).to_batches()
                held = table.slice(n).to_batches()
    if held and sum(b.num_rows for b in held):
        yield from solve(pa.Table.from_batches(held)).to_batches()


def distance_transform(px: DataFrame, inside: str = "inside") -> DataFrame:
    """Adds ``d2``: exact squared distance of a pixel to the nearest background, NULL in an image without any.

    Running last/first values give the nearest background along each row, which is at most as long as the ingest limit
    allows. Columns then stream through tasks in order, where each takes the lower envelope of the parabolas of its rows:
    work grows with the pixels times the digits of the height, and the rows are moved twice.
    """
    w = Window.partitionBy("image_id", "y").orderBy("x")
    site = F.when(~F.col(inside), F.col("x"))
    back = F.last(site, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(site, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("x") - back, ahead - F.col("x")).cast("bigint")
    ordered = px.withColumn("__g", gap).repartition("image_id", "x").sortWithinPartitions("image_id", "x", "y")
    return ordered.mapInArrow(_columns, StructType([*px.schema.fields, StructField("d2", LongType())]))


def _thin_rule(d: DataFrame, phase: int) -> DataFrame:
    """One phase on words: ``gone`` are the pixels that it takes from ``inside``."""
    d = d.withColumns({"__n": word_above("inside", KEYS, -1), "__s": word_above("inside", KEYS, 1)})
    up, here, down = F.col("__n"), F.col("inside"), F.col("__s")
    ring = [up, east(up), east(here), east(down), down, west(down), west(here), west(up)]  # clockwise from the top
    _, two = once_and_more(ring)
    _, two_empty = once_and_more([F.bitwise_not(v) for v in ring])
    turn, turns = once_and_more([F.bitwise_not(a).bitwiseAND(b) for a, b in zip(ring, ring[1:] + ring[:1])])
    n, e, s, w = ring[0], ring[2], ring[4], ring[6]
    both = lambda *v: F.bitwise_not(reduce(Column.bitwiseAND, v))
    sides = both(n, e, s).bitwiseAND(both(e, s, w)) if phase == 0 else both(n, e, w).bitwiseAND(both(n, s, w))
    rules = [here, F.col("inner"), two, two_empty, turn, F.bitwise_not(turns), sides]
    d = d.withColumn("gone", reduce(Column.bitwiseAND, rules))
    return d.withColumn("inside", F.col("inside").bitwiseAND(F.bitwise_not(F.col("gone")))).drop("__n", "__s")


def thin(px: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Thin foreground to its centre line: two alternating parallel rules until
    neither removes a pixel. The frame is never touched, so rasters under three
    pixels stay as they are. Rules work on words of one bit per pixel; four rounds
    fit into the margin of a word, then words are written out and margins renewed."""
    flags = {"inside": F.col("inside"), "unknown": F.col("inside").isNull()}
    words = cut(word_rows(px, KEYS, flags))
    top = F.expr("length(bin(there)) - 1")  # place of the highest bit
    size = words.groupBy(*KEYS).agg(F.max(F.col("c") * WORD + top).alias("__mx"), F.max("y").alias("__my"))
    d = words.join(size, KEYS)
    at = lambda x: F.expr(f"if(c = floor({x} / {WORD}), shiftleft(1L, cast(pmod({x}, {WORD}) as int)), 0L)")
    frame = at("0").bitwiseOR(at("__mx"))
    inner = F.when(F.col("y").between(1, F.col("__my") - 1) & (F.col("c") >= 0), F.col("there").bitwiseAND(F.bitwise_not(frame))).otherwise(F.lit(0).cast("bigint"))
    cols = ["inside", "unknown", "there", "inner"]
    d = d.select(*KEYS, "y", "c", "inside", "unknown", "there", inner.alias("inner"))
    done, rounds = False, 0
    while not done:
        if rounds >= max_rounds:
            raise RuntimeError("thinning did not settle")
        d = with_margins(d, KEYS, cols)
        last = []
        for k in range(MARGIN):
            d = _thin_rule(d, k % 2)
            if k >= MARGIN - 2:
                last.append(f"__g{k}")
                d = d.withColumn(last[-1], F.col("gone").bitwiseAND(INNER_BITS) != 0)
        core_bits = [F.shiftrightunsigned(F.col(n).bitwiseAND(INNER_BITS), MARGIN).alias(n) for n in cols]
        d = cut(d.select(*KEYS, "y", "c", *core_bits, F.greatest(*last).alias("moved")).filter("there != 0"))
        done = d.filter("moved").isEmpty()
        rounds += MARGIN // 2
    bit = lambda n: F.expr(f"shiftrightunsigned({n}, i) & 1 = 1")
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).filter(bit("there"))
    return d.select(*KEYS, (F.col("c") * WORD + F.col("i")).cast(px.schema["x"].dataType).alias("x"), "y", F.when(~bit("unknown"), bit("inside")).alias("inside"))
