"""Ordered chains: arclength, resampling, turning, fits and spatial joins.

Windows of bounded reach run on index chunks with a halo; unbounded prefixes use
the sliced running sums, so no chain has to fit one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.functions.codes import residual_bits, rho
from rasterlake.operators.prefix import chunked, neighbour, ordered_index, running
from rasterlake.session import cut

KEYS = ["chain_id"]
CELL = 4.0
SLACK = 1e-9  # of a cell: what touches a side counts on both


def chunk_window() -> Window:
    return Window.partitionBy(*KEYS, "__chunk").orderBy("k")


def with_arclength(points: DataFrame) -> DataFrame:
    """Add ``step`` to the next point and ``s``, the arclength up to the point."""
    d = neighbour(points, KEYS, "k", ["px", "py"], 1, "_n")
    step = F.sqrt((F.col("px_n") - F.col("px")) ** 2 + (F.col("py_n") - F.col("py")) ** 2)
    d = d.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return running(d, KEYS, ["k"], {"s": "step"}, exclusive=True)


def resample(points: DataFrame, spacing: float = 0.5) -> DataFrame:
    """Uniform positions on every chain by an as-of join on arclength.

    A segment is listed in every unit of arclength it touches, which makes the
    range condition an equality plus a filter.
    """
    d = cut(with_arclength(points))
    total = d.groupBy(*KEYS).agg(F.sum("step").alias("length")).filter(F.col("length") > 0)
    n = F.greatest(F.lit(1), F.floor(F.col("length") / spacing + 0.5))
    at = total.withColumn("n", n).select(*KEYS, "length", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    at = at.withColumn("at", (F.col("i") + 0.5) * F.col("length") / F.col("n")).withColumn("__b", F.floor("at"))
    seg = d.filter(F.col("step") > 0).withColumn("__b", F.explode(F.sequence(F.floor("s"), F.floor(F.col("s") + F.col("step")))))
    # both sides are lists unrolled from small rows, which their estimate does not know: neither is broadcast
    j = at.join(seg.hint("merge"), [*KEYS, "__b"]).filter((F.col("s") <= F.col("at")) & (F.col("at") < F.col("s") + F.col("step")))
    t = (F.col("at") - F.col("s")) / F.col("step")
    return j.select(*KEYS, "i", "at", "k", (F.col("px") + t * (F.col("px_n") - F.col("px"))).alias("px"), (F.col("py") + t * (F.col("py_n") - F.col("py"))).alias("py"))


def turning(points: DataFrame, scales: list[int], cyclic: bool = False) -> DataFrame:
    """Signed turning at scale 1 and the least absolute turning over scales.

    A scale whose window leaves an open chain says nothing about that point. On a
    cyclic chain indices wrap around and scales beyond half of it are dropped.
    """
    d = points.select(*KEYS, "k", "px", "py")
    n = d.groupBy(*KEYS).agg(F.count("*").alias("n"))
    d = d.join(n, KEYS)

    def angle(s: int) -> Column:
        bx, by = F.col("px") - F.col(f"px_b{s}"), F.col("py") - F.col(f"py_b{s}")
        fx, fy = F.col(f"px_f{s}") - F.col("px"), F.col(f"py_f{s}") - F.col("py")
        some = (bx * bx + by * by > 0) & (fx * fx + fy * fy > 0) & (F.lit(2 * s) < F.col("n"))
        return F.when(some, F.atan2(bx * fy - by * fx, bx * fx + by * fy))

    if cyclic:
        for s in scales:
            for sign, tag in ((-s, f"_b{s}"), (s, f"_f{s}")):
                at = F.pmod(F.col("k") - sign, F.col("n"))
                other = d.select(*KEYS, at.alias("k"), F.col("px").alias(f"px{tag}"), F.col("py").alias(f"py{tag}"))
                d = d.join(other, [*KEYS, "k"], "left")
    else:
        d = chunked(d, KEYS, "k", max(scales))
        w = chunk_window()
        cols = {}
        for s in scales:
            for c in ("px", "py"):
                cols[f"{c}_b{s}"], cols[f"{c}_f{s}"] = F.lag(c, s).over(w), F.lead(c, s).over(w)
        d = d.withColumns(cols).filter("__core")
    flats = [F.abs(angle(s)) for s in scales]
    least = flats[0] if len(flats) == 1 else F.least(*flats)
    return d.select(*KEYS, "k", angle(scales[0]).alias("turning"), least.alias("persistent"))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: the rounding errors of product (in halves of 26 bits) and sum are added at the end."""
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    halves = _with(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), high(a).alias("ha"), high(b).alias("hb"), (a * b).alias("p")), _parts)
    return _with(halves, lambda s: s["sum"] + (((s["p"] - (s["sum"] - s["bb"])) + (s["c"] - s["bb"])) + s["low"]))


def _parts(h: Column) -> Column:
    la, lb, total = h["a"] - h["ha"], h["b"] - h["hb"], h["p"] + h["c"]
    low = ((h["ha"] * h["hb"] - h["p"]) + h["ha"] * lb + la * h["hb"]) + la * lb
    return F.struct(h["p"].alias("p"), h["c"].alias("c"), total.alias("sum"), (total - h["p"]).alias("bb"), low.alias("low"))


def _covariance(rows: Column) -> Column:
    """Covariance of (px, py) in the order of the rows, by updated means, each product added with one rounding."""

    def add(s: Column, r: Column) -> Column:
        dx, dy, n = r["py"] - s["x"], r["px"] - s["y"], s["n"] + 1.0
        y = s["y"] + dy / n
        return F.struct(n.alias("n"), (s["x"] + dx / n).alias("x"), y.alias("y"), _fused(dx, r["px"] - y, s["c"]).alias("c"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "c")])
    return F.aggregate(rows, zero, add, lambda s: s["c"] / s["n"])


UNCERTAIN = 1e-12


def side_fits(points: DataFrame, arm: int) -> DataFrame:
    """Principal direction and RMS of the trailing and the leading line.

    A side that is wider along py and whose covariance is 0 points up or down by the sign of a rounding error. Where the
    covariance is that small it is therefore taken from the rows in their order, as the SQL has it.
    """
    d = chunked(points.select(*KEYS, "k", "px", "py"), KEYS, "k", arm)
    w = chunk_window()
    out = {}
    for side, frame in (("left", w.rowsBetween(-arm, 0)), ("right", w.rowsBetween(0, arm))):
        # updated means: a side of equal px has a covariance of exactly 0, whose sign would turn the angle around
        sxx, syy, sxy = F.var_pop("px").over(frame), F.var_pop("py").over(frame), F.covar_pop("px", "py").over(frame)
        small = (F.abs(sxy) <= (sxx + syy) * UNCERTAIN) & (sxx > 0) & (syy > 0)
        sxy = F.when(small, _covariance(F.collect_list(F.when(F.col("px").isNotNull(), F.struct("px", "py"))).over(frame))).otherwise(sxy)
        out[f"{side}_n"] = F.count("*").over(frame)
        out[f"{side}_angle"] = F.atan2(sxy * 2.0, sxx - syy) * 0.5
        low = (sxx + syy - F.sqrt((sxx - syy) * (sxx - syy) + sxy * sxy * 4.0)) * 0.5
        out[f"{side}_rms"] = F.sqrt(F.greatest(low, F.lit(0.0)))
    return d.withColumns(out).filter("__core").select(*KEYS, "k", *out)


MOMENTS = {"u": "u", "v": "v", "uu": "u * u", "vv": "v * v", "uv": "u * v"}
PARALLEL = 1e-12


def corner_proposals(points: DataFrame, cyclic: bool = False) -> DataFrame:
    """Corner evidence of every position over all scales 1, 2, 4, ... below half of its chain.

    ``points``: chain_id, k (dense from 0), px, py, halfwidth. Columns: k, turning (scale 1), persistent (least turning of
    all scales that fit), line_rms and offset (lines through the widest scale on both sides: mean spread, distance of their
    intersection), saliency. Positions that far away are looked up by index and sums over a side are differences of running
    sums, so a chain may be longer than a task holds: each position becomes a logarithmic number of rows. On a cyclic
    chain indices go around and a running sum grows by the chain's total with each turn.
    """
    c = F.col
    points = cut(points.select(*KEYS, "k", "px", "py", "halfwidth"))
    size = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("px").alias("mx"), F.avg("py").alias("my"))
    size = size.withColumn("top", F.length(F.bin(c("n") - 1)) - 2)  # exponent of the largest scale
    d = points.join(size, KEYS).withColumns({"u": c("px") - c("mx"), "v": c("py") - c("my")})
    at = lambda name: points.select(*KEYS, c("k").alias(name), c("px").alias(f"{name}_x"), c("py").alias(f"{name}_y"))
    scaled = d.filter("top >= 0").withColumn("e", F.explode(F.sequence(F.lit(0), c("top")))).withColumn("s", F.expr("shiftleft(1L, e)"))
    if cyclic:
        scaled = scaled.withColumns({"back": F.pmod(c("k") - c("s"), c("n")), "fwd": F.pmod(c("k") + c("s"), c("n"))})
    else:
        scaled = scaled.withColumns({"back": c("k") - c("s"), "fwd": c("k") + c("s")}).filter("back >= 0 and fwd < n")
    met = scaled.select(*KEYS, "k", "px", "py", "e", "back", "fwd").join(at("back"), [*KEYS, "back"]).join(at("fwd"), [*KEYS, "fwd"])
    bx, by, fx, fy = c("px") - c("back_x"), c("py") - c("back_y"), c("fwd_x") - c("px"), c("fwd_y") - c("py")
    angle = F.when((bx * bx + by * by > 0) & (fx * fx + fy * fy > 0), F.atan2(bx * fy - by * fx, bx * fx + by * fy))
    turns = met.groupBy(*KEYS, "k").agg(F.max(F.when(c("e") == 0, angle)).alias("turning"), F.min(F.abs(angle)).alias("persistent")).filter("turning is not null")

    named = {f"p_{m}": e for m, e in MOMENTS.items()}
    sums = cut(running(d.select(*KEYS, "k", "u", "v"), KEYS, ["k"], named).select(*KEYS, c("k").alias("j"), *named))
    total = d.groupBy(*KEYS).agg(*[F.sum(F.expr(e)).alias(f"t_{m}") for m, e in MOMENTS.items()])
    arm = F.expr("shiftleft(1L, top)")
    low, high = c("k") - arm, c("k") + arm
    if not cyclic:
        low, high = F.greatest(low, F.lit(0)), F.least(high, c("n") - 1)
    places = {"low": low - 1, "here": c("k"), "before": c("k") - 1, "high": high}
    asked = d.filter("top >= 0").select(*KEYS, "k", "n", "u", "v", (c("k") - low + 1).alias("left_n"), (high - c("k") + 1).alias("right_n"), F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), p.cast("long").alias("place")) for t, p in places.items()])).alias("a"))
    asked = asked.select("*", c("a.tag").alias("tag"), F.pmod(c("a.place"), c("n")).alias("j"), F.floor(c("a.place") / c("n")).alias("rounds")).drop("a")
    found = asked.join(sums, [*KEYS, "j"]).join(total, KEYS)
    value = {m: c(f"p_{m}") + c("rounds") * c(f"t_{m}") for m in MOMENTS}
    wide = found.groupBy(*KEYS, "k", "u", "v", "left_n", "right_n").agg(*[F.max(F.when(c("tag") == t, value[m])).alias(f"{t}_{m}") for t in places for m in MOMENTS])
    line = {}
    for side, (a, b) in (("left", ("low", "here")), ("right", ("before", "high"))):
        mean = {m: (c(f"{b}_{m}") - c(f"{a}_{m}")) / c(f"{side}_n") for m in MOMENTS}
        sxx, syy, sxy = mean["uu"] - mean["u"] * mean["u"], mean["vv"] - mean["v"] * mean["v"], mean["uv"] - mean["u"] * mean["v"]
        low_root = (sxx + syy - F.sqrt((sxx - syy) * (sxx - syy) + sxy * sxy * 4.0)) * 0.5
        line |= {f"{side}_u": mean["u"], f"{side}_v": mean["v"], f"{side}_angle": F.atan2(sxy * 2.0, sxx - syy) * 0.5, f"{side}_rms": F.sqrt(F.greatest(low_root, F.lit(0.0)))}
    fits = wide.select(*KEYS, "k", "u", "v", *[e.alias(n) for n, e in line.items()])
    ax, ay, bx, by = F.cos("left_angle"), F.sin("left_angle"), F.cos("right_angle"), F.sin("right_angle")
    det = ax * by - ay * bx
    along = ((c("right_u") - c("left_u")) * by - (c("right_v") - c("left_v")) * bx) / F.nullif(det, F.lit(0.0))
    ox, oy = c("left_u") + ax * along - c("u"), c("left_v") + ay * along - c("v")
    fits = fits.select(*KEYS, "k", ((c("left_rms") + c("right_rms")) * 0.5).alias("line_rms"), F.when(F.abs(det) > PARALLEL, F.sqrt(ox * ox + oy * oy)).alias("offset"))
    out = turns.join(fits, [*KEYS, "k"]).join(points.select(*KEYS, "k", "halfwidth"), [*KEYS, "k"])
    fade = F.when((c("halfwidth") > 0) & c("offset").isNotNull(), F.lit(1.0) / ((c("line_rms") + c("offset")) / F.nullif(c("halfwidth"), F.lit(0.0)) + 1.0)).otherwise(0.0)
    return out.select(*KEYS, "k", "turning", "persistent", "line_rms", "offset", (F.least(c("persistent") / math.pi, F.lit(1.0)) * fade).alias("saliency"))


def corner_anchors(proposals: DataFrame, half: int) -> DataFrame:
    """Positions whose saliency is above that of all proposals within ``half`` places in the list of proposals."""
    placed = ordered_index(proposals.select(*KEYS, "k", "saliency"), KEYS, ["k"], "place")
    top = local_maxima(placed.select(*KEYS, F.col("place").alias("k"), "saliency"), "saliency", half)
    return top.select(*KEYS, F.col("k").alias("place"), "saliency").join(placed.drop("saliency"), [*KEYS, "place"]).select(*KEYS, "k", "saliency")


def local_maxima(rows: DataFrame, value: str, half: int) -> DataFrame:
    """Strict maxima of a positive value within ``half`` positions either side."""
    d = chunked(rows.select(*KEYS, "k", value), KEYS, "k", half)
    w = chunk_window()
    before, after = F.max(value).over(w.rowsBetween(-half, -1)), F.max(value).over(w.rowsBetween(1, half))
    d = d.withColumns({"__b": before, "__a": after}).filter("__core")
    top = (F.col(value) > 0) & (F.col("__b").isNull() | (F.col("__b") < F.col(value))) & (F.col("__a").isNull() | (F.col("__a") < F.col(value)))
    return d.filter(top).select(*KEYS, "k", value)


def correlation_length(points: DataFrame, value: str, step: float = 1.0) -> DataFrame:
    """First lag whose normalised autocovariance falls below 1/e, and its length.

    Lags go up to half of the chain; if none is below, that is the answer. Chains
    of fewer than four points or of one value have lag 1. Lags are searched in
    blocks that double, for the chains that have not been decided yet.
    """
    v = F.col(value)
    m = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg(v).alias("__mean"), F.var_pop(v).alias("__var"))
    half = F.floor(F.col("n") / 2).cast("int")
    m = cut(m.withColumn("__half", F.when((F.col("n") >= 4) & (F.col("__var") > 0), half).otherwise(1)))
    d = points.select(*KEYS, "k", v.alias("__v")).join(m, KEYS)
    d = cut(d.select(*KEYS, "k", (F.col("__v") - F.col("__mean")).alias("__v"), "__half", (F.col("n") * F.col("__var")).alias("__total")))
    longest = m.agg(F.max("__half")).first()[0] or 0
    other = d.select(*KEYS, F.col("k").alias("__at"), F.col("__v").alias("__w"))
    open_, found, low, high = d, None, 1, 9
    while low < longest:
        lag = F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("__half")) - 1)).alias("lag")
        pairs = open_.filter(F.col("__half") > low).select(*KEYS, "k", "__v", "__total", lag).withColumn("__at", F.col("k") + F.col("lag"))
        sums = pairs.join(other, [*KEYS, "__at"]).groupBy(*KEYS, "lag", "__total").agg(F.sum(F.col("__v") * F.col("__w")).alias("__c"))
        hits = cut(sums.filter(F.col("__c") / F.col("__total") < 1 / math.e).groupBy(*KEYS).agg(F.min("lag").alias("lag")))
        found = hits if found is None else found.unionByName(hits)
        open_ = cut(open_.filter(F.col("__half") > high).join(hits, KEYS, "left_anti"))
        if open_.isEmpty():
            break
        low, high = high, 2 * high
    out = m.withColumn("lag", F.col("__half")) if found is None else m.join(found, KEYS, "left").withColumn("lag", F.coalesce("lag", "__half"))
    return out.select(*KEYS, "n", F.col("lag").cast("int").alias("lag"), (F.col("lag") * step).alias("length"))


# ---- spatial joins ----------------------------------------------------------


def cells_of_segments(segs: DataFrame, cell: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    d = segs.withColumn("cx", F.explode(span(F.col("x1"), F.col("x2"))))
    return d.withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"))))


def projection() -> Column:
    """Place on the segment that is closest to the point, 0 to 1."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    len2 = dx * dx + dy * dy
    t = F.coalesce(((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / F.nullif(len2, F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def segment_distance() -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = projection()
    ex, ey = F.col("x1") + t * dx - F.col("px"), F.col("y1") + t * dy - F.col("py")
    return F.sqrt(ex * ex + ey * ey)


def _touched(px: Column, py: Column, dx: Column, dy: Column, pieces: Column, cell: Column) -> Column:
    """Cells met by the line from (px, py) by (dx, dy): those of the box of each of ``pieces`` equal parts."""

    def part(i: Column) -> Column:
        ax, ay = px + dx * (i / pieces), py + dy * (i / pieces)
        bx, by = px + dx * ((i + 1) / pieces), py + dy * ((i + 1) / pieces)
        span = lambda u, v: F.sequence(F.floor(F.least(u, v) / cell - SLACK), F.floor(F.greatest(u, v) / cell + SLACK))
        return F.flatten(F.transform(span(ax, bx), lambda cx: F.transform(span(ay, by), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), pieces - 1), part)))


def _segment_cells(segs: DataFrame, cell: float, more: tuple[str, ...] = ()) -> DataFrame:
    """Every segment in the cells that it runs through (not those of its bounding box)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pieces = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / cell), F.lit(1)).cast("int")
    cells = F.explode(_touched(F.col("x1"), F.col("y1"), dx, dy, pieces, F.lit(cell))).alias("c")
    cols = [*KEYS, "sid", "x1", "y1", "x2", "y2", *more]
    return segs.select(*cols, cells).select(*cols, "c.cx", "c.cy")


def nearest_segment(points: DataFrame, segs: DataFrame, cell: float = CELL, ends: tuple[str, str] | None = None) -> DataFrame:
    """Closest segment of the same chain, exactly, by growing cells.

    ``ends`` names a value at both ends of the segments: it is then returned as
    ``value``, interpolated at the closest place, and of equally close segments
    that with the least value wins.

    A point looks for segments up to ``cell`` away, in a grid twice as wide: the square around it meets at most four cells
    (nine where it touches their sides). What is found within ``cell`` is final. Cells double for the points that are left,
    and the segments are laid out anew in them.
    """
    segs = cut(segs.select(*KEYS, "sid", "x1", "y1", "x2", "y2", *(ends or ())))
    left = cut(points.select(*KEYS, "k", "px", "py").join(segs.select(*KEYS).distinct(), KEYS, "left_semi"))
    out = None
    while True:
        grid = 2 * cell
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - cell) / grid - SLACK), F.floor((F.col(c) + cell) / grid + SLACK)))
        q = left.withColumn("cx", span("px")).withColumn("cy", span("py"))
        cand = q.join(_segment_cells(segs, grid, ends or ()), [*KEYS, "cx", "cy"]).withColumn("d", segment_distance())
        value = F.lit(None).cast("double") if ends is None else F.col(ends[0]) + projection() * (F.col(ends[1]) - F.col(ends[0]))
        best = cand.withColumn("v", value).groupBy(*KEYS, "k").agg(F.min(F.struct("d", "v", "sid")).alias("b"))
        got = cut(left.join(best, [*KEYS, "k"], "left").withColumn("__ok", F.coalesce(F.col("b.d") <= cell, F.lit(False))))
        more = [] if ends is None else [F.col("b.v").alias("value")]
        done = got.filter("__ok").select(*KEYS, "k", F.col("b.sid").alias("sid"), F.col("b.d").alias("distance"), *more)
        out = done if out is None else out.unionByName(done)
        left = got.filter("not __ok").select(*KEYS, "k", "px", "py")
        if left.isEmpty():
            return out
        cell *= 2


def normal_crossing(points: DataFrame, segs: DataFrame, reach: float = CELL) -> DataFrame:
    """Signed distance ``t`` along the normal to the nearest crossing with the own chain's segments.

    The normal line runs both ways without end; ``t`` is NULL where it meets no
    segment. A crossing within ``reach`` lies in a cell that both the line and the
    segment run through; cells are as wide as the line is long, so either is in few. Reach and
    cells double for the points that are left, until a line has left the box of its chain.
    """
    segs = cut(segs.select(*KEYS, "sid", "x1", "y1", "x2", "y2"))
    box = segs.groupBy(*KEYS).agg(
        *[f(f"{a}{i}").alias(f"__{n}{a}{i}") for a in "xy" for i in (1, 2) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    )
    far = [F.greatest(F.abs(F.col(f"p{a}") - F.least(f"__lo{a}1", f"__lo{a}2")), F.abs(F.col(f"p{a}") - F.greatest(f"__hi{a}1", f"__hi{a}2"))) for a in "xy"]
    base = points.select(*KEYS, "k", "px", "py", "nx", "ny").join(box, KEYS, "left")
    left = cut(base.select(*KEYS, "k", "px", "py", "nx", "ny", F.sqrt(far[0] * far[0] + far[1] * far[1]).alias("__far")))
    none = F.lit(None).cast("bigint").alias("sid"), F.lit(None).cast("double").alias("t")
    out = left.filter("__far is null").select(*KEYS, "k", *none)
    left = left.filter("__far is not null")
    c = F.col
    det = c("nx") * (c("y2") - c("y1")) - c("ny") * (c("x2") - c("x1"))
    mx, my = c("px") - c("x1"), c("py") - c("y1")
    at = (c("nx") * my - c("ny") * mx) / F.nullif(det, F.lit(0.0))
    t = ((c("x2") - c("x1")) * my - (c("y2") - c("y1")) * mx) / F.nullif(det, F.lit(0.0))
    while True:
        cell = reach * 2
        ray = _touched(c("px") - c("nx") * reach, c("py") - c("ny") * reach, c("nx") * (2 * reach), c("ny") * (2 * reach), F.lit(8), F.lit(cell))
        q = left.withColumn("__c", F.explode(ray)).withColumns({"cx": c("__c.cx"), "cy": c("__c.cy")})
        cand = q.join(_segment_cells(segs, cell), [*KEYS, "cx", "cy"]).withColumns({"s": at, "t": t}).filter("s between 0 and 1 and t is not null")
        best = cand.groupBy(*KEYS, "k").agg(F.min(F.struct(F.abs("t").alias("d"), "sid", "t")).alias("b"))
        got = left.join(best, [*KEYS, "k"], "left")
        hit = F.coalesce(c("b.d") <= reach, F.lit(False))
        got = cut(got.withColumn("__ok", hit | (c("__far") <= reach)).withColumn("b", F.when(hit, c("b"))))
        out = out.unionByName(got.filter("__ok").select(*KEYS, "k", c("b.sid").alias("sid"), c("b.t").alias("t")))
        left = got.filter("not __ok").drop("b", "__ok")
        if left.isEmpty():
            return out
        reach *= 2


# Fixed value: a sample counts for the ratio of both deviations from this share of its half-width on.
MATERIAL_SHARE = 0.25


def deviation_cost(points: DataFrame, segs: DataFrame) -> DataFrame:
    """Proposal cost of each chain: robust normal deviations times arclength, the largest of both deviations, and the
    worst ratio among material samples with the deviation at which it stands (the first of equals).

    Samples of no arclength say nothing. A normal line that meets no segment refuses the chain.
    """
    real = points.filter(F.col("weight_ds") != 0)
    d = real.select(*KEYS, "k", "halfwidth", "weight_ds").join(normal_crossing(real, segs).select(*KEYS, "k", "t"), [*KEYS, "k"])
    d = d.join(nearest_segment(real, segs).select(*KEYS, "k", F.col("distance").alias("de")), [*KEYS, "k"], "left").withColumn("dn", F.abs("t"))
    material = (F.col("de") >= F.col("halfwidth") * MATERIAL_SHARE) & (F.col("de") > 0)
    worst = F.max(F.when(material & F.col("dn").isNotNull(), F.struct((F.col("dn") / F.col("de")).alias("ratio"), (-F.col("k")).alias("first"), "de")))
    found = d.groupBy(*KEYS).agg(
        F.sum(rho(F.col("t") / F.col("halfwidth")) * F.col("weight_ds")).alias("cost"), F.max("dn").alias("max_normal"), F.max("de").alias("max_euclidean"),
        worst.alias("w"), F.count_if(material).alias("material"), F.count_if(F.col("t").isNull()).alias("__missed"),
    )
    ok = F.col("__missed") == 0
    values = [F.when(ok, F.col(c)).alias(c) for c in ("cost", "max_normal", "max_euclidean")]
    ratio = [F.when(ok, F.col("w.ratio")).alias("worst_ratio"), F.when(ok, F.col("w.de")).alias("ratio_at")]
    return found.select(*KEYS, *values, *ratio, F.when(ok, F.col("material")).alias("material"), F.when(~ok, "normal_line_misses").alias("refusal"))


def residual_code(points: DataFrame, segs: DataFrame) -> DataFrame:
    """Residual code length of each chain: independent observations times the code of each deviation.

    The deviation runs along the normal, or straight where the normal meets
    nothing. A correlation length that is not positive, or a negative arclength,
    makes the code infinite.
    """
    points, segs = cut(points), cut(segs)
    d = points.select(*KEYS, "k", "halfwidth", "weight_ds", "corr_length").join(normal_crossing(points, segs).select(*KEYS, "k", "t"), [*KEYS, "k"], "left")
    d = d.join(nearest_segment(points, segs).select(*KEYS, "k", "distance"), [*KEYS, "k"], "left")
    off = F.coalesce(F.abs("t"), F.col("distance"))
    count = F.when((F.col("corr_length") > 0) & (F.col("weight_ds") >= 0), F.col("weight_ds") / F.col("corr_length"))
    bits = F.coalesce(count * residual_bits(off, F.col("halfwidth")), F.lit(float("inf")))
    return d.groupBy(*KEYS).agg(F.count("*").alias("samples"), F.sum(bits).alias("bits"))


# Fixed value: half-widths within which a model counts as explaining a sample.
FEASIBLE_HALFWIDTHS = 3.0


def corridor_containment(samples: DataFrame, poly: DataFrame) -> DataFrame:
    """Worst ratio of deviation to allowance between samples and a polyline, both ways.

    Samples deviate along their normal (straight, where that meets nothing) against their own half-width; vertices of
    the polyline deviate from the chain of samples against the half-width interpolated at the closest place. The first
    of equal ratios counts, samples before vertices. Without two samples or a segment a chain is not feasible.
    """
    few = samples.groupBy(*KEYS).agg(F.count("*").alias("samples"))
    direct = samples.select(*KEYS, "k", "halfwidth").join(normal_crossing(samples, poly).select(*KEYS, "k", "t"), [*KEYS, "k"])
    direct = direct.join(nearest_segment(samples, poly).select(*KEYS, "k", "distance"), [*KEYS, "k"])
    forward = direct.select(*KEYS, F.lit(0).alias("way"), "k", F.coalesce(F.abs("t"), F.col("distance")).alias("dev"), (F.col("halfwidth") * FEASIBLE_HALFWIDTHS).alias("allowed"))

    sides = neighbour(samples.select(*KEYS, "k", "px", "py", "halfwidth"), KEYS, "k", ["px", "py", "halfwidth"], 1, "_n").filter("px_n is not null")
    chain = sides.select(*KEYS, F.col("k").alias("sid"), F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("px_n").alias("x2"), F.col("py_n").alias("y2"), F.col("halfwidth").alias("h1"), F.col("halfwidth_n").alias("h2"))
    ends = poly.groupBy(*KEYS).agg(*[f(c, "sid").alias(n) for f, c, n in ((F.min_by, "x1", "fx"), (F.min_by, "y1", "fy"), (F.max_by, "x2", "lx"), (F.max_by, "y2", "ly"), (F.max_by, "sid", "last"))])
    first = samples.groupBy(*KEYS).agg(*[f(c, "k").alias(n) for f, c, n in ((F.min_by, "px", "x2"), (F.min_by, "py", "y2"), (F.min_by, "halfwidth", "h2"), (F.max_by, "px", "x1"), (F.max_by, "py", "y1"), (F.max_by, "halfwidth", "h1"), (F.max_by, "k", "sid"))])
    seam = first.join(ends.filter("fx = lx and fy = ly").select(*KEYS), KEYS, "left_semi")  # a closed polyline closes the evidence
    chain = chain.unionByName(seam.select(*chain.columns))
    dots = poly.select(*KEYS, F.col("sid").alias("k"), F.col("x1").alias("px"), F.col("y1").alias("py"))
    dots = dots.unionByName(ends.select(*KEYS, (F.col("last") + 1).alias("k"), F.col("lx").alias("px"), F.col("ly").alias("py")))
    back = nearest_segment(dots, chain, ends=("h1", "h2"))
    reverse = back.select(*KEYS, F.lit(1).alias("way"), "k", F.col("distance").alias("dev"), (F.col("value") * FEASIBLE_HALFWIDTHS).alias("allowed"))
    both = forward.unionByName(reverse).withColumn("ratio", F.round(F.col("dev") / F.col("allowed"), 9))
    worst = both.groupBy(*KEYS).agg(F.max(F.struct("ratio", (-F.col("way")).alias("w"), (-F.col("k")).alias("n"), "dev", "allowed")).alias("b"))
    d = few.join(worst, KEYS, "left")
    valid = (F.col("samples") >= 2) & F.col("b").isNotNull()
    return d.select(
        *KEYS, "samples", F.when(valid, F.col("b.ratio")).alias("worst_ratio"), F.when(valid, F.when(F.col("b.w") == 0, "sample").otherwise("vertex")).alias("worst_side"),
        F.when(valid, -F.col("b.n")).alias("worst_at"), F.when(valid, F.col("b.dev")).alias("deviation"), F.coalesce(valid & (F.col("b.ratio") <= 1), F.lit(False)).alias("feasible"),
    )


def interference(segs: DataFrame, cell: int) -> DataFrame:
    """Crossing or overlapping segment pairs of a chain, in lattice coordinates.

    Coordinates are BIGINT, so orientation signs are exact. Segments meet only if
    they share a grid cell; a pair is reported once, from its first shared cell.
    """
    s = cells_of_segments(segs, float(cell))
    names = ["sid", "x1", "y1", "x2", "y2"]
    a = s.select(*KEYS, "cx", "cy", *[F.col(n).alias(f"a_{n}") for n in names])
    b = s.select(*KEYS, "cx", "cy", *[F.col(n).alias(f"b_{n}") for n in names])
    c = F.col
    box = (
        (F.greatest("a_x1", "a_x2") >= F.least("b_x1", "b_x2")) & (F.greatest("b_x1", "b_x2") >= F.least("a_x1", "a_x2"))
        & (F.greatest("a_y1", "a_y2") >= F.least("b_y1", "b_y2")) & (F.greatest("b_y1", "b_y2") >= F.least("a_y1", "a_y2"))
    )
    home = (c("cx") == F.floor(F.greatest(F.least("a_x1", "a_x2"), F.least("b_x1", "b_x2")) / cell)) & (
        c("cy") == F.floor(F.greatest(F.least("a_y1", "a_y2"), F.least("b_y1", "b_y2")) / cell)
    )
    d = a.join(b, [*KEYS, "cx", "cy"]).filter((c("a_sid") < c("b_sid")) & box & home)
    turn = lambda p, q, r: F.signum((c(f"{q[0]}") - c(f"{p[0]}")) * (c(f"{r[1]}") - c(f"{p[1]}")) - (c(f"{q[1]}") - c(f"{p[1]}")) * (c(f"{r[0]}") - c(f"{p[0]}")))
    A1, A2, B1, B2 = ("a_x1", "a_y1"), ("a_x2", "a_y2"), ("b_x1", "b_y1"), ("b_x2", "b_y2")
    o1, o2, o3, o4 = turn(A1, A2, B1), turn(A1, A2, B2), turn(B1, B2, A1), turn(B1, B2, A2)
    same = lambda p, q: ((c(p[0]) == c(q[0])) & (c(p[1]) == c(q[1]))).cast("int")
    shared = same(A1, B1) + same(A1, B2) + same(A2, B1) + same(A2, B2)
    flat = (o1 == 0) & (o2 == 0)
    meet = F.when(flat, F.lit(True)).otherwise((o1 * o2 <= 0) & (o3 * o4 <= 0))
    wide = (F.least(F.greatest("a_x1", "a_x2"), F.greatest("b_x1", "b_x2")) > F.greatest(F.least("a_x1", "a_x2"), F.least("b_x1", "b_x2"))) | (
        F.least(F.greatest("a_y1", "a_y2"), F.greatest("b_y1", "b_y2")) > F.greatest(F.least("a_y1", "a_y2"), F.least("b_y1", "b_y2"))
    )
    kind = F.when((shared == 0) & meet, "boundaries_intersect").when(((shared == 1) & flat & wide) | (shared >= 2), "collinear_overlap")
    return d.select(*KEYS, "a_sid", "b_sid", kind.alias("kind")).filter("kind is not null")
