"""Level-set contours, chain assembly and boundary observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.functions.codes import Z_TABLE, position_uncertainty
from rasterlake.operators.graphs import components, rank_lists
from rasterlake.operators.regions import STRIDE, raster_size
from rasterlake.operators.stencil import neighbours
from rasterlake.session import cut

KEYS = ["image_id"]


def segments(px: DataFrame, level: float, v: str = "v") -> DataFrame:
    """Contour segments of every 2x2 cell, ends named by lattice edge.

    Edge ids: twice the pixel id of its first end, plus one for vertical edges.
    A saddle cell is split by its mean and flagged.
    """
    d = neighbours(px.select(*KEYS, "x", "y", F.col(v).alias("v")), KEYS, ["v"], clamp=False)
    d = d.filter(F.col("se.v").isNotNull()).select(
        *KEYS, "x", "y", F.col("v").alias("a"), F.col("e.v").alias("b"), F.col("se.v").alias("c"), F.col("s.v").alias("d")
    )
    bit = lambda n, k: F.when(F.col(n) >= level, k).otherwise(0)
    d = d.withColumn("case", bit("a", 1) + bit("b", 2) + bit("c", 4) + bit("d", 8)).filter((F.col("case") > 0) & (F.col("case") < 15))

    def along(p: str, q: str) -> Column:
        gap = F.col(q) - F.col(p)
        t = F.when(F.abs(gap) < 1e-300, F.lit(0.5)).otherwise((F.lit(level) - F.col(p)) / F.nullif(gap, F.lit(0.0)))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))

    x, y = F.col("x"), F.col("y")
    base = lambda dx, dy, vert: ((y + dy).cast("bigint") * STRIDE + x + dx) * 2 + vert
    pt = lambda e, px_, py_: F.struct(e.alias("edge"), px_.alias("px"), py_.alias("py"))
    half = F.lit(0.5)
    ends = {
        "top": pt(base(0, 0, 0), x + half + along("a", "b"), y + half),
        "bottom": pt(base(0, 1, 0), x + half + along("d", "c"), y + 1 + half),
        "left": pt(base(0, 0, 1), x + half, y + half + along("a", "d")),
        "right": pt(base(1, 0, 1), x + 1 + half, y + half + along("b", "c")),
    }
    d = d.withColumns(ends)
    # fixed values: edges joined in each unambiguous case
    pairs = {
        ("left", "top"): (1, 14), ("top", "right"): (2, 13), ("left", "right"): (3, 12),
        ("right", "bottom"): (4, 11), ("top", "bottom"): (6, 9), ("left", "bottom"): (7, 8),
    }
    saddle = F.col("case").isin(5, 10)
    joined = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) * 0.25 >= level
    like_five = (F.col("case") == 5) == joined
    seg = lambda cond, p, q: F.when(cond, F.struct(F.col(p).alias("p"), F.col(q).alias("q")))
    rows = [seg(F.col("case").isin(*cases), p, q) for (p, q), cases in pairs.items()]
    rows += [
        seg(saddle & like_five, "left", "top"), seg(saddle & like_five, "right", "bottom"),
        seg(saddle & ~like_five, "left", "bottom"), seg(saddle & ~like_five, "top", "right"),
    ]
    out = d.select(*KEYS, saddle.alias("saddle"), F.explode(F.array(*rows)).alias("s")).filter("s is not null")
    return out.select(
        *KEYS, "saddle", F.col("s.p.edge").alias("ea"), F.col("s.p.px").alias("xa"), F.col("s.p.py").alias("ya"),
        F.col("s.q.edge").alias("eb"), F.col("s.q.px").alias("xb"), F.col("s.q.py").alias("yb"),
    )


def contour_summary(px: DataFrame, level: float, v: str = "v") -> DataFrame:
    """Contour length, segments and saddle cells of each image."""
    s = segments(px, level, v)
    length = F.sqrt((F.col("xb") - F.col("xa")) ** 2 + (F.col("yb") - F.col("ya")) ** 2)
    d = s.groupBy(*KEYS).agg(F.sum(length).alias("length"), F.count("*").alias("segments"), (F.count_if("saddle") / 2).cast("bigint").alias("saddles"))
    return px.select(*KEYS).distinct().join(d, KEYS, "left").na.fill(0)


def chains(px: DataFrame, level: float, v: str = "v") -> DataFrame:
    """Assemble segments into chains with ordered vertices.

    Chains are the components of the edge graph. Every chain is cut at one vertex
    (an end, or the least edge of a loop) into a directed list, which pointer
    doubling ranks. Adds ``closed``, ``malformed`` (an open end off the border),
    and for each vertex its position ``k`` and arclength ``s`` from the start.
    """
    seg = cut(segments(px, level, v))
    size = raster_size(px)
    both = seg.select(*KEYS, F.col("ea").alias("edge"), F.col("eb").alias("to"), F.col("xa").alias("px"), F.col("ya").alias("py"), F.col("xb").alias("qx"), F.col("yb").alias("qy"))
    flip = both.select(*KEYS, F.col("to").alias("edge"), F.col("edge").alias("to"), F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    arcs = cut(both.unionByName(flip))
    roots = components(seg.select(*KEYS, F.col("ea").alias("src"), F.col("eb").alias("dst")), KEYS)
    verts = arcs.groupBy(*KEYS, "edge").agg(F.first("px").alias("px"), F.first("py").alias("py"), F.count("*").alias("deg"))
    verts = cut(verts.join(roots.withColumnRenamed("id", "edge"), [*KEYS, "edge"], "left").withColumn("chain", F.coalesce("root", "edge")).drop("root"))
    kind = verts.groupBy(*KEYS, "chain").agg(
        F.min(F.when(F.col("deg") == 1, F.col("edge"))).alias("end"), F.min("edge").alias("least"), F.count("*").alias("vertices")
    )
    kind = kind.withColumns({"closed": F.col("end").isNull(), "start": F.coalesce("end", "least")})
    # Each undirected arc gives two directed ones; the turn-free successor of an
    # arc (u -> v) is (v -> w) with w != u, so both directions form lists.
    arc = arcs.join(verts.select(*KEYS, "edge", "chain"), [*KEYS, "edge"]).join(kind.select(*KEYS, "chain", "start"), [*KEYS, "chain"])
    ident = F.struct(F.col("edge").alias("u"), F.col("to").alias("v"))
    step = F.sqrt((F.col("qx") - F.col("px")) ** 2 + (F.col("qy") - F.col("py")) ** 2)
    a = cut(arc.select(*KEYS, "chain", "start", ident.alias("id"), step.alias("step")))
    nxt = a.select(*KEYS, F.col("id.u").alias("at"), F.col("id.v").alias("w"))
    j = a.withColumn("at", F.col("id.v")).join(nxt, [*KEYS, "at"], "left")
    go = F.when((F.col("w") != F.col("id.u")) & (F.col("at") != F.col("start")), F.struct(F.col("at").alias("u"), F.col("w").alias("v")))
    links = j.groupBy(*KEYS, "chain", "start", "id", "step").agg(F.max(go).alias("next"))
    ranked = rank_lists(links.select(*KEYS, "id", "next", "step"), KEYS)
    r = ranked.join(a, [*KEYS, "id"])
    # remaining arcs down to the tail; lists that run back into the start vertex
    # of an open chain, or around a loop, are told apart by their tail
    into_start = F.col("tail.v") == F.col("start")
    loop = r.join(kind.select(*KEYS, "chain", "closed", "vertices"), [*KEYS, "chain"])
    # a loop is walked in the direction that leaves its start towards the smaller edge
    first = loop.filter(F.col("closed") & (F.col("id.u") == F.col("start"))).groupBy(*KEYS, "chain").agg(F.min_by("tail", "id.v").alias("pick"))
    loop = loop.join(first, [*KEYS, "chain"], "left")
    keep = F.when(F.col("closed"), F.col("tail") == F.col("pick")).otherwise(~into_start)
    total = loop.filter(keep)
    sums = total.groupBy(*KEYS, "chain").agg(F.sum("step").alias("length"), F.max("hops").alias("top"))
    t = total.join(sums, [*KEYS, "chain"])
    tail_step = t.filter(F.col("hops") == 0).select(*KEYS, "chain", F.col("step").alias("__last"))
    t = t.join(tail_step, [*KEYS, "chain"])
    pos = t.select(
        *KEYS, "chain", "closed", "vertices", "length", F.col("id.u").alias("edge"), (F.col("top") - F.col("hops")).alias("k"),
        (F.col("length") - F.col("reach") - F.col("__last")).alias("s"), F.col("id.v").alias("v_to"), F.col("hops"),
    )
    last = pos.filter(~F.col("closed") & (F.col("hops") == 0)).select(
        *KEYS, "chain", "closed", "vertices", "length", F.col("v_to").alias("edge"), (F.col("k") + 1).alias("k"), F.col("length").alias("s")
    )
    cols = [*KEYS, "chain", "closed", "vertices", "length", "edge", "k", "s"]
    placed = pos.select(*cols).unionByName(last.select(*cols)).join(verts.select(*KEYS, "edge", "px", "py", "deg"), [*KEYS, "edge"]).join(size, KEYS)
    rim = (F.col("px") == 0.5) | (F.col("py") == 0.5) | (F.col("px") == F.col("width") - 0.5) | (F.col("py") == F.col("height") - 0.5)
    return placed.withColumn("malformed_end", (F.col("deg") == 1) & ~rim).drop("width", "height", "deg")


def malformed_images(ordered: DataFrame) -> DataFrame:
    """(image_id, chain) of the first malformed chain of every image that has one; boundaries refuse such an image."""
    return ordered.filter("malformed_end").groupBy(*KEYS).agg(F.min("chain").alias("chain"))


def chain_summary(px: DataFrame, level: float, v: str = "v") -> DataFrame:
    """Number of vertices, closedness and length of every chain (unordered)."""
    seg = cut(segments(px, level, v))
    roots = components(seg.select(*KEYS, F.col("ea").alias("src"), F.col("eb").alias("dst")), KEYS)
    length = F.sqrt((F.col("xb") - F.col("xa")) ** 2 + (F.col("yb") - F.col("ya")) ** 2)
    owned = seg.join(roots.withColumnRenamed("id", "ea"), [*KEYS, "ea"], "left").withColumn("chain", F.coalesce("root", "ea"))
    d = owned.groupBy(*KEYS, "chain").agg(F.count("*").alias("segments"), F.sum(length).alias("length"))
    verts = owned.select(*KEYS, "chain", F.explode(F.array("ea", "eb")).alias("edge")).groupBy(*KEYS, "chain", "edge").agg(F.count("*").alias("deg"))
    shape = verts.groupBy(*KEYS, "chain").agg(F.count("*").alias("vertices"), F.bool_and(F.col("deg") == 2).alias("closed"))
    return d.join(shape, [*KEYS, "chain"])


def bilinear(points: DataFrame, field: DataFrame, v: str, out: str) -> DataFrame:
    """Sample a field at (px, py): four corner joins on the clamped cell.

    Pixel centres sit at half integers. ``points`` carries image_id, pid, px, py.
    """
    size = raster_size(field)
    fx = lambda c, top: F.least(F.greatest(F.col(c) - 0.5, F.lit(0.0)), (F.col(top) - 1).cast("double"))
    d = points.join(size, KEYS).withColumns({"__fx": fx("px", "width"), "__fy": fx("py", "height")})
    d = d.withColumns({"__i": F.floor("__fx"), "__j": F.floor("__fy")})
    tx, ty = F.col("__fx") - F.col("__i"), F.col("__fy") - F.col("__j")
    i1, j1 = F.least(F.col("__i") + 1, F.col("width") - 1), F.least(F.col("__j") + 1, F.col("height") - 1)
    corner = lambda i, j, w: F.struct(i.cast("int").alias("x"), j.cast("int").alias("y"), w.alias("w"))
    four = F.array(
        corner(F.col("__i"), F.col("__j"), (1 - tx) * (1 - ty)), corner(i1, F.col("__j"), tx * (1 - ty)),
        corner(F.col("__i"), j1, (1 - tx) * ty), corner(i1, j1, tx * ty),
    )
    e = d.select(*KEYS, "pid", F.explode(four).alias("c")).select(*KEYS, "pid", "c.*")
    got = e.join(field.select(*KEYS, "x", "y", F.col(v).alias("__v")), [*KEYS, "x", "y"])
    return got.groupBy(*KEYS, "pid").agg(F.sum(F.col("w") * F.col("__v")).alias(out))


PATCH, ROW = 16, 19  # pixels of a patch, and with one before and two after


def patches(field: DataFrame, values: list[str]) -> DataFrame:
    """(image_id, __tx, __ty, width, height, values): a raster in patches, each value as an array in rows of ``ROW`` pixels.

    A patch holds the pixels around every point that lies up to 1 away from its own, whose first is (__tx, __ty) * PATCH.
    """
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 2) / PATCH), F.floor((F.col(c) + 1) / PATCH))).alias(f"__t{c}")
    d = field.select(*KEYS, "x", "y", *values, span("x")).select("*", span("y"))
    spot = (F.col("y") - F.col("__ty") * PATCH + 1) * ROW + F.col("x") - F.col("__tx") * PATCH + 1
    d = d.groupBy(*KEYS, "__tx", "__ty").agg(F.map_from_entries(F.collect_list(F.struct(spot.cast("int"), F.struct(*values)))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(ROW * ROW - 1))
    d = d.withColumn("a", F.transform(places, lambda k: F.try_element_at("m", k)))
    d = d.select(*KEYS, "__tx", "__ty", *[F.transform("a", lambda e: e[v]).alias(f"__{v}") for v in values])
    return d.join(raster_size(field), KEYS)


def in_patch(px: Column, py: Column, v: str) -> Column:
    """Value at (px, py) between the centres of the four pixels around it, as ``bilinear`` has it."""
    fx = F.least(F.greatest(px - 0.5, F.lit(0.0)), (F.col("width") - 1).cast("double"))
    fy = F.least(F.greatest(py - 0.5, F.lit(0.0)), (F.col("height") - 1).cast("double"))
    i, j = F.floor(fx), F.floor(fy)
    tx, ty = fx - i, fy - j
    i1, j1 = F.least(i + 1, F.col("width") - 1), F.least(j + 1, F.col("height") - 1)
    at = lambda a, b: F.get(f"__{v}", ((b - F.col("__ty") * PATCH + 1) * ROW + a - F.col("__tx") * PATCH + 1).cast("int"))
    parts = [at(i, j) * (1 - tx) * (1 - ty), at(i1, j) * tx * (1 - ty), at(i, j1) * (1 - tx) * ty, at(i1, j1) * tx * ty]
    some = F.coalesce(*parts).isNotNull()
    return F.when(some, sum((F.coalesce(e, F.lit(0.0)) for e in parts[1:]), F.coalesce(parts[0], F.lit(0.0))))


def boundary_observations(px: DataFrame, level: float, v: str, noise: float, step: float = 0.5) -> DataFrame:
    """Resampled boundary points with normal, profile slope and corridor.

    The normal is that of the field, or of the polyline where the field has no gradient. An image with a malformed chain is
    refused as a whole: it has no observations (``malformed_images`` names it).
    """
    ch = cut(chains(px, level, v))
    ch = ch.join(malformed_images(ch), KEYS, "left_anti")
    n = F.greatest(F.lit(1), F.floor(F.col("length") / step + 0.5)).cast("int")
    heads = ch.groupBy(*KEYS, "chain", "length", "closed").agg(F.max("k").alias("top"))
    at = heads.select(*KEYS, "chain", "length", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    at = at.withColumn("s", (F.col("i") + 0.5) * F.col("length") / F.col("n"))
    # a vertex spans up to the next one; loops return to their first vertex
    nxt = ch.select(*KEYS, "chain", (F.col("k") - 1).alias("k"), F.col("s").alias("s1"), F.col("px").alias("x1"), F.col("py").alias("y1"))
    home = ch.filter("closed and k = 0").select(*KEYS, "chain", F.col("px").alias("hx"), F.col("py").alias("hy"))
    span = ch.join(nxt, [*KEYS, "chain", "k"], "left").join(home, [*KEYS, "chain"], "left")
    span = span.withColumns({"s1": F.coalesce("s1", F.when(F.col("closed"), F.col("length"))), "x1": F.coalesce("x1", "hx"), "y1": F.coalesce("y1", "hy")}).filter("s1 is not null")
    # unit-length buckets of arclength turn the range condition into an equi-join
    low = span.withColumn("__b", F.explode(F.sequence(F.floor("s"), F.floor("s1"))))
    low = low.select(*KEYS, "chain", "__b", F.col("s").alias("s0"), "s1", "px", "py", "x1", "y1")
    j = at.withColumn("__b", F.floor("s")).join(low, [*KEYS, "chain", "__b"]).filter((F.col("s0") <= F.col("s")) & (F.col("s") < F.col("s1")))
    t = (F.col("s") - F.col("s0")) / F.greatest(F.col("s1") - F.col("s0"), F.lit(1e-12))
    pid = F.struct("chain", "i").alias("pid")
    dx, dy = F.col("x1") - F.col("px"), F.col("y1") - F.col("py")
    long = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-12))
    pts = cut(j.select(*KEYS, pid, (-dy / long).alias("lx"), (dx / long).alias("ly"), (F.col("px") + t * (F.col("x1") - F.col("px"))).alias("px"), (F.col("py") + t * (F.col("y1") - F.col("py"))).alias("py"), (F.col("length") / F.col("n")).alias("weight_ds")))
    near = neighbours(px.select(*KEYS, "x", "y", F.col(v).alias("v")), KEYS, ["v"], diagonal=False)
    grad = near.select(*KEYS, "x", "y", "v", ((F.col("e.v") - F.col("w.v")) * 0.5).alias("gx"), ((F.col("s.v") - F.col("n.v")) * 0.5).alias("gy"))
    # a point and all its probes lie in one patch of pixels, so it moves once
    at = lambda c: F.floor(F.greatest(F.col(c) - 0.5, F.lit(0.0)) / PATCH).alias(f"__t{c[1]}")
    d = pts.select("*", at("px"), at("py")).join(patches(grad, ["v", "gx", "gy"]), [*KEYS, "__tx", "__ty"])
    d = d.withColumns({"ux": in_patch(F.col("px"), F.col("py"), "gx"), "uy": in_patch(F.col("px"), F.col("py"), "gy")})
    d = d.withColumn("m", F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2))
    steep = F.col("m") > 1e-12
    d = d.withColumns({"nx": F.when(steep, F.col("ux") / F.col("m")).otherwise(F.col("lx")), "ny": F.when(steep, F.col("uy") / F.col("m")).otherwise(F.col("ly"))})
    probe = lambda o: in_patch(F.col("px") + F.col("nx") * o, F.col("py") + F.col("ny") * o, "v")
    d = d.withColumns({f"a{k}": probe(o) for k, o in enumerate((-1.0, -0.5, 0.0, 0.5, 1.0))})
    out = d.withColumns({"slope": F.col("a3") - F.col("a1"), "bend": F.col("a4") - F.col("a2") * 2 + F.col("a0")})
    u = position_uncertainty(F.lit(0.5 / 255), F.lit(0.0), F.lit(noise), F.col("slope"), F.col("bend"), F.lit(Z_TABLE[0.95]))
    return out.select(*KEYS, "pid.chain", "pid.i", "px", "py", "nx", "ny", "weight_ds", *[u[n].alias(n) for n in ("halfwidth", "capped", "confidence")])
