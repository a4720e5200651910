"""Connected regions, adjacency graphs, signatures and lattice boundaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.functions.codes import LEVEL_QUANTA, quantize_level
from rasterlake.operators.graphs import components, follow, rank_lists
from rasterlake.operators.prefix import neighbour, ordered_index
from rasterlake.operators.stencil import EIGHT, FOUR, INNER_BITS, TILE, east, neighbours, with_margins, word_above, word_rows
from rasterlake.session import cut

KEYS = ["image_id"]
STRIDE = 1 << 20  # pixel id = y * STRIDE + x, so ids sort in scan order


def pixel_id(x: str = "x", y: str = "y") -> Column:
    return F.col(y).cast("bigint") * STRIDE + F.col(x)


def id_x(c: str) -> Column:
    return (F.col(c) % STRIDE).cast("int")


def id_y(c: str) -> Column:
    return F.floor(F.col(c) / STRIDE).cast("int")


def raster_size(px: DataFrame) -> DataFrame:
    return px.groupBy(*KEYS).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


# ---- R-1 --------------------------------------------------------------------


def with_runs(px: DataFrame, label: str) -> DataFrame:
    """Add ``run``: the first pixel id of the horizontal run of equal labels.

    Runs stop at tile columns, so a window never holds more than one tile row.
    """
    w = Window.partitionBy(*KEYS, "y", "__c").orderBy("x")
    d = px.withColumn("__c", F.floor(F.col("x") / TILE))
    fresh = ~F.coalesce((F.lag(label).over(w) == F.col(label)) & (F.lag("x").over(w) == F.col("x") - 1), F.lit(False))
    d = d.withColumn("__s", F.when(fresh, pixel_id()))
    return d.withColumn("run", F.last("__s", True).over(w)).drop("__s", "__c")


def touching_runs(runs: DataFrame, label: str, conn: int) -> DataFrame:
    """Pairs of touching runs of one label (4- or 8-connected) with the number of unit edges between them.

    ``runs``: keys, label, y, run, x0, x1.
    """
    runs = runs.withColumn("c", F.floor(F.col("x0") / TILE))
    below = runs.select(*KEYS, label, (F.col("y") - 1).alias("y"), "c", F.col("run").alias("dst"), F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    stacked = runs.join(below, [*KEYS, label, "y", "c"]).filter((F.col("x0") <= F.col("u1")) & (F.col("u0") <= F.col("x1")))
    overlap = F.least("x1", "u1") - F.greatest("x0", "u0") + 1
    starts = runs.select(*KEYS, label, "y", F.col("x0").alias("at"), F.col("run").alias("dst"))
    steps = (0,) if conn == 4 else (-1, 0, 1)
    ends = runs.select(*KEYS, label, (F.col("x1") + 1).alias("at"), F.col("run").alias("src"), F.col("y").alias("from"), "y")
    if conn == 4:  # runs of one label meet inside a row only where a tile column parts them
        ends, starts = (d.filter(F.col("at") % TILE == 0) for d in (ends, starts))
    reach = ends.withColumn("y", F.explode(F.array(*[F.col("y") + s for s in steps])))
    corner = reach.join(starts, [*KEYS, label, "y", "at"])
    level = F.when(F.col("from") == F.col("y"), 1).otherwise(0)
    return stacked.select(*KEYS, F.col("run").alias("src"), "dst", overlap.cast("long").alias("shared")).unionByName(
        corner.select(*KEYS, "src", "dst", level.cast("long").alias("shared"))
    )


def run_edges(px: DataFrame, label: str, conn: int) -> DataFrame:
    """Pairs of touching runs of one label (4- or 8-connected)."""
    runs = px.groupBy(*KEYS, label, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return touching_runs(runs, label, conn).select(*KEYS, "src", "dst")


def region_shapes(px: DataFrame, label: str, value: str) -> DataFrame:
    """Area, perimeter in unit edges, mean and range of ``value`` of every 4-connected region.

    A run has its own outline of 2 + 2n edges; every edge that it shares with another run of the region is inside and
    leaves two of them. Pixels are read once, all the rest is work on runs.
    """
    v = F.col(value)
    marked = with_runs(px.filter(F.col(label).isNotNull()), label)
    runs = cut(
        marked.groupBy(*KEYS, label, "y", "run").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("area"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")
        )
    )
    contacts = cut(touching_runs(runs, label, 4))
    inside = contacts.groupBy(*KEYS, F.col("src").alias("run")).agg(F.sum("shared").alias("shared"))
    roots = components(contacts.select(*KEYS, "src", "dst"), KEYS).select(*KEYS, F.col("id").alias("run"), "root")
    d = runs.join(roots, [*KEYS, "run"], "left").join(inside, [*KEYS, "run"], "left").withColumn("region", F.coalesce("root", "run"))
    outline = F.sum(F.col("area") * 2 + 2 - F.coalesce("shared", F.lit(0)) * 2)
    return d.groupBy(*KEYS, label, "region").agg(
        F.sum("area").alias("area"), outline.alias("perimeter"), (F.sum("total") / F.sum("area")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def regions(px: DataFrame, label: str = "label", conn: int = 4, exterior: int | None = None) -> DataFrame:
    """Add ``region``: the first pixel id of the connected region of each pixel.

    Pixels are reduced to runs before the graph work. Pixels without a label have
    no region. Border pixels of the ``exterior`` label belong to one region.
    """
    d = cut(with_runs(px.filter(F.col(label).isNotNull()), label))
    edges = run_edges(d, label, conn)
    if exterior is not None:
        size = raster_size(px)
        rim = d.join(size, KEYS).filter((F.col(label) == exterior) & on_rim()).select(*KEYS, "run").distinct()
        first = rim.groupBy(*KEYS).agg(F.min("run").alias("src"))
        edges = edges.unionByName(rim.join(first, KEYS).select(*KEYS, "src", F.col("run").alias("dst")))
    roots = components(edges, KEYS).select(*KEYS, F.col("id").alias("run"), "root")
    return d.join(roots, [*KEYS, "run"], "left").withColumn("region", F.coalesce("root", "run")).drop("root", "run")


def region_sizes(px: DataFrame, label: str = "label", conn: int = 4) -> DataFrame:
    """Pixels of every connected region. Pixels are read once and never written or joined: a run brings its length."""
    marked = with_runs(px.filter(F.col(label).isNotNull()), label)
    runs = cut(marked.groupBy(*KEYS, label, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n")))
    edges = touching_runs(runs.drop("n"), label, conn).select(*KEYS, "src", "dst")
    roots = components(edges, KEYS).select(*KEYS, F.col("id").alias("run"), "root")
    d = runs.join(roots, [*KEYS, "run"], "left").withColumn("region", F.coalesce("root", "run"))
    return d.groupBy(*KEYS, label, "region").agg(F.sum("n").alias("pixels"))


def on_rim() -> Column:
    return (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)


def rim_sides() -> Column:
    side = lambda c: c.cast("bigint")
    return (
        side(F.col("x") == 0) + side(F.col("y") == 0) + side(F.col("x") == F.col("width") - 1) + side(F.col("y") == F.col("height") - 1)
    )


# ---- R-5, R-6, W-7, W-11 ----------------------------------------------------

OUTSIDE = -1  # synthetic exterior region


def adjacency_graph(px: DataFrame, label: str = "label", exterior: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the region adjacency graph.

    Without an exterior label on the image a synthetic exterior region -1 is
    added. Regions on the rim touch the exterior through every rim side.
    """
    d = cut(regions(px, label, 4, exterior).join(raster_size(px), KEYS))
    is_ext = F.lit(False) if exterior is None else F.col(label) == exterior
    nodes = d.groupBy(*KEYS, "region").agg(
        F.first(label).alias("label"), F.count("*").alias("pixels"), F.sum(rim_sides()).alias("border_segments"), F.bool_or(is_ext).alias("is_exterior")
    )
    if exterior is not None:  # the exterior region is the first one of its label
        first = nodes.filter("is_exterior").groupBy(*KEYS).agg(F.min("region").alias("__x"))
        nodes = nodes.join(first, KEYS, "left").withColumn("is_exterior", F.coalesce(F.col("region") == F.col("__x"), F.lit(False))).drop("__x")
    outer = nodes.filter("is_exterior").select(*KEYS, F.col("region").alias("ext"))
    size = raster_size(px)
    missing = size.join(outer, KEYS, "left_anti")
    synthetic = missing.select(
        *KEYS, F.lit(OUTSIDE).cast("bigint").alias("region"), F.lit(None).cast("int").alias("label"), F.lit(0).cast("bigint").alias("pixels"),
        (F.col("width") * 2 + F.col("height") * 2).cast("bigint").alias("border_segments"), F.lit(True).alias("is_exterior"),
    )
    ext = outer.unionByName(missing.select(*KEYS, F.lit(OUTSIDE).cast("bigint").alias("ext")))
    near = neighbours(d.select(*KEYS, "x", "y", "region"), KEYS, ["region"], clamp=False, diagonal=False)
    pair = F.explode(F.array(F.col("e.region"), F.col("s.region"))).alias("other")
    inner = near.select(*KEYS, "region", pair).filter(F.col("other") != F.col("region")).select(
        *KEYS, F.least("region", "other").alias("a"), F.greatest("region", "other").alias("b"), F.lit(1).cast("bigint").alias("n")
    )
    rim = nodes.join(ext, KEYS).filter((F.col("region") != F.col("ext")) & (F.col("border_segments") > 0)).select(
        *KEYS, F.least("region", "ext").alias("a"), F.greatest("region", "ext").alias("b"), F.col("border_segments").alias("n")
    )
    edges = inner.unionByName(rim).groupBy(*KEYS, "a", "b").agg(F.sum("n").alias("shared_segments"))
    return nodes.unionByName(synthetic), edges


def region_neighbours(edges: DataFrame) -> DataFrame:
    flip = edges.select(*KEYS, F.col("b").alias("region"), F.col("a").alias("neighbour"))
    return edges.select(*KEYS, F.col("a").alias("region"), F.col("b").alias("neighbour")).unionByName(flip)


def canonical_labels(px: DataFrame, label: str = "label", exterior: int | None = None) -> DataFrame:
    """Number labels by first appearance; the exterior label becomes 0.

    Labels of one image are at most 65536, so ranking them is bounded.
    """
    first = px.groupBy(*KEYS, label).agg(F.min(pixel_id()).alias("first"))
    ext = F.lit(False) if exterior is None else F.col(label) == exterior
    w = Window.partitionBy(*KEYS).orderBy("__o", "first")
    ranked = first.withColumn("__o", F.when(ext, 0).otherwise(1)).withColumn("canonical", F.row_number().over(w) - 1)
    if exterior is not None:  # number 0 stays reserved where the label is absent
        seen = F.max(F.when(F.col("__o") == 0, 1).otherwise(0)).over(Window.partitionBy(*KEYS))
        ranked = ranked.withColumn("canonical", F.col("canonical") + F.when(seen == 1, 0).otherwise(1))
    return px.join(ranked.select(*KEYS, label, "canonical"), [*KEYS, label])


def run_lengths(px: DataFrame, inside: str = "inside") -> DataFrame:
    """Scan-order runs of a labelling: position, value and length.

    A run may cross rows, so each row also looks at the last pixel of the row
    above; the runs of an image are then numbered without a window over it.
    """
    tail = px.groupBy(*KEYS, (F.col("y") + 1).alias("y")).agg(F.max_by(inside, "x").alias("__t"))
    w = Window.partitionBy(*KEYS, "y").orderBy("x")
    d = px.join(tail, [*KEYS, "y"], "left").withColumn("__p", F.coalesce(F.lag(inside).over(w), F.when(F.col("x") == 0, F.col("__t"))))
    starts = d.filter(F.col("__p").isNull() | (F.col("__p") != F.col(inside)))
    size = raster_size(px)
    starts = starts.join(size, KEYS).select(*KEYS, (F.col("y") * F.col("width") + F.col("x")).cast("bigint").alias("at"), inside, (F.col("width") * F.col("height")).cast("bigint").alias("__n"))
    k = ordered_index(starts, KEYS, ["at"], "k")
    nxt = neighbour(k, KEYS, "k", ["at"], 1, "_next")
    return nxt.select(*KEYS, "k", inside, (F.coalesce("at_next", "__n") - F.col("at")).alias("length"))


# ---- R-7, A-28, R-9, R-10, R-20 ---------------------------------------------


def signature(px: DataFrame, conn: int = 4, inside: str = "inside") -> DataFrame:
    """Foreground components, holes and Euler number of every labelling.

    Holes are background regions, under the complementary connectivity, that do
    not reach the rim.
    """
    fg = regions(px.withColumn("__l", F.when(F.col(inside), 1)), "__l", conn).groupBy(*KEYS).agg(F.countDistinct("region").alias("components"))
    size = raster_size(px)
    bg = regions(px.withColumn("__l", F.when(~F.col(inside), 1)), "__l", 12 - conn).join(size, KEYS)
    holes = bg.groupBy(*KEYS, "region").agg(F.bool_or(on_rim()).alias("open")).groupBy(*KEYS).agg(F.count_if(~F.col("open")).alias("holes"))
    d = size.join(fg, KEYS, "left").join(holes, KEYS, "left").na.fill(0, ["components", "holes"])
    return d.select(*KEYS, "components", "holes", (F.col("components") - F.col("holes")).alias("euler"), "width", "height")


def euler_number(px: DataFrame, conn: int = 4, inside: str = "inside") -> DataFrame:
    """Euler number by counting pixels, edges and corners: one stencil, no labels."""
    d = neighbours(px.select(*KEYS, "x", "y", F.col(inside).cast("int").alias("v")), KEYS, ["v"], clamp=False)
    at = lambda n: F.coalesce(F.col(f"{n}.v"), F.lit(0))
    v = F.col("v")
    if conn == 4:
        local = v - v * at("e") - v * at("s") + v * at("e") * at("s") * at("se")
    else:
        # distinct unit edges and corners of the union of closed pixels: each is
        # counted in equal parts by the pixels that share it
        shared = lambda *ns: F.lit(1.0) / (1 + sum([at(n) for n in ns[1:]], at(ns[0])))
        corners = shared("n", "w", "nw") + shared("n", "e", "ne") + shared("s", "w", "sw") + shared("s", "e", "se")
        sides = shared("n") + shared("s") + shared("w") + shared("e")
        local = v * (corners - sides + 1.0)
    return d.groupBy(*KEYS).agg(F.round(F.sum(local)).cast("bigint").alias("euler"))


def euler_curve(px: DataFrame, value: str, levels: list[int], conn: int = 4) -> DataFrame:
    """Euler number of the superlevel set at each quantised level.

    Every level is one bit per pixel; pixels, edges and squares are counted by words. With 8 neighbours every square with
    two pixels across counts one less than with 4.
    """
    q = px.select(*KEYS, "x", "y", quantize_level(F.col(value)).alias("q"))
    names = {f"l{k}": F.col("q") >= level for k, level in enumerate(levels)}
    words = with_margins(word_rows(q, KEYS, names | {"known": F.col("q").isNotNull()}), KEYS, [*names, "known"])
    d = words.withColumns({f"s{n}": word_above(n, KEYS, 1) for n in names})
    both = lambda *v: F.bit_count(reduce(Column.bitwiseAND, v, F.lit(INNER_BITS))).cast("bigint")

    def local(n: str) -> Column:
        v, s = F.col(n), F.col(f"s{n}")
        e, se = east(v), east(s)
        out = both(v) - both(v, e) - both(v, s) + both(v, e, s, se)
        empty = [F.bitwise_not(c) for c in (v, e, s, se)]
        return out if conn == 4 else out - both(v, se, empty[1], empty[2]) - both(e, s, empty[0], empty[3])

    d = d.groupBy(*KEYS).agg(F.max(F.col("known") != 0).alias("known"), *[F.sum(local(n)).alias(n) for n in names])
    rows = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(n).alias("euler")) for n, level in zip(names, levels)])).alias("r")
    return d.select(*KEYS, "known", rows).select(*KEYS, "r.level", F.when(F.col("known"), F.col("r.euler")).alias("euler"))


def cost_bounds(px: DataFrame, level: float, inside: str = "inside", alpha: str = "alpha", predicted: str | None = None) -> DataFrame:
    """Squared violation (lower bound) and, if realised, the achievable cost.

    The prediction realises the labelling when it thresholds back to exactly it;
    ``predicted`` is a column of the blurred indicator, or None for a box pixel.
    """
    a, hit = F.col(alpha), F.col(inside)
    gap = F.when(hit, F.greatest(F.lit(level) - a, F.lit(0.0))).otherwise(F.greatest(a - level, F.lit(0.0)))
    pred = F.col(predicted) if predicted else hit.cast("double")
    d = px.groupBy(*KEYS).agg(F.sum(gap * gap).alias("lower"), F.bool_and((pred >= level) == hit).alias("realised"), F.sum((pred - a) * (pred - a)).alias("__c"))
    return d.select(*KEYS, "lower", F.when(F.col("realised"), F.col("__c")).alias("achievable"))


def code_bits(px: DataFrame, signatures: DataFrame, inside: str = "inside") -> DataFrame:
    """Bits of a labelling: counts, one start per region, crack steps."""
    d = neighbours(px.select(*KEYS, "x", "y", F.col(inside).alias("v")), KEYS, ["v"], clamp=False, diagonal=False)
    at = lambda n: F.coalesce(F.col(f"{n}.v"), F.lit(False))
    v = F.col("v")
    one = lambda c: c.cast("bigint")
    steps = one(v != at("e")) + one(v != at("s")) + one((F.col("x") == 0) & v) + one((F.col("y") == 0) & v)
    s = d.groupBy(*KEYS).agg(F.sum(steps).alias("steps")).join(signatures, KEYS)
    pos = F.log2(F.greatest("width", "height").cast("double")) * 2.0
    lg = lambda c: F.log2((F.col(c) + 1).cast("double"))
    bits = lg("components") + lg("holes") + (F.col("components") + F.col("holes")) * pos + F.col("steps") * math.log2(3.0)
    return s.select(*KEYS, "steps", bits.alias("bits"))


def edit_name(dc: Column, dh: Column) -> Column:
    """Name of a topology edit from its component and hole deltas."""
    unit = {(-1, 0): "bridge_close", (1, 0): "gap_open", (0, 1): "hole_open", (0, -1): "hole_fill", (0, 0): "identity"}
    out = F.format_string("compound(c%+d,h%+d)", dc, dh)
    for (c, h), name in unit.items():
        out = F.when((dc == c) & (dh == h), name).otherwise(out)
    return out


# ---- R-8 --------------------------------------------------------------------


def _one_tree(px: DataFrame, conn: int) -> tuple[DataFrame, DataFrame]:
    """Births (level) and deaths (level, persistence) of superlevel components.

    Pixels climb to their highest neighbour, which gives basins; basins meet at
    saddles. A basin whose highest saddle leads to an elder one dies there: until
    that level nothing touched it. All such basins are merged at once and the
    saddles rewritten, so a few rounds over the shrinking saddle graph suffice.
    """
    d = px.withColumn("id", pixel_id())
    near = neighbours(d, KEYS, ["q", "id"], clamp=False)
    names = FOUR if conn == 4 else EIGHT
    order = lambda q, i: F.struct(q.alias("q"), (-i).alias("i"))
    top = F.greatest(*[F.when(F.col(f"{n}.q").isNotNull(), order(F.col(f"{n}.q"), F.col(f"{n}.id"))) for n in names])
    here = order(F.col("q"), F.col("id"))
    climb = near.filter(top > here).select(*KEYS, "id", (-top["i"]).alias("to"))
    peak = follow(climb, KEYS)
    based = near.join(peak, [*KEYS, "id"], "left").withColumn("basin", F.coalesce("to", "id"))
    based = cut(based.select(*KEYS, "x", "y", "q", "id", "basin"))
    births = based.filter(F.col("id") == F.col("basin")).select(*KEYS, F.col("basin").alias("id"), F.col("q").alias("birth"))
    side = neighbours(based, KEYS, ["q", "basin"], clamp=False)
    forward = ("e", "s") if conn == 4 else ("e", "s", "se", "sw")
    pair = F.explode(F.array(*[F.struct(F.col(f"{n}.basin").alias("o"), F.least(F.col("q"), F.col(f"{n}.q")).alias("w")) for n in forward])).alias("p")
    saddles = side.select(*KEYS, "basin", pair).filter(F.col("p.o") != F.col("basin")).groupBy(
        *KEYS, F.least("basin", "p.o").alias("a"), F.greatest("basin", "p.o").alias("b")
    ).agg(F.max("p.w").alias("w"))
    saddles = cut(saddles)
    age = births.select(*KEYS, "id", "birth")
    dead: DataFrame | None = None
    while not saddles.isEmpty():
        both = saddles.select(*KEYS, F.col("a").alias("id"), F.col("b").alias("o"), "w").unionByName(
            saddles.select(*KEYS, F.col("b").alias("id"), F.col("a").alias("o"), "w")
        )
        both = both.join(age, [*KEYS, "id"]).join(age.select(*KEYS, F.col("id").alias("o"), F.col("birth").alias("o_birth")), [*KEYS, "o"])
        # the highest saddle; among equal ones prefer the eldest side
        best = both.groupBy(*KEYS, "id", "birth").agg(F.max(F.struct("w", "o_birth", (-F.col("o")).alias("no"))).alias("m"))
        elder = F.struct(F.col("m.o_birth"), F.col("m.no")) > F.struct("birth", (-F.col("id")).alias("no"))
        dying = cut(best.filter(elder).select(*KEYS, "id", (-F.col("m.no")).alias("to"), "birth", F.col("m.w").alias("level")))
        gone = dying.select(*KEYS, "id", "birth", "level")
        dead = gone if dead is None else dead.unionByName(gone)
        into = follow(dying, KEYS)
        s = saddles
        for c in ("a", "b"):
            s = s.join(into.select(*KEYS, F.col("id").alias(c), F.col("to").alias(f"__{c}")), [*KEYS, c], "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
        s = s.filter(F.col("a") != F.col("b")).groupBy(*KEYS, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))
        saddles = cut(s)
    if dead is None:
        dead = births.limit(0).select(*KEYS, "id", "birth", F.lit(0).alias("level"))
    deaths = dead.filter(F.col("birth") > F.col("level"))
    # a peak that dies at its own level is only part of a plateau
    flat = dead.filter(F.col("birth") == F.col("level")).select(*KEYS, "id")
    return births.join(flat, [*KEYS, "id"], "left_anti").select(*KEYS, F.col("birth").alias("level")), deaths


def persistence_events(px: DataFrame, value: str, conn: int = 4) -> DataFrame:
    """Births and merges of components and gaps over 512 levels, elder rule."""
    q = px.select(*KEYS, "x", "y", quantize_level(F.col(value)).alias("q"))
    out = None
    trees = [(q, conn, "component_birth", "bridge_merge", False), (q.withColumn("q", F.lit(LEVEL_QUANTA) - F.col("q")), 12 - conn, "gap_birth", "gap_merge", True)]
    for field, c, born, merged, flip in trees:
        births, deaths = _one_tree(cut(field), c)
        batch = field.groupBy(*KEYS, F.col("q").alias("level")).agg(F.count("*").alias("batch_pixels"))
        rows = births.select(*KEYS, F.lit(born).alias("kind"), "level", F.lit(0).alias("p")).unionByName(
            deaths.select(*KEYS, F.lit(merged).alias("kind"), "level", (F.col("birth") - F.col("level")).alias("p"))
        )
        rows = rows.join(batch, [*KEYS, "level"])
        level = F.col("level") / float(LEVEL_QUANTA)
        rows = rows.select(
            *KEYS, "kind", (F.lit(1.0) - level if flip else level).alias("level"), (F.col("p") / float(LEVEL_QUANTA)).alias("persistence"), "batch_pixels"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def tie_batches(px: DataFrame, value: str) -> DataFrame:
    """(image_id, tie_batches, largest_batch_pixels): levels that more than one pixel enters at, and the most that do.

    Levels of the gaps are those of the components turned around, so both trees have the same batches.
    """
    level = quantize_level(F.col(value)).alias("q")
    batches = px.groupBy(*KEYS, level).agg(F.count("*").alias("n"))
    return batches.groupBy(*KEYS).agg(F.count_if(F.col("n") > 1).alias("tie_batches"), F.max("n").alias("largest_batch_pixels"))


# ---- R-11 -------------------------------------------------------------------


def prune_unsupported(px: DataFrame, min_core: float, edge_bits: float = 0.25) -> DataFrame:
    """Repaint regions without an area core to their cheapest neighbour label.

    Columns in: label, weight, ``options`` (label, d2 per paint). All regions are
    judged on the given labelling at once, so the scan order plays no part.
    """
    d = cut(regions(px, "label"))
    near = neighbours(d.select(*KEYS, "x", "y", "region", "label", "weight"), KEYS, ["region", "label"], clamp=False, diagonal=False)
    same = lambda n: F.coalesce(F.col(f"{n}.region") == F.col("region"), F.lit(False))
    core = (same("e") | same("w")) & (same("n") | same("s"))
    near = cut(near.withColumn("__core", F.when(core, F.col("weight")).otherwise(F.lit(0.0))))
    weak = near.groupBy(*KEYS, "region").agg(F.sum("__core").alias("c")).filter(F.col("c") < min_core).select(*KEYS, "region")
    touch = near.join(weak, [*KEYS, "region"]).select(*KEYS, "region", "label", F.explode(F.array(*[F.col(f"{n}.label") for n in FOUR])).alias("to"))
    shared = touch.filter(F.col("to") != F.col("label")).groupBy(*KEYS, "region", "to").agg(F.count("*").alias("shared"))
    data = d.join(weak, [*KEYS, "region"]).select(*KEYS, "region", "weight", F.explode("options").alias("o")).groupBy(
        *KEYS, "region", F.col("o.label").alias("to")
    ).agg(F.sum(F.col("weight") * F.col("o.d2") / 65025.0).alias("data"))
    cost = shared.join(data, [*KEYS, "region", "to"]).withColumn("cost", F.round(F.col("data") - F.col("shared") * edge_bits, 9))
    pick = cost.groupBy(*KEYS, "region").agg(F.min_by("to", F.struct("cost", "to")).alias("__to"))
    return d.join(pick, [*KEYS, "region"], "left").withColumn("pruned", F.coalesce("__to", "label")).drop("__to")


# ---- R-12, R-13 -------------------------------------------------------------


def merge_regions(px: DataFrame, edits: DataFrame, label: str = "label", exterior: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge region ``remove`` into ``keep`` for one edit per image.

    Returns the new label table and a ledger with the refusal of each edit; a
    refused edit leaves its image unchanged.
    """
    d = cut(regions(px, label, 4, exterior))
    nodes, edges = adjacency_graph(px, label, exterior)
    nodes, edges = cut(nodes), cut(edges)
    n = lambda s: nodes.select(*KEYS, F.col("region").alias(s), F.col("label").alias(f"label_{s}"), F.col("is_exterior").alias(f"ext_{s}"), F.lit(True).alias(f"has_{s}"))
    e = edits.join(n("keep"), [*KEYS, "keep"], "left").join(n("remove"), [*KEYS, "remove"], "left")
    low, high = F.least("keep", "remove"), F.greatest("keep", "remove")
    e = e.withColumns({"a": low, "b": high}).join(edges, [*KEYS, "a", "b"], "left")
    refusal = (
        F.when(F.col("has_keep").isNull() | F.col("has_remove").isNull(), "unknown_region")
        .when(F.col("ext_keep") | F.col("ext_remove"), "edits_exterior")
        .when(F.col("shared_segments").isNull(), "not_adjacent")
    )
    judged = cut(e.select(*KEYS, "keep", "remove", F.col("label_keep").alias("to"), refusal.alias("refusal")))
    ok = judged.filter("refusal is null").select(*KEYS, F.col("remove").alias("region"), "to")
    out = d.join(ok, [*KEYS, "region"], "left")
    hits = out.filter(F.col("to").isNotNull()).groupBy(*KEYS).agg(F.count("*").alias("affected"))
    ledger = judged.join(hits, KEYS, "left").select(*KEYS, "keep", "remove", "refusal", F.coalesce("affected", F.lit(0)).alias("affected_pixels"))
    return out.select(*KEYS, "x", "y", F.coalesce("to", label).alias(label)), ledger


def split_regions(px: DataFrame, moves: DataFrame, label: str = "label", exterior: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Move a connected subset of a region to a new label, one edit per image.

    ``moves``: image_id, region, new_label, x, y. Both sides must stay connected.
    """
    d = cut(regions(px, label, 4, exterior))
    edit = moves.groupBy(*KEYS).agg(F.first("region").alias("target"), F.first("new_label").alias("new_label"), F.count("*").alias("asked"))
    joined = d.join(edit, KEYS, "left").join(moves.select(*KEYS, "x", "y", F.lit(True).alias("moved")), [*KEYS, "x", "y"], "left")
    joined = cut(joined.withColumn("moved", F.coalesce("moved", F.lit(False))))
    inside = joined.filter(F.col("region") == F.col("target"))
    facts = joined.groupBy(*KEYS).agg(
        F.count_if((F.col("region") == F.col("target")) & F.col("moved")).alias("hit"),
        F.count_if(F.col("region") == F.col("target")).alias("size"),
        F.count_if(F.col(label) == F.col("new_label")).alias("present"),
        F.bool_or((F.col("region") == F.col("target")) & (F.col(label) == F.lit(exterior))).alias("ext"),
    )
    parts = regions(inside.withColumn("side", F.col("moved").cast("int")).select(*KEYS, "x", "y", "side"), "side", 4)
    pieces = parts.groupBy(*KEYS).agg(F.countDistinct("region").alias("pieces"))
    e = edit.join(facts, KEYS, "left").join(pieces, KEYS, "left")
    refusal = (
        F.when(F.coalesce("size", F.lit(0)) == 0, "unknown_region")
        .when(F.col("ext"), "edits_exterior")
        .when(F.col("present") > 0, "label_already_present")
        .when(F.col("hit") != F.col("asked"), "pixel_outside_region")
        .when(F.col("asked") >= F.col("size"), "not_a_strict_subset")
        .when(F.col("pieces") != 2, "disconnected_split")
    )
    judged = cut(e.select(*KEYS, refusal.alias("refusal"), "asked"))
    ok = judged.filter("refusal is null").select(*KEYS, F.lit(True).alias("__ok"))
    out = joined.join(ok, KEYS, "left")
    new = F.when(F.col("__ok") & F.col("moved"), F.col("new_label")).otherwise(F.col(label))
    ledger = judged.select(*KEYS, "refusal", F.when(F.col("refusal").isNull(), F.col("asked")).otherwise(F.lit(0)).alias("affected_pixels"))
    return out.select(*KEYS, "x", "y", new.alias(label)), ledger


def assign_paint(px: DataFrame, edits: DataFrame, label: str = "label", exterior: int | None = None) -> DataFrame:
    """Ledger of paint assignments by label (``to_label``, ``transparent``)."""
    counts = px.groupBy(*KEYS, F.col(label).alias("to_label")).agg(F.count("*").alias("n"))
    d = edits.join(counts, [*KEYS, "to_label"], "left")
    is_ext = F.lit(False) if exterior is None else F.col("to_label") == exterior
    refusal = F.when(F.col("n").isNull(), "unknown_label").when(is_ext & ~F.col("transparent"), "opaque_exterior").when(~is_ext & F.col("transparent"), "transparent_interior")
    return d.select(*KEYS, "to_label", refusal.alias("refusal"), F.when(refusal.isNull(), F.col("n")).otherwise(F.lit(0)).alias("affected_pixels"))


def scene_digest(px: DataFrame, label: str = "label") -> DataFrame:
    """(image_id, digest): order-free digest of the labels of an image, combined before the shuffle."""
    h = F.xxhash64("x", "y", label)
    parts = px.groupBy(*KEYS).agg(F.bit_xor(h).alias("a"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("b"), F.count("*").alias("n"))
    return parts.select(*KEYS, F.concat_ws("-", F.hex("a"), F.hex("b"), F.hex("n")).alias("digest"))


def run_script(px: DataFrame, script: list[dict], label: str = "label", base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply a short edit script to every image at once.

    Steps: merge(keep, remove), split(label, move, new_label), assign(label), protect(label), restore(checkpoint), all by
    label; ``move`` is a condition on x and y, in SQL. ``base``: image_id and the digest of the scene that the script was written
    for; a script for another scene is refused before its first step (step -1). A refused step ends the script of that
    image and voids it: the image keeps its first labels. The loop runs over the script, never over images. Returns
    the final labels and a ledger of one row per image and step that ran.
    """
    first = cut(px.select(*KEYS, "x", "y", label))
    images = cut(first.select(*KEYS).distinct())
    entry = lambda rows, step, kind: rows.select(*KEYS, F.lit(step).alias("step"), F.lit(kind).alias("op"), "refusal", "changed")
    alive, ledger = images, None
    if base is not None:
        meant = images.join(scene_digest(first, label), KEYS).join(base.withColumnRenamed("digest", "__meant"), KEYS, "left")
        other = cut(meant.filter(~F.col("digest").eqNullSafe(F.col("__meant"))).select(*KEYS))
        ledger = entry(other.withColumns({"refusal": F.lit("base_mismatch"), "changed": F.lit(0).cast("bigint")}), -1, "base")
        alive = cut(images.join(other, KEYS, "left_anti"))
    current = first.join(alive, KEYS, "left_semi")
    snapshots, protected = [current], []
    guards: list[list[int]] = [[]]
    for i, edit in enumerate(script):
        kind = edit["op"]
        before = current
        named = [edit[k] for k in ("keep", "remove", "label") if k in edit]
        guarded = any(n in protected for n in [*named, *[edit[k] for k in ("new_label",) if k in edit]])
        refusal = F.when(F.lit(kind != "protect" and guarded), "protected_label")
        bad = alive
        if kind == "restore":
            known = 0 <= edit["checkpoint"] < len(snapshots)
            refusal = F.when(F.lit(not known), "invalid_restore")
            if known:
                current, protected = snapshots[edit["checkpoint"]], list(guards[edit["checkpoint"]])
        else:
            present = before.filter(F.col(label).isin(named)).groupBy(*KEYS).agg(F.countDistinct(label).alias("have"))
            bad = bad.join(present, KEYS, "left")
            refusal = refusal.when(F.coalesce("have", F.lit(0)) < len(set(named)), "unknown_label")
        if kind in ("merge", "split"):
            found = cut(regions(before.filter(F.col(label).isin(named)), label))
            per = found.groupBy(*KEYS).agg(*[F.countDistinct(F.when(F.col(label) == n, F.col("region"))).alias(f"__r{j}") for j, n in enumerate(named)])
            bad = bad.join(per, KEYS, "left")
            refusal = refusal.when(F.greatest(*[F.col(f"__r{j}") for j in range(len(named))], F.lit(0)) > 1, "ambiguous_label")
        if kind == "merge":
            side = neighbours(before, KEYS, [label], clamp=False, diagonal=False)
            meet = (F.col(label) == edit["keep"]) & F.greatest(*[F.coalesce(F.col(f"{n}.{label}") == edit["remove"], F.lit(False)) for n in FOUR])
            bad = bad.join(side.groupBy(*KEYS).agg(F.bool_or(meet).alias("__meet")), KEYS, "left")
            refusal = refusal.when(~F.col("__meet"), "not_adjacent")
            current = before.withColumn(label, F.when(F.col(label) == edit["remove"], edit["keep"]).otherwise(F.col(label)))
        if kind == "split":
            one = found.groupBy(*KEYS).agg(F.countDistinct("region").alias("__n"), F.min("region").alias("region")).filter("__n = 1").select(*KEYS, "region")
            moves = before.filter((F.col(label) == edit["label"]) & F.expr(edit["move"])).join(one, KEYS).select(*KEYS, "region", F.lit(edit["new_label"]).alias("new_label"), "x", "y")
            current, judged = split_regions(before, moves, label)
            bad = bad.join(judged.select(*KEYS, F.col("refusal").alias("__split"), F.lit(True).alias("__asked")), KEYS, "left")
            refusal = refusal.when(F.col("__asked").isNull(), "nothing_moved").when(F.col("__split").isNotNull(), F.col("__split"))
        if kind == "protect":
            protected = [*protected, edit["label"]]
        bad = cut(bad.select(*KEYS, refusal.alias("refusal")))
        alive = cut(bad.filter("refusal is null").select(*KEYS))
        current = cut(current.join(alive, KEYS, "left_semi"))
        changed = before.join(current.withColumnRenamed(label, "__after"), [*KEYS, "x", "y"]).filter(F.col(label) != F.col("__after"))
        touched = changed.groupBy(*KEYS).agg(F.count("*").alias("changed"))
        step = entry(bad.join(touched, KEYS, "left").withColumn("changed", F.coalesce("changed", F.lit(0))), i, kind)
        ledger = step if ledger is None else ledger.unionByName(step)
        snapshots = [cut(s.join(alive, KEYS, "left_semi")) if any(e["op"] == "restore" for e in script[i + 1 :]) else s for s in snapshots]
        snapshots.append(current)
        guards.append(list(protected))
    final = current.unionByName(first.join(alive, KEYS, "left_anti"))
    return final, ledger.join(alive.withColumn("__v", F.lit(True)), KEYS, "left").withColumn("script_applied", F.col("__v").isNotNull()).drop("__v")


# ---- R-14 ... R-18 ----------------------------------------------------------


def lattice_boundaries(px: DataFrame, label: str = "label", exterior: int | None = None) -> DataFrame:
    """Directed unit segments between regions, and to the exterior at the rim."""
    d = cut(regions(px, label, 4, exterior).join(raster_size(px), KEYS))
    nodes_ext = (
        d.filter(F.col(label) == exterior).groupBy(*KEYS).agg(F.min("region").alias("ext"))
        if exterior is not None
        else d.select(*KEYS).distinct().limit(0).withColumn("ext", F.lit(None).cast("bigint"))
    )
    near = neighbours(d.select(*KEYS, "x", "y", "region", "width", "height"), KEYS, ["region"], clamp=False, diagonal=False).join(nodes_ext, KEYS, "left")
    near = near.withColumn("ext", F.coalesce("ext", F.lit(OUTSIDE)))
    x, y, r = F.col("x"), F.col("y"), F.col("region")

    def seg(when: Column, a: tuple, b: tuple, left: Column) -> Column:
        pt = lambda p: (F.col("x") + p[0], F.col("y") + p[1])
        (sx, sy), (ex, ey) = pt(a), pt(b)
        return F.when(
            when & (left != r),
            F.struct(sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"), left.alias("left"), r.alias("right")),
        )

    ext = F.col("ext")
    rows = F.array(
        seg(F.col("e.region").isNotNull(), (1, 1), (1, 0), F.col("e.region")),
        seg(F.col("s.region").isNotNull(), (0, 1), (1, 1), F.col("s.region")),
        seg(y == 0, (1, 0), (0, 0), ext),
        seg(y == F.col("height") - 1, (0, 1), (1, 1), ext),
        seg(x == 0, (0, 0), (0, 1), ext),
        seg(x == F.col("width") - 1, (1, 1), (1, 0), ext),
    )
    return near.select(*KEYS, F.explode(rows).alias("b")).filter("b is not null").select(*KEYS, "b.*").distinct()


def junctions(boundaries: DataFrame) -> DataFrame:
    """Vertices whose number of incident segments is not two."""
    ends = F.explode(F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")))).alias("v")
    d = boundaries.select(*KEYS, ends).groupBy(*KEYS, "v.x", "v.y").agg(F.count("*").alias("degree"))
    return d.filter(F.col("degree") != 2)


def half_edges(boundaries: DataFrame) -> DataFrame:
    """Both directions of every segment, each owned by the face on its left."""
    b = F.struct("sx", "sy", "ex", "ey")
    fwd = boundaries.select(*KEYS, "sx", "sy", "ex", "ey", F.col("left").alias("face"), b.alias("edge"), F.lit(True).alias("forward"))
    rev = boundaries.select(
        *KEYS, F.col("ex").alias("sx"), F.col("ey").alias("sy"), F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("right").alias("face"), b.alias("edge"), F.lit(False).alias("forward")
    )
    h = fwd.unionByName(rev)
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    heading = F.when(dx == 1, 0).when(dy == -1, 1).when(dx == -1, 2).otherwise(3)
    ident = (F.col("sy").cast("bigint") * STRIDE + F.col("sx")) * 4 + heading
    return h.withColumns({"heading": heading, "id": ident})


def face_loops(boundaries: DataFrame) -> DataFrame:
    """Closed boundary walks of every face: length and signed area.

    The successor of a half edge leaves its end with the smallest turn among the
    half edges of the same face; that is a permutation, whose cycles are the
    components of the (edge, successor) pairs.
    """
    h = cut(half_edges(boundaries))
    out = h.select(*KEYS, "face", F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("id").alias("nid"), F.col("heading").alias("nh"))
    turn = (F.col("nh") + 4 - F.col("heading")) % 4
    nxt = h.join(out, [*KEYS, "face", "ex", "ey"]).groupBy(*KEYS, "face", "id").agg(F.min_by("nid", F.struct(turn.alias("t"), "nid")).alias("next"))
    nxt = cut(nxt)
    roots = components(nxt.select(*KEYS, F.col("id").alias("src"), F.col("next").alias("dst")), KEYS)
    owned = h.join(roots, [*KEYS, "id"], "left").withColumn("loop", F.coalesce("root", "id"))
    cross = F.col("sx") * F.col("ey") - F.col("ex") * F.col("sy")
    return owned.groupBy(*KEYS, "face", "loop").agg(F.count("*").alias("edges"), (F.sum(cross) / 2.0).alias("signed_area"))


def audit(boundaries: DataFrame, loops: DataFrame, faces: DataFrame) -> DataFrame:
    """Violations of the planar subdivision, by rule and image.

    ``faces``: image_id, face. Rules: a segment with one face on both sides, an
    unknown face, an undirected segment used more than once, a face without a
    loop, and an open vertex (odd number of incident segments).
    """
    b = boundaries
    ends = F.explode(F.array(F.struct("sx", "sy"), F.struct(F.col("ex").alias("sx"), F.col("ey").alias("sy")))).alias("v")
    here, there = F.array("sy", "sx"), F.array("ey", "ex")
    und = b.select(*KEYS, F.struct(F.least(here, there).alias("low"), F.greatest(here, there).alias("high")).alias("u"))
    used = b.select(*KEYS, F.explode(F.array("left", "right")).alias("face")).distinct()
    rules = {
        "same_face_both_sides": b.filter(F.col("left") == F.col("right")).select(*KEYS),
        "unknown_face": used.join(faces, [*KEYS, "face"], "left_anti").select(*KEYS),
        "segment_reused": und.groupBy(*KEYS, "u").count().filter("count > 1").select(*KEYS),
        "face_without_loop": faces.join(loops, [*KEYS, "face"], "left_anti").select(*KEYS),
        "open_vertex": b.select(*KEYS, ends).groupBy(*KEYS, "v").count().filter("count % 2 = 1").select(*KEYS),
    }
    out = None
    for name, d in rules.items():
        d = d.groupBy(*KEYS).agg(F.count("*").alias("violations")).select(*KEYS, F.lit(name).alias("rule"), "violations")
        out = d if out is None else out.unionByName(d)
    return out


def arrangement(boundaries: DataFrame) -> DataFrame:
    """Half edges with the ids of their twin and successor and the loop they lie on."""
    h = cut(half_edges(boundaries))
    out = h.select(*KEYS, "face", F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("id").alias("nid"), F.col("heading").alias("nh"))
    turn = (F.col("nh") + 4 - F.col("heading")) % 4
    nxt = h.join(out, [*KEYS, "face", "ex", "ey"]).groupBy(*KEYS, "face", "id").agg(F.min_by("nid", F.struct(turn.alias("t"), "nid")).alias("next"))
    twin = (F.col("ey").cast("bigint") * STRIDE + F.col("ex")) * 4 + (F.col("heading") + 2) % 4
    full = cut(h.join(nxt, [*KEYS, "face", "id"], "left").withColumn("twin", twin))
    roots = components(full.filter("next is not null").select(*KEYS, F.col("id").alias("src"), F.col("next").alias("dst")), KEYS)
    owned = full.join(roots, [*KEYS, "id"], "left").withColumn("loop", F.coalesce("root", "id"))
    return owned.select(*KEYS, "id", "sx", "sy", "ex", "ey", "face", "twin", "next", "loop")


def audit_arrangement(h: DataFrame, faces: DataFrame) -> DataFrame:
    """Violations of a half-edge structure by rule and image; nothing that it states is taken for granted.

    ``h`` as from ``arrangement``; ``faces``: image_id, face. ``next`` must be a permutation of the half edges that goes on
    where each ends, its orbits must be the loops, a loop lies in one face; ``twin`` must be an involution that reverses a
    half edge and crosses to another face; every face is known and has a loop; and every component of the drawing has
    vertices - edges + loops = 2, with the orbits counted anew.
    """
    h, faces = cut(h), cut(faces)
    c = F.col
    there = h.select(*KEYS, *[c(k).alias(f"to_{k}") for k in ("id", "sx", "sy", "ex", "ey", "face", "twin")], F.lit(True).alias("known"))
    follow_to = h.join(there.withColumn("next", c("to_id")), [*KEYS, "next"], "left")
    cross_to = h.join(there.withColumn("twin", c("to_id")), [*KEYS, "twin"], "left")
    entered = h.select(*KEYS, "id").join(h.groupBy(*KEYS, c("next").alias("id")).agg(F.count("*").alias("entries")), [*KEYS, "id"], "left")
    roots = components(h.filter("next is not null").select(*KEYS, c("id").alias("src"), c("next").alias("dst")), KEYS)
    orbit = cut(h.select(*KEYS, "id", "loop", "face", "sx", "sy", "ex", "ey").join(roots, [*KEYS, "id"], "left").withColumn("orbit", F.coalesce("root", "id")))
    vertex = lambda x, y: c(y).cast("bigint") * STRIDE + c(x)
    parts = components(h.select(*KEYS, vertex("sx", "sy").alias("src"), vertex("ex", "ey").alias("dst")), KEYS).withColumnRenamed("id", "v").withColumnRenamed("root", "part_of")
    placed = orbit.withColumn("v", vertex("sx", "sy")).join(parts, [*KEYS, "v"], "left").withColumn("part", F.coalesce("part_of", "v"))
    euler = placed.groupBy(*KEYS, "part").agg((F.countDistinct("v") * 2 - F.count("*") + F.countDistinct("orbit") * 2).alias("twice"))
    loops = orbit.groupBy(*KEYS, "loop").agg(F.countDistinct("orbit").alias("orbits"), F.countDistinct("face").alias("faces"))
    owned = h.select(*KEYS, "face", F.lit(True).alias("owned")).distinct().join(faces.withColumn("listed", F.lit(True)), [*KEYS, "face"], "full")
    reversed_ = (c("sx") == c("to_ex")) & (c("sy") == c("to_ey")) & (c("ex") == c("to_sx")) & (c("ey") == c("to_sy"))
    # rules over the same rows are counted together, so each join runs once
    judged = [
        (follow_to, {"successor_unknown": c("known").isNull(), "successor_elsewhere": (c("ex") != c("to_sx")) | (c("ey") != c("to_sy"))}),
        (entered, {"not_entered_once": F.coalesce("entries", F.lit(0)) != 1}),
        (cross_to, {
            "twin_unknown": c("known").isNull(), "twin_no_involution": (c("to_twin") != c("id")) | (c("twin") == c("id")),
            "twin_not_reversed": ~reversed_, "same_face_both_sides": c("face") == c("to_face"),
        }),
        (loops, {"loop_of_several_orbits": c("orbits") > 1, "loop_of_several_faces": c("faces") > 1}),
        (orbit.groupBy(*KEYS, "orbit").agg(F.countDistinct("loop").alias("n")), {"orbit_of_several_loops": c("n") > 1}),
        (owned, {"unknown_face": c("listed").isNull(), "face_without_loop": c("owned").isNull()}),
        (euler, {"euler_identity": c("twice") != 4}),
    ]
    out = None
    for rows, rules in judged:
        found = [F.struct(F.lit(name).alias("rule"), F.count_if(broken).alias("violations")) for name, broken in rules.items()]
        d = rows.groupBy(*KEYS).agg(F.array(*found).alias("found")).select(*KEYS, F.inline("found")).filter("violations > 0")
        out = d if out is None else out.unionByName(d)
    return out


def rebuild_regions(boundaries: DataFrame, px: DataFrame) -> DataFrame:
    """Rebuild the region of every pixel from vertical segments and compare.

    Scanning a row from outside, each vertical segment names the region to its
    east; the region to its west must be the one carried so far. Columns in
    ``px``: region. Rows out: mismatching pixels or owners.
    """
    v = boundaries.filter(F.col("sx") == F.col("ex"))
    up = F.col("ey") < F.col("sy")
    at = v.select(
        *KEYS, F.col("sx").alias("x"), F.least("sy", "ey").alias("y"), F.when(up, F.col("left")).otherwise(F.col("right")).alias("east"),
        F.when(up, F.col("right")).otherwise(F.col("left")).alias("west"),
    )
    w = Window.partitionBy(*KEYS, "y").orderBy("x")  # a row: bounded by the ingest limit
    d = px.select(*KEYS, "x", "y", "region").join(at, [*KEYS, "x", "y"], "left")
    d = d.withColumn("carried", F.last("east", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("before", F.last("east", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    wrong = ~F.col("carried").eqNullSafe(F.col("region"))
    owner = F.col("west").isNotNull() & F.col("before").isNotNull() & (F.col("west") != F.col("before"))
    return d.select(*KEYS, "x", "y", wrong.alias("region_differs"), owner.alias("owner_differs"))


# ---- R-19, R-21 -------------------------------------------------------------


def skeleton_graph(px: DataFrame, distances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node clusters and traced edges of a thinned foreground.

    Pixels with other than two 8-neighbours are node pixels; touching ones form a
    node. The rest splits into edges (one component each); an edge that touches
    no node is a cycle. Edge width is the exact median of 2*sqrt(d2) - 1.
    """
    near = neighbours(px.select(*KEYS, "x", "y", F.col("inside").cast("int").alias("m")), KEYS, ["m"], clamp=False).filter("m = 1")
    degree = F.coalesce(F.col(f"{EIGHT[0]}.m"), F.lit(0))
    for n in EIGHT[1:]:
        degree = degree + F.coalesce(F.col(f"{n}.m"), F.lit(0))
    d = cut(near.select(*KEYS, "x", "y", degree.alias("degree")).withColumn("is_node", F.col("degree") != 2))
    part = cut(regions(d.withColumn("label", F.col("is_node").cast("int")), "label", 8))
    nodes = part.filter("is_node").groupBy(*KEYS, F.col("region").alias("node")).agg(F.count("*").alias("pixels"), F.max("degree").alias("max_degree"))
    dense = px.select(*KEYS, "x", "y").join(part.select(*KEYS, "x", "y", "region", "is_node"), [*KEYS, "x", "y"], "left")
    side = neighbours(dense, KEYS, ["region", "is_node"], clamp=False)
    ends = F.explode(F.array(*[F.when(F.col(f"{n}.is_node"), F.col(f"{n}.region")) for n in EIGHT])).alias("node")
    touch = side.filter("not is_node").select(*KEYS, "region", ends).filter("node is not null")
    ends_of = touch.groupBy(*KEYS, "region").agg(F.countDistinct("node").alias("end_nodes"))
    width = part.filter("not is_node").join(distances, [*KEYS, "x", "y"]).withColumn("w", F.sqrt(F.col("d2").cast("double")) * 2.0 - 1.0)
    from rasterlake.operators.quantiles import index_quantiles

    med = index_quantiles(width, [*KEYS, "region"], "w", {"median_width": ("floor", 0.5)})
    edges = med.join(ends_of, [*KEYS, "region"], "left").select(
        *KEYS, F.col("region").alias("edge"), F.col("n").alias("pixels"), F.coalesce("end_nodes", F.lit(0)).alias("end_nodes"),
        F.col("end_nodes").isNull().alias("is_cycle"), "median_width",
    )
    return nodes, edges


# neighbours in the order of their pixel ids; the one that looks back at direction d is 7 - d
RING = [("nw", -1, -1), ("n", 0, -1), ("ne", 1, -1), ("w", -1, 0), ("e", 1, 0), ("sw", -1, 1), ("s", 0, 1), ("se", 1, 1)]


def _skeleton_pixels(px: DataFrame) -> DataFrame:
    """Skeleton pixels with their ``node`` (NULL on a line) and their neighbours: way, id, node.

    Pixels with other than two neighbours are node pixels, touching ones one node. A closed line without any gets its
    first pixel as a node.
    """
    near = neighbours(px.select(*KEYS, "x", "y", F.col("inside").cast("int").alias("m")), KEYS, ["m"], clamp=False).filter("m = 1")
    degree = sum((F.coalesce(F.col(f"{n}.m"), F.lit(0)) for n in EIGHT), F.lit(0))
    labelled = cut(near.select(*KEYS, "x", "y", (degree != 2).cast("int").alias("label")))
    part = cut(regions(labelled, "label", 8).select(*KEYS, "x", "y", "label", "region"))
    dense = px.select(*KEYS, "x", "y").join(part, [*KEYS, "x", "y"], "left")
    side = neighbours(dense, KEYS, ["label", "region"], clamp=False).filter("label is not null")
    ring = F.array(*[F.struct(F.lit(k).alias("way"), (pixel_id() + dy * STRIDE + dx).alias("id"), F.col(f"{n}.label").alias("label"), F.col(f"{n}.region").alias("region")) for k, (n, dx, dy) in enumerate(RING)])
    d = cut(side.select(*KEYS, "x", "y", pixel_id().alias("id"), "label", "region", F.filter(ring, lambda e: e["label"].isNotNull()).alias("ring")))
    open_lines = d.filter("label = 0").groupBy(*KEYS, "region").agg(F.bool_or(F.exists("ring", lambda e: e["label"] == 1)).alias("open"))
    d = d.join(open_lines.filter("not open").select(*KEYS, "region", F.lit(True).alias("closed")), [*KEYS, "region"], "left")
    closed = F.coalesce("closed", F.lit(False))
    node = lambda label, i, region: F.when((label == 1) | (closed & (i == region)), region)
    own = node(F.col("label"), F.col("id"), F.col("region")).alias("node")
    around_it = F.transform("ring", lambda e: F.struct(e["way"].alias("way"), e["id"].alias("id"), node(e["label"], e["id"], e["region"]).alias("node")))
    return d.select(*KEYS, "x", "y", "id", own, around_it.alias("ring"))


def trace_skeleton(px: DataFrame, distances: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the ordered pixels of edges of a thinned foreground.

    A step from a pixel to a neighbour is a link; where it enters a line pixel the next link leaves through that pixel's
    other neighbour, which the entered pixel knows without a join. The links of all edges, each in both directions, are
    lists that end at nodes, and list ranking gives every link its end and its distance to it in a logarithmic number of
    rounds. An edge is its direction with the smaller first link.

    Nodes: node, x, y, pixels, degree. Edges: edge, start, end, pixels (on the line), length, width (the median over all
    its pixels, in 64ths). Points: edge, k, x, y, from the start pixel to the end pixel.
    """
    d = cut(_skeleton_pixels(px))
    step = lambda way: F.when(way.isin(*[k for k, (_, dx, dy) in enumerate(RING) if dx and dy]), math.sqrt(2)).otherwise(1.0)
    entered = d.select(*KEYS, "id", "node", "ring", F.explode("ring").alias("a"))
    other = F.get(F.filter("ring", lambda e: e["way"] != F.col("a.way")), F.lit(0))  # a line pixel has two
    links = entered.filter(F.col("node").isNull() | F.col("a.node").isNull()).select(
        *KEYS, (F.col("a.id") * 8 + 7 - F.col("a.way")).alias("id"), F.when(F.col("node").isNull(), F.col("id") * 8 + other["way"]).alias("next"),
        step(other["way"]).alias("step"), F.col("a.node").alias("from"), F.col("node").alias("into"), F.col("a.id").alias("tail_pixel"), F.col("id").alias("pixel"),
        (F.col("id") * 8 + F.col("a.way")).alias("back"), step(F.col("a.way")).alias("first_step"),
    )
    links = cut(links)
    ranked = rank_lists(links.select(*KEYS, "id", "next", "step"), KEYS)
    known = cut(links.join(ranked, [*KEYS, "id"]).select(*KEYS, "id", "tail", "hops", "reach", "from", "into", "tail_pixel", "pixel", "back", "first_step"))
    ends = known.filter("into is not null").select(*KEYS, F.col("id").alias("tail"), F.col("into").alias("end"), "back")
    starts = known.filter("from is not null").drop("back", "into").join(ends, [*KEYS, "tail"]).filter(F.col("id") <= F.col("back"))
    edges = cut(starts.select(*KEYS, F.col("id").alias("edge"), "tail", F.col("from").alias("start"), "end", F.col("hops").alias("pixels"), (F.col("reach") + F.col("first_step")).alias("length"), "tail_pixel"))
    on = edges.select(*KEYS, "edge", "tail", F.col("pixels").alias("__n"), "tail_pixel")
    inner = known.select(*KEYS, "tail", "hops", "pixel").join(on.drop("tail_pixel"), [*KEYS, "tail"]).select(*KEYS, "edge", (F.col("__n") - F.col("hops") + 1).alias("k"), F.col("pixel").alias("id"))
    points = inner.unionByName(on.select(*KEYS, "edge", F.lit(0).cast("long").alias("k"), F.col("tail_pixel").alias("id")))
    points = cut(points.select(*KEYS, "edge", "k", id_x("id").alias("x"), id_y("id").alias("y")))
    wide = points.join(distances, [*KEYS, "x", "y"]).withColumn("w", F.greatest(F.sqrt(F.col("d2").cast("double")) - 0.5, F.lit(0.5)) * 2.0)
    from rasterlake.operators.quantiles import index_quantiles

    median = index_quantiles(wide, [*KEYS, "edge"], "w", {"width": ("floor", 0.5)}).select(*KEYS, "edge", (F.floor(F.greatest("width", F.lit(1.0)) * 64 + 0.5) / 64.0).alias("width"))
    edges = edges.join(median, [*KEYS, "edge"]).select(*KEYS, "edge", "start", "end", "pixels", "length", "width")
    touched = edges.select(*KEYS, F.explode(F.array("start", "end")).alias("node")).groupBy(*KEYS, "node").agg(F.count("*").alias("degree"))
    nodes = d.filter("node is not null").groupBy(*KEYS, "node").agg((F.avg("x") + 0.5).alias("x"), (F.avg("y") + 0.5).alias("y"), F.count("*").alias("pixels"))
    nodes = nodes.join(touched, [*KEYS, "node"], "left").na.fill(0, ["degree"])
    return nodes, edges, points


def roi_pixels(px: DataFrame, rois: DataFrame, halo: int) -> DataFrame:
    """Pixels inside a region of interest grown by ``halo`` and clipped.

    ``rois``: image_id, x0, y0, x1, y1 (half open). Equality on the image lets
    partition pruning and the row-group minima work.
    """
    d = px.join(rois, KEYS)
    inside = (
        (F.col("x") >= F.col("x0") - halo) & (F.col("x") < F.col("x1") + halo) & (F.col("y") >= F.col("y0") - halo) & (F.col("y") < F.col("y1") + halo)
    )
    return d.filter(inside)
