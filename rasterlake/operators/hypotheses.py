"""Posterior mass, beams, envelopes and candidate levels of hypotheses."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.functions.codes import LEVEL_QUANTA, finite_entropy_bound, quantize_level
from rasterlake.operators.prefix import dyadic, neighbour, ordered_index, running, scan
from rasterlake.session import cut

# ---- relative mass ----------------------------------------------------------


def mass_sums(rows: DataFrame, keys: list[str], classes: list[str], score: str, rate: float, extra: dict[str, Column] | None = None) -> DataFrame:
    """Sum of exp(-rate * (score - best)) per (keys, classes).

    The best score of a key is only known after a full pass. So masses are first
    summed relative to the whole-number floor of each score, which combines
    map-side; the few (key, class, floor) rows are then rescaled by the best.
    """
    extra = extra or {}
    base = F.floor(score)
    local = F.exp((base - F.col(score)) * rate)
    part = rows.groupBy(*keys, *classes, base.alias("__base")).agg(
        F.sum(local).alias("__mass"),
        F.min(score).alias("__min"),
        F.count("*").alias("__n"),
        *[F.sum(F.when(cond, local).otherwise(F.lit(0.0))).alias(f"__x_{n}") for n, cond in extra.items()],
    )
    best = part.groupBy(*keys).agg(F.min("__min").alias("reference"))
    scaled = part.join(best, keys)
    weight = F.exp((F.col("reference") - F.col("__base")) * rate)
    return scaled.groupBy(*keys, *classes, "reference").agg(
        F.sum(F.col("__mass") * weight).alias("mass"),
        F.sum("__n").alias("members"),
        *[F.sum(F.col(f"__x_{n}") * weight).alias(n) for n in extra],
    )


LEVELS = {"delivery": "delivery", "topology": "topology_class", "formation": "formation_class"}


def posterior(hyp: DataFrame, unexplored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class masses and per-image summary of the explored hypotheses.

    ``unexplored`` has one row per image: ``mode`` (complete / certified /
    empirical / unknown), ``hidden`` (count), ``hidden_bits`` (best possible) and
    ``hidden_mass``, ``topology_bound``, ``formation_bound`` (class counts).
    A bound keeps its status; an unknown one has no value.
    """
    sums = mass_sums(
        hyp, ["image_id"], list(LEVELS.values()), "total_bits", math.log(2), {"pruned": F.col("budget_pruned")}
    )
    image = sums.groupBy("image_id", "reference").agg(
        F.sum("mass").alias("explored_mass"), F.sum("pruned").alias("pruned_mass"), F.sum("members").alias("members")
    )
    u = image.join(unexplored, "image_id")
    hidden = (
        F.when(F.col("mode") == "complete", F.lit(0.0))
        .when(F.col("mode") == "certified", F.pow(F.lit(2.0), F.greatest(F.lit(-1074.0), F.least(F.lit(1023.0), F.col("reference") - F.col("hidden_bits")))) * F.col("hidden"))
        .when(F.col("mode") == "empirical", F.col("hidden_mass"))
    )
    status = F.when(F.col("mode").isin("complete", "certified"), "certified").when(F.col("mode") == "empirical", "empirical").otherwise("unknown")
    u = u.withColumn("unexplored_mass", hidden).withColumn("bound_status", status)
    u = u.withColumn("denominator", F.col("explored_mass") + F.col("unexplored_mass"))

    per_class = F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).alias("class_id"), F.col("mass")) for n, c in LEVELS.items()])
    long = sums.select("image_id", F.explode(per_class).alias("c")).select("image_id", "c.*")
    classes = (
        long.groupBy("image_id", "level", "class_id")
        .agg(F.sum("mass").alias("mass"))
        .join(u.select("image_id", "explored_mass", "denominator", "bound_status"), "image_id")
        .select(
            "image_id",
            "level",
            "class_id",
            "mass",
            (F.col("mass") / F.col("explored_mass")).alias("normalized"),
            F.struct(F.col("bound_status").alias("status"), (F.col("mass") / F.col("denominator")).alias("value")).alias("lower_bound"),
        )
    )
    tops = classes.groupBy("image_id").agg(
        *[F.max(F.when(F.col("level") == n, F.col("mass"))).alias(f"__top_{n}") for n in ("topology", "formation")]
    )
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    entropy = lambda n: finite_entropy_bound(clamp(F.col(f"__top_{n}") / F.col("denominator")), F.col(f"{n}_bound"))
    summary = u.join(tops, "image_id").select(
        "image_id",
        "members",
        "mode",
        F.col("reference").alias("reference_bits"),
        "explored_mass",
        "pruned_mass",
        "unexplored_mass",
        (F.col("explored_mass") / F.col("denominator")).alias("retained_lower_bound"),
        "bound_status",
        F.when(F.col("denominator").isNotNull(), entropy("topology")).alias("topology_entropy_bound"),
        F.when(F.col("denominator").isNotNull(), entropy("formation")).alias("formation_entropy_bound"),
    )
    return classes, summary


MASS_SCALE = 8.0


def lost_mass(rows: DataFrame, keys: list[str], cost: str, dropped: Column, scale: float = MASS_SCALE) -> DataFrame:
    """Share of the softmax mass that the dropped rows held (NULL when none)."""
    d = mass_sums(rows.withColumn("__drop", dropped), keys, [], cost, 1.0 / scale, {"lost": F.col("__drop")})
    share = F.when(F.col("lost") > 0, F.col("lost") / F.col("mass"))
    return d.select(*keys, F.col("members").alias("candidates"), share.alias("lost_mass"))


# ---- beams ------------------------------------------------------------------


def palette_beam(hyp: DataFrame, image: str, cost: str, digest: str, width: int = 8) -> DataFrame:
    """The ``width`` best of each image by (cost, digest).

    The rank filter is pushed below the shuffle as a per-task group limit, so a
    large image sends at most ``width`` rows per task.
    """
    w = Window.partitionBy(image).orderBy(cost, digest)
    return hyp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= width)


def quota_keep(rows: DataFrame, image: str, classes: Column, cost: str, digest: str, quota: int) -> DataFrame:
    """Ids within the ``quota`` best of any of their classes."""
    e = rows.select(image, cost, digest, F.explode(classes).alias("__class"))
    w = Window.partitionBy(image, "__class").orderBy(cost, digest)
    return e.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= quota).select(image, digest).distinct()


def memory_scan(
    rows: DataFrame, image: str, order: list[str], memory: str, max_bytes: int, max_count: int
) -> DataFrame:
    """Admit candidates in order while they fit the memory budget.

    A candidate that does not fit is skipped and the scan goes on; after
    ``max_count`` admissions the rest is cut by the candidate budget. Adds
    ``scan`` = considered / memory_budget / candidate_budget.

    All images are resolved in rounds over the whole table: what no longer fits
    can never fit later, so each round drops it and admits the longest prefix of
    the rest, found by a sliced running sum. A round admits at least one row of
    every open image, so there are at most ``max_count`` rounds, and no image is
    ever collected.
    """
    spot = F.struct(*order)
    left = cut(rows.select(image, *order, F.col(memory).cast("bigint").alias("__m")).withColumn("__used", F.lit(0).cast("bigint")).withColumn("__taken", F.lit(0).cast("bigint")))
    admitted = None
    while True:
        left = left.filter((F.col("__m") + F.col("__used") <= max_bytes) & (F.col("__taken") < max_count))
        if left.isEmpty():
            break
        ranked = running(left, [image], order, {"__sum": "__m", "__cnt": "1L"})
        ranked = cut(
            ranked.withColumn("__in", (F.col("__used") + F.col("__sum") <= max_bytes) & (F.col("__taken") + F.col("__cnt") <= max_count))
        )
        took = ranked.filter("__in")
        admitted = took.select(image, *order) if admitted is None else admitted.unionByName(took.select(image, *order))
        state = took.groupBy(image).agg(
            F.max(F.col("__used") + F.col("__sum")).alias("__u2"), F.max(F.col("__taken") + F.col("__cnt")).alias("__t2")
        )
        rest = ranked.filter("not __in").join(state, image)
        left = cut(rest.select(image, *order, "__m", F.col("__u2").alias("__used"), F.col("__t2").alias("__taken")))
    if admitted is None:
        return rows.withColumn("scan", F.lit("memory_budget" if max_count > 0 else "candidate_budget"))
    full = admitted.groupBy(image).agg(F.count("*").alias("__k"), F.max(spot).alias("__last"))
    d = rows.join(admitted.withColumn("__hit", F.lit(True)), [image, *order], "left").join(full, image, "left")
    past = (F.col("__k") >= max_count) & (spot > F.col("__last"))
    scan = F.when(F.col("__hit"), "considered").when(past, "candidate_budget").otherwise("memory_budget")
    return d.withColumn("scan", scan).drop("__hit", "__k", "__last")


@dataclass(frozen=True)
class BeamConfig:
    width: int = 3
    within_best_bits: float = 20.0
    min_topology_classes: int = 2
    min_formation_classes: int = 2
    max_candidates: int = 10
    max_bytes: int = 120


#: images of at most so many hypotheses are scanned as one list each, larger ones in rounds over the table
LISTED_ROWS = 256


def diverse_beam(hyp: DataFrame, cfg: BeamConfig = BeamConfig()) -> DataFrame:
    """Status of every hypothesis after beam selection.

    Deliveries are collapsed to their best member, the budgets are scanned in order, and the beam is chosen from at most
    ``max_candidates`` rows per image. Hypotheses move once, by image; images of more than ``LISTED_ROWS`` hypotheses
    go another way (``memory_scan``) that collects none of them.
    """
    large = cut(hyp.groupBy("image_id").agg(F.count("*").alias("__n")).filter(F.col("__n") > LISTED_ROWS).select("image_id").filter("image_id is not null"))
    named = hyp.filter("image_id is not null")
    nameless = hyp.filter("image_id is null").withColumn("status", F.lit("delivery_equivalent"))
    if large.isEmpty():
        return _listed_beam(named, cfg).unionByName(nameless)
    small = _listed_beam(named.join(large, "image_id", "left_anti"), cfg)
    return small.unionByName(_scanned_beam(named.join(large, "image_id", "left_semi"), cfg)).unionByName(nameless)


def _chosen(e: DataFrame, keys: list[str], order: list[str], cfg: BeamConfig) -> DataFrame:
    """Add ``__keep`` to the eligible rows of each key: first classes of topology, then of formation, then the best."""
    w = Window.partitionBy(*keys).orderBy(*order)
    for name, col in (("t", "topology_class"), ("f", "formation_class")):
        first = F.row_number().over(Window.partitionBy(*keys, col).orderBy(*order)) == 1
        e = e.withColumn(f"__first_{name}", first)
        e = e.withColumn(f"__nth_{name}", F.sum(F.col(f"__first_{name}").cast("int")).over(w))
    e = e.withColumn("__t", F.col("__first_t") & (F.col("__nth_t") <= min(cfg.min_topology_classes, cfg.width)))
    # formation firsts are taken in order while the beam has room left
    fresh = F.col("__first_f") & (F.col("__nth_f") <= cfg.min_formation_classes)
    e = e.withColumn("__nt", F.sum(F.col("__t").cast("int")).over(Window.partitionBy(*keys)))
    e = e.withColumn("__new", F.sum((fresh & ~F.col("__t")).cast("int")).over(w))
    e = e.withColumn("__f", fresh & (F.col("__t") | (F.col("__nt") + F.col("__new") <= cfg.width)))
    e = e.withColumn("__sel", F.col("__t") | F.col("__f"))
    e = e.withColumn("__ns", F.sum(F.col("__sel").cast("int")).over(Window.partitionBy(*keys)))
    e = e.withColumn("__fill", F.sum((~F.col("__sel")).cast("int")).over(w))
    return e.withColumn("__keep", F.col("__sel") | (F.col("__ns") + F.col("__fill") <= cfg.width))


def _listed_beam(hyp: DataFrame, cfg: BeamConfig) -> DataFrame:
    """``diverse_beam`` of images whose hypotheses fit a list: every step works where the image's rows lie."""
    order = ["total_bits", "hypothesis_id"]
    tied = ["topology_class", "formation_class", "memory_bytes"]
    fields = ["delivery", *order, *tied]
    fields += [c for c in hyp.columns if c not in fields and c != "image_id"]
    lists = hyp.repartition("image_id").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__h"))
    best = lambda x, i: (i == 0) | ~x["delivery"].eqNullSafe(F.get("__h", i - 1)["delivery"])
    d = lists.withColumn("__h", F.transform("__h", lambda x, i: F.struct(*[x[c].alias(c) for c in [*order, *tied, "delivery", *fields[6:]]], best(x, i).alias("__best"))))
    bytes_of = lambda x: x["memory_bytes"].cast("bigint")

    def admit(state: Column, x: Column) -> Column:
        open_ = state["taken"] < cfg.max_candidates
        fits = F.coalesce(open_ & (state["used"] + bytes_of(x) <= cfg.max_bytes), F.lit(False))
        scan = F.when(fits, "considered").when(open_, "memory_budget").otherwise("candidate_budget")
        used = state["used"] + F.when(fits, bytes_of(x)).otherwise(0)
        return F.struct(used.alias("used"), (state["taken"] + fits.cast("int")).alias("taken"), F.concat(state["scans"], F.array(scan)).alias("scans"))

    d = d.withColumn("__u", F.sort_array(F.filter("__h", lambda x: x["__best"])))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("taken"), F.array().cast("array<string>").alias("scans"))
    d = d.withColumn("__s", F.aggregate("__u", start, admit)["scans"])
    with_scan = lambda x, scan: F.struct(*[x[c].alias(c) for c in fields], scan.alias("scan"))
    scanned = F.transform("__u", lambda x, i: with_scan(x, F.get("__s", i)))
    others = F.transform(F.filter("__h", lambda x: ~x["__best"]), lambda x: with_scan(x, F.lit(None).cast("string")))
    d = d.select("image_id", F.inline(F.concat(scanned, others)))
    lead = F.first("total_bits").over(Window.partitionBy("image_id", "scan").orderBy(*order))
    eligible = (F.col("scan") == "considered") & (F.col("total_bits") <= lead + cfg.within_best_bits)
    e = _chosen(d.withColumn("__ok", F.coalesce(eligible, F.lit(False))), ["image_id", "__ok"], order, cfg)
    own = F.when(F.col("__ok"), F.when(F.col("__keep"), "kept").otherwise("beam_width")).when(F.col("scan") == "considered", "bit_margin").otherwise(F.col("scan"))
    # a further row of the same hypothesis shares its status
    known = F.max(own).over(Window.partitionBy("image_id", "hypothesis_id"))
    status = F.coalesce(F.when(F.col("hypothesis_id").isNotNull(), known), F.lit("delivery_equivalent"))
    return e.withColumn("status", status).select(*hyp.columns, "status")


def _scanned_beam(hyp: DataFrame, cfg: BeamConfig) -> DataFrame:
    """``diverse_beam`` of images of any size."""
    order = ["total_bits", "hypothesis_id"]
    best = F.min(F.struct(*order, "topology_class", "formation_class", "memory_bytes"))
    unique = hyp.groupBy("image_id", "delivery").agg(best.alias("b")).select("image_id", "delivery", "b.*")
    scanned = memory_scan(unique, "image_id", order, "memory_bytes", cfg.max_bytes, cfg.max_candidates)
    w = Window.partitionBy("image_id").orderBy(*order)
    considered = scanned.filter("scan = 'considered'")
    eligible = considered.withColumn("__best", F.first("total_bits").over(w)).withColumn(
        "__ok", F.col("total_bits") <= F.col("__best") + cfg.within_best_bits
    )
    chosen = _chosen(eligible.filter("__ok"), ["image_id"], order, cfg)
    chosen = chosen.select("image_id", "hypothesis_id", F.when(F.col("__keep"), "kept").otherwise("beam_width").alias("status"))
    outside = eligible.filter("not __ok").select("image_id", "hypothesis_id", F.lit("bit_margin").alias("status"))
    budget = scanned.filter("scan != 'considered'").select("image_id", "hypothesis_id", F.col("scan").alias("status"))
    known = chosen.unionByName(outside).unionByName(budget)
    d = hyp.join(known, ["image_id", "hypothesis_id"], "left")
    return d.withColumn("status", F.coalesce("status", F.lit("delivery_equivalent"))).select(*hyp.columns, "status")


def status_ledger(rows: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("presented"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


@dataclass(frozen=True)
class EnvelopeConfig:
    budget: int = 48
    per_class: int = 2


def prune_envelope(proposed: DataFrame, classes: Column, cfg: EnvelopeConfig = EnvelopeConfig()) -> DataFrame:
    """Status of every candidate: invalid, duplicate, dominated, budget, kept.

    Columns: image_id, candidate_id (unique, gives the order of duplicates),
    digest, valid, lower, achievable (NULL when uncertified). Quotas keep the
    best of every class even beyond the budget.
    """
    # rows combine to one per digest before they move; what is decided of it goes back by image and digest, so a row moves once
    entry = F.struct("candidate_id", "lower", "achievable", classes.alias("classes"))
    unique = proposed.filter("valid").groupBy("image_id", "digest").agg(F.min_by(entry, "candidate_id").alias("first"))
    unique = cut(unique.select("image_id", "digest", "first.*"))
    bound = unique.groupBy("image_id").agg(F.min("achievable").alias("__best"))
    judged = unique.join(bound, "image_id").withColumn("__dom", F.coalesce(F.col("__best") < F.col("lower"), F.lit(False)))
    alive = judged.filter("not __dom").select("image_id", "digest", "lower", "classes")
    quota = quota_keep(alive, "image_id", F.col("classes"), "lower", "digest", cfg.per_class)
    nq = quota.groupBy("image_id").agg(F.count("*").alias("__nq"))
    spare = alive.join(quota, ["image_id", "digest"], "left_anti")
    # only the first ``budget`` spare rows of an image can be kept: a group limit
    w = Window.partitionBy("image_id").orderBy("lower", "digest")
    filled = (
        spare.select("image_id", "lower", "digest")
        .withColumn("__r", F.row_number().over(w))
        .filter(F.col("__r") <= cfg.budget)
        .join(nq, "image_id", "left")
        .filter(F.col("__r") + F.coalesce("__nq", F.lit(0)) <= cfg.budget)
    )
    kept = quota.select("image_id", "digest").unionByName(filled.select("image_id", "digest")).withColumn("__kept", F.lit(True))
    verdict = F.when(F.col("__dom"), "dominated").when(F.col("__kept"), "kept").otherwise("budget")
    status = judged.join(kept, ["image_id", "digest"], "left").select("image_id", "digest", F.col("candidate_id").alias("__first"), verdict.alias("__s"))
    d = proposed.join(status, ["image_id", "digest"], "left")
    first = F.col("valid") & (F.col("candidate_id") == F.col("__first"))
    return d.withColumn("status", F.when(~F.col("valid"), "invalid").when(first, F.col("__s")).otherwise("duplicate")).drop("__s", "__first")


# ---- levels -----------------------------------------------------------------


def plateaus(events: DataFrame) -> DataFrame:
    """Runs of more than one quantum between consecutive event levels.

    There are at most 513 distinct marks per image, so the window is bounded.
    """
    ends = F.array(F.lit(0), F.lit(LEVEL_QUANTA))
    marks = (
        events.select("image_id", quantize_level(F.col("level")).alias("q"))
        .unionByName(events.select("image_id").distinct().select("image_id", F.explode(ends).alias("q")))
        .distinct()
    )
    nxt = marks.withColumn("hi", F.lead("q").over(Window.partitionBy("image_id").orderBy("q")))
    return nxt.filter(F.col("hi") > F.col("q") + 1).select(
        "image_id",
        (F.col("q") / float(LEVEL_QUANTA)).alias("lo"),
        (F.col("hi") / float(LEVEL_QUANTA)).alias("hi"),
        F.floor((F.col("q") + F.col("hi")) / 2 + 0.5).cast("int").alias("representative"),
    )


@dataclass(frozen=True)
class LevelConfig:
    max_plateaus: int = 6
    max_events: int = 8
    min_persistence: float = 0.02
    fixed: tuple[float, ...] = (0.5,)


def candidate_levels(events: DataFrame, cfg: LevelConfig = LevelConfig()) -> DataFrame:
    """Levels worth thresholding at, with every origin and the best persistence."""
    q = lambda v: quantize_level(v)
    wp = Window.partitionBy("image_id").orderBy(F.desc("width"), "lo")
    p = (
        plateaus(events)
        .withColumn("width", F.col("hi") - F.col("lo"))
        .withColumn("r", F.row_number().over(wp))
        .filter(F.col("r") <= cfg.max_plateaus)
        .select("image_id", F.col("representative").alias("q"), F.lit("persistence_plateau").alias("origin"), F.col("width").alias("persistence"))
    )
    we = Window.partitionBy("image_id").orderBy(F.desc("persistence"), "level", "kind")
    e = events.filter(F.col("persistence") >= cfg.min_persistence).withColumn("r", F.row_number().over(we)).filter(F.col("r") <= cfg.max_events)
    sides = F.array(
        F.struct((q(F.col("level")) + 1).alias("q"), F.lit("before_event").alias("origin")),
        F.struct(F.greatest(q(F.col("level")) - 1, F.lit(0)).alias("q"), F.lit("after_event").alias("origin")),
    )
    e = e.select("image_id", "persistence", F.explode(sides).alias("s")).select("image_id", "s.q", "s.origin", "persistence")
    fixed = F.array(*[F.lit(int(v * LEVEL_QUANTA + 0.5)) for v in cfg.fixed])
    f = events.select("image_id").distinct().select("image_id", F.explode(fixed).alias("q"), F.lit("fixed_smoke").alias("origin"), F.lit(0.0).alias("persistence"))
    every = p.unionByName(e).unionByName(f).filter((F.col("q") > 0) & (F.col("q") < LEVEL_QUANTA))
    return every.groupBy("image_id", "q").agg(
        F.array_sort(F.collect_set("origin")).alias("origins"), F.max("persistence").alias("persistence")
    )


# ---- policy search ----------------------------------------------------------


def _levels(cells: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(level, place) of the distinct values in order, and the number of binary digits of the largest place."""
    levels = cut(ordered_index(cells.select(F.col(column).alias("level")).distinct(), [], ["level"], "place"))
    top = levels.agg(F.max("place")).first()[0]
    return levels, int((top or 0) + 1).bit_length()


def policy_grid(rows: DataFrame, first: str, second: str, bad: str) -> DataFrame:
    """Candidate (first, second) thresholds taken from the data.

    For every level of ``first``: the largest good value of ``second`` among rows up to that level, and the largest good
    value below the first bad one. The extremes of a level are running folds over the levels; the value below the first
    bad one is a running maximum in the blocks of levels that make up "up to that level". No level meets all rows.
    """
    cells = rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(
        F.col(first).alias("a"), F.col(second).alias("b"), F.col(bad).alias("bad")
    ).distinct()
    cells = cut(cells)
    levels, digits = _levels(cells, "a")
    per_level = cells.groupBy(F.col("a").alias("level")).agg(
        F.max(F.when(~F.col("bad"), F.col("b"))).alias("good"), F.min(F.when(F.col("bad"), F.col("b"))).alias("worst")
    )
    stats = cut(scan(per_level, [], ["level"], {"full": (F.max, "good"), "first_bad": (F.min, "worst")}).join(levels, "level"))
    points = cells.filter("not bad").join(levels, F.col("a") == F.col("level")).select("place", "b")
    asked = stats.filter("first_bad is not null").select("level", (F.col("place") + 1).alias("below"), F.col("first_bad").alias("b"))
    p, q = dyadic(points, asked, "place", "below", digits)
    # at equal values a question stands before the points, because it asks for those below it
    both = p.select("__lv", "__bk", "b", F.lit(1).alias("kind"), F.col("b").alias("v"), F.lit(None).cast(levels.schema["level"].dataType).alias("level"))
    both = both.unionByName(q.select("__lv", "__bk", "b", F.lit(0).alias("kind"), F.lit(None).cast(both.schema["v"].dataType).alias("v"), "level"))
    found = scan(both, ["__lv", "__bk"], ["b", "kind"], {"low": (F.max, "v")}).filter("kind = 0 and low is not null")
    safe = found.groupBy("level").agg(F.max("low").alias("b"))
    full = stats.filter(F.col("full").isNotNull()).select("level", F.col("full").alias("b"))
    return full.unionByName(safe).distinct().select(F.col("level").alias("max_first"), F.col("b").alias("max_second"))


def _staircase(cells: DataFrame, name: str) -> DataFrame:
    """(a, b, name): weights whose sum over the points at or below (x, y) is the number of groups with such a cell.

    A group reaches (x, y) if one of its minimal cells does. Its minimal cells count 1 each and the inner corner between
    two that follow each other -1, so whatever number of them lies below (x, y), the sum is 1.
    """
    lowest = cells.groupBy("group_id", "a").agg(F.min("b").alias("b"))
    before = scan(lowest, ["group_id"], ["a"], {"least": (F.min, "b")})
    nth = ordered_index(before, ["group_id"], ["a"], "k")
    last = neighbour(nth, ["group_id"], "k", ["least"], -1, "_before")
    steps = last.filter(F.col("least_before").isNull() | (F.col("b") < F.col("least_before")))
    plus = steps.select("a", "b", F.lit(1).alias(name))
    corners = steps.filter("least_before is not null").select("a", F.col("least_before").alias("b"), F.lit(-1).alias(name))
    return plus.unionByName(corners).groupBy("a", "b").agg(F.sum(name).alias(name))


def score_policies(rows: DataFrame, grid: DataFrame, first: str, second: str, bad: str) -> DataFrame:
    """Group and render counts of accepting rows within each grid policy.

    All three counts are sums of weighted points at or below the policy: renders weigh what they are, groups their
    staircases. The sums are running sums in the blocks of levels that make up a policy's first threshold.
    """
    c = F.col
    cells = rows.filter(c(first).isNotNull() & c(second).isNotNull()).groupBy("group_id", c(first).alias("a"), c(second).alias("b"))
    cells = cut(cells.agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad")))
    weights = ["groups_accepted", "groups_catastrophic", "renders_accepted"]
    parts = [
        _staircase(cells, weights[0]), _staircase(cells.filter("bad"), weights[1]), cells.groupBy("a", "b").agg(F.sum("n").alias(weights[2]))
    ]
    fill = lambda d: d.select("a", "b", *[(c(w) if w in d.columns else F.lit(0)).cast("long").alias(w) for w in weights])
    points = fill(parts[0]).unionByName(fill(parts[1])).unionByName(fill(parts[2])).groupBy("a", "b").agg(*[F.sum(w).alias(w) for w in weights])
    grid = cut(grid)
    levels, digits = _levels(cells.select("a").unionByName(grid.select(c("max_first").alias("a"))), "a")
    placed = points.join(levels, c("a") == c("level")).select("place", "b", *weights)
    asked = grid.join(levels, c("max_first") == c("level")).select((c("place") + 1).alias("below"), c("max_second").alias("b"), "max_first")
    p, q = dyadic(placed, asked, "place", "below", digits)
    # at equal values points stand before a question, because it asks for those up to it
    both = p.select("__lv", "__bk", "b", F.lit(0).alias("kind"), F.lit(None).cast(grid.schema["max_first"].dataType).alias("max_first"), *weights)
    both = both.unionByName(q.select("__lv", "__bk", "b", F.lit(1).alias("kind"), "max_first", *[F.lit(0).cast("long").alias(w) for w in weights]))
    summed = running(both, ["__lv", "__bk"], ["b", "kind"], {f"__{w}": w for w in weights}).filter("kind = 1")
    scored = summed.groupBy("max_first", c("b").alias("max_second")).agg(*[F.sum(f"__{w}").alias(w) for w in weights]).filter("renders_accepted > 0")
    totals = rows.agg(F.countDistinct("group_id").alias("groups_total"), F.count("*").alias("renders_total"))
    return scored.crossJoin(F.broadcast(totals))  # one row


def choose_policy(scored: DataFrame, required: int, min_source: float, min_render: float) -> DataFrame:
    """Mark eligible policies and the best: render, then source coverage, then
    the smaller thresholds."""
    c = F.col
    d = scored.select("*", (c("groups_accepted") / c("groups_total")).alias("source"), (c("renders_accepted") / c("renders_total")).alias("render"))
    ok = (c("groups_catastrophic") == 0) & (c("groups_accepted") >= required) & (c("source") >= min_source) & (c("render") >= min_render)
    d = d.withColumn("eligible", ok)
    best = d.filter("eligible").agg(F.min(F.struct(-c("render"), -c("source"), c("max_first"), c("max_second"))).alias("__best"))
    mine = F.struct(-c("render"), -c("source"), c("max_first"), c("max_second"))
    return d.crossJoin(F.broadcast(best)).withColumn("chosen", F.coalesce(c("eligible") & (mine == c("__best")), F.lit(False))).drop("__best")


# ---- ambiguity and additive scores ------------------------------------------


def ambiguity_retention(pairs: DataFrame, classes: DataFrame, signatures: DataFrame) -> DataFrame:
    """Do the envelopes of two look-alikes keep both of their readings?

    ``pairs(a, b)``; ``classes(image_id, class_id, event_driven)`` are the distinct
    classes of each envelope (bounded by the envelope budget); ``signatures``
    gives the true class of each image.
    """
    sets = classes.groupBy("image_id").agg(
        F.collect_set("class_id").alias("all"), F.collect_set(F.when(~F.col("event_driven"), F.col("class_id"))).alias("fixed")
    )
    side = lambda s: sets.select(F.col("image_id").alias(s), F.col("all").alias(f"all_{s}"), F.col("fixed").alias(f"fixed_{s}"))
    sig = lambda s: signatures.select(F.col("image_id").alias(s), F.col("class_id").alias(f"sig_{s}"))
    d = pairs
    for s in ("a", "b"):
        d = d.join(sig(s), s).join(side(s), s, "left")
    differs = F.col("sig_a") != F.col("sig_b")
    both = lambda arr: F.when(differs, F.coalesce(F.array_contains(arr, F.col("sig_a")) & F.array_contains(arr, F.col("sig_b")), F.lit(False)))
    return d.select(
        "a", "b", "sig_a", "sig_b", differs.alias("is_topology_pair"),
        both("all_a").alias("retained_from_a"), both("all_b").alias("retained_from_b"),
        both("fixed_a").alias("fixed_only_from_a"), both("fixed_b").alias("fixed_only_from_b"),
    )


def support_overlap(requests: DataFrame, supports: DataFrame) -> DataFrame:
    """Shared pixels of two supports per request; other images share none."""
    side = lambda s: supports.select(F.col("score_id").alias(s), F.col("image_id").alias("img"), "x", "y")
    left = requests.select("a", "b").join(side("a"), "a")
    shared = left.join(side("b"), ["b", "img", "x", "y"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return requests.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def add_disjoint(requests: DataFrame, scores: DataFrame, supports: DataFrame) -> DataFrame:
    """Sum of two scores, or why they must not be added."""
    side = lambda s: scores.select(
        F.col("score_id").alias(s), F.col("image_id").alias(f"img_{s}"), F.col("role").alias(f"role_{s}"), F.col("value").alias(f"v_{s}")
    )
    d = support_overlap(requests, supports).join(side("a"), "a").join(side("b"), "b")
    refusal = (
        F.when(F.col("img_a") != F.col("img_b"), "different_images")
        .when(F.col("role_a") != F.col("role_b"), "different_roles")
        .when(F.col("shared") > 0, "shared_pixels")
    )
    total = F.when(refusal.isNull(), F.col("v_a") + F.col("v_b"))
    return d.select("a", "b", "shared", refusal.alias("refusal"), total.alias("total"))


def partition_truth(loops: DataFrame) -> DataFrame:
    """Area, holes, palette size and ink of each scene from its face loops.

    Columns: scene_id, face_id, exterior, paint, area (signed, per loop).
    """
    faces = loops.groupBy("scene_id", "face_id", "exterior", "paint").agg(
        F.sum("area").alias("face_area"), F.count_if((F.col("area") < 0) & ~F.col("exterior")).alias("holes")
    )
    inner = ~F.col("exterior")
    return faces.groupBy("scene_id").agg(
        F.count_if(inner).alias("visible_faces"),
        F.sum("holes").alias("holes"),
        F.countDistinct(F.when(inner, F.col("paint"))).alias("palette"),
        F.sum(F.when(inner, F.col("face_area")).otherwise(F.lit(0.0))).alias("total_ink"),
    )
