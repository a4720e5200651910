"""Splits, shards, completeness, seals and other rules about data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.session import cut

from rasterlake.functions.hashing import sha_bucket, split_of_family

KEY = ["group_id", "scene_id", "cell_id"]


def split_rows(rows: DataFrame, family: str) -> DataFrame:
    """Add the split of each row's family: a projection, so it never leaks a
    family across splits and never shuffles."""
    return rows.withColumn("split", split_of_family(F.col(family)))


def held_out_violations(rows: DataFrame, held_out: list[str]) -> DataFrame:
    """Development rows of a profile that development may not contain."""
    return rows.filter((F.col("split") == "development") & F.col("profile").isin(*held_out))


def contamination(rows: DataFrame, keys: list[str], reasons: dict[str, Column]) -> DataFrame:
    """Folded contamination of each key: clean only if no row has a reason."""
    listed = F.array(*[F.when(cond, name) for name, cond in reasons.items()])
    d = rows.withColumn("__r", F.explode_outer(F.filter(listed, lambda r: r.isNotNull())))
    return d.groupBy(*keys).agg(F.array_sort(F.collect_set("__r")).alias("reasons")).withColumn("contaminated", F.size("reasons") > 0)


def shard_of(group: Column, shards: int, salt: str = "source-shard/v1/") -> Column:
    return sha_bucket(F.concat(F.lit(salt), group.cast("string")), shards)


def shard_balance(rows: DataFrame, shards: int) -> DataFrame:
    return rows.groupBy(shard_of(F.col("group_id"), shards).alias("shard")).agg(
        F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups")
    )


def job_list(groups: DataFrame, cells: DataFrame, split: str, shard: int, shards: int, size: int | None = None) -> DataFrame:
    """(group, scene) x cells of one split and shard.

    Groups are cut to their shard and split before the product; ``cells`` is the
    preregistered cell matrix, a few hundred literal rows.
    """
    chosen = groups.filter((F.col("split") == split) & (shard_of(F.col("group_id"), shards) == shard))
    cells = cells if size is None else cells.filter(F.col("cell_size_px") == size)
    return chosen.crossJoin(F.broadcast(cells))


def key_completeness(expected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per problematic key: ``missing``, ``unexpected`` or ``duplicate``.

    Expected keys are mostly products of few rows, so hardly any are equal: they move first and are made distinct in
    partitions of bounded size, not in the task that multiplies them.
    """
    seen = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    d = expected.select(*keys, F.lit(True).alias("__e")).repartition(*keys).distinct().join(seen, keys, "full")
    problem = (
        F.when(F.col("__n").isNull(), "missing")
        .when(F.col("__e").isNull(), "unexpected")
        .when(F.col("__n") > 1, "duplicate")
    )
    return d.select(*keys, problem.alias("problem"), F.coalesce("__n", F.lit(0)).alias("copies")).filter("problem is not null")


def population_verdict(expected: DataFrame, rows: DataFrame, keys: list[str], by: list[str], groups: int, count: int) -> DataFrame:
    """Completeness of each population: exact key set, group and row counts."""
    problems = key_completeness(expected, rows, keys).groupBy(*by).agg(
        *[F.count_if(F.col("problem") == p).alias(p) for p in ("missing", "unexpected", "duplicate")]
    )
    totals = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups"))
    d = totals.join(problems, by, "full").na.fill(0, ["rows", "groups", "missing", "unexpected", "duplicate"])
    complete = (F.col("missing") + F.col("unexpected") + F.col("duplicate") == 0) & (F.col("rows") == count) & (F.col("groups") == groups)
    return d.withColumn("complete", complete)


def pending(expected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(rows, keys, "left_anti")


def outside_population(expected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(expected, keys, "left_anti")


def seal_states(log: DataFrame, current: DataFrame) -> DataFrame:
    """State of each generation from its audit log, checked against the hashes.

    The last log entry (by ``seq``) decides: sealed, opened or burned. An opened
    generation whose recorded hashes are missing or differ from the current
    ones is burned, and the first differing hash is named.
    """
    hashes = ["corpus_hash", "prereg_hash", "gates_hash"]
    last = log.groupBy("generation").agg(F.max_by(F.struct("action", *hashes), "seq").alias("l"))
    d = last.join(current, "generation").select("generation", "l.action", *[F.col(f"l.{h}").alias(f"r_{h}") for h in hashes], *hashes)
    finding = F.lit(None).cast("string")
    for h in reversed(hashes):
        finding = (
            F.when(F.col(f"r_{h}").isNull() | (F.col(f"r_{h}") == ""), f"incomplete:{h}")
            .when(F.col(f"r_{h}") != F.col(h), f"changed:{h}")
            .otherwise(finding)
        )
    opened = F.col("action") == "open"
    state = (
        F.when(F.col("action") == "burn", "burned")
        .when(opened & finding.startswith("changed"), "burned")
        .when(opened, "opened")
        .otherwise("sealed")
    )
    detail = F.when(F.col("action") == "burn", "already_burned").when(opened, finding).otherwise("still_sealed")
    return d.select("generation", state.alias("state"), detail.alias("finding"))


def header_mismatches(rows: DataFrame, expected: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows whose header fields differ from the expected table, field by field."""
    e = expected.select(*keys, *[F.col(f).alias(f"__e_{f}") for f in fields], F.lit(True).alias("__known"))
    d = rows.select(*keys, *fields).distinct().join(e, keys, "left")
    bad = F.filter(
        F.array(
            F.when(F.col("__known").isNull(), "unknown_key"),
            *[F.when(F.col("__known").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__e_{f}")), f) for f in fields],
        ),
        lambda v: v.isNotNull(),
    )
    return d.select(*keys, F.explode(bad).alias("mismatch")).distinct()


# ---- set operations ---------------------------------------------------------


def same_population(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Size of both key sets, of each difference, and whether they are equal."""
    side = lambda d, n: d.select(*keys, F.lit(n).alias("__side")).distinct()
    both = side(a, 1).unionByName(side(b, 2)).groupBy(*keys).agg(F.sum("__side").alias("s"))
    return both.agg(
        F.count_if(F.col("s") != 2).alias("left_keys"),
        F.count_if(F.col("s") != 1).alias("right_keys"),
        F.count_if(F.col("s") == 1).alias("only_left"),
        F.count_if(F.col("s") == 2).alias("only_right"),
    ).withColumn("same_population", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def absent_families(refused: DataFrame, measured: DataFrame, column: str) -> DataFrame:
    return refused.select(column).subtract(measured.select(column))


def not_included(sub: DataFrame, superset: DataFrame, keys: list[str]) -> DataFrame:
    """Members of ``sub`` missing from ``superset`` (empty = included)."""
    return sub.select(*keys).distinct().join(superset, keys, "left_anti")


def shard_union(shards: DataFrame, keys: list[str], payload: list[str], header: list[str], shard_count: int) -> DataFrame:
    """Findings about a union of shards: header, coverage and row conflicts.

    One row per finding kind with its count; all zero means the union is sound.
    """
    heads = shards.agg(*[F.countDistinct(h).alias(h) for h in header])
    header_bad = heads.select(sum([(F.col(h) > 1).cast("bigint") for h in header], F.lit(0).cast("bigint")).alias("n"))
    missing = shards.agg((F.lit(shard_count) - F.countDistinct("shard")).cast("bigint").alias("n"))
    rows = shards.groupBy(*keys).agg(
        F.count("*").alias("c"), F.min(F.struct(*payload)).alias("lo"), F.max(F.struct(*payload)).alias("hi")
    )
    dup = rows.agg(F.count_if((F.col("c") > 1) & (F.col("lo") == F.col("hi"))).alias("n"))
    conflict = rows.agg(F.count_if((F.col("c") > 1) & (F.col("lo") != F.col("hi"))).alias("n"))
    named = [("header_mismatch", header_bad), ("missing_shard", missing), ("duplicate_row", dup), ("conflicting_row", conflict)]
    out = None
    for name, d in named:
        d = d.select(F.lit(name).alias("finding"), F.col("n").cast("bigint").alias("count"))
        out = d if out is None else out.unionByName(d)
    return out


def labelling_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels whose label differs between two labellings (NULL-safe)."""
    k = ["image_id", "x", "y"]
    d = a.select(*k, F.col("label").alias("before")).join(b.select(*k, F.col("label").alias("after")), k, "full")
    return d.filter(~F.col("before").eqNullSafe(F.col("after")))


def document_drift(a: DataFrame, b: DataFrame, key: str, column: str, subtrees: tuple[str, ...] = ("schema", "normative")) -> DataFrame:
    """Differing paths of two JSON documents per key, absent sides marked.

    Two objects are compared member by member, to any depth; anything else is one
    value. A key without a document on one side has that side absent. One round
    per level, each over the pairs of differing objects that are left.
    """
    sides = a.select(key, F.col(column).alias("a")).join(b.select(key, F.col(column).alias("b")), key, "full")
    top = [F.struct(F.lit(f"/{t}").alias("path"), *[F.get_json_object(c, f"$.{t}").alias(c) for c in "ab"]) for t in subtrees]
    pairs = sides.select(key, F.explode(F.array(*top)).alias("p")).select(key, "p.path", "p.a", "p.b")
    pairs = pairs.withColumns({"in_a": F.col("a").isNotNull(), "in_b": F.col("b").isNotNull()})
    found: DataFrame | None = None
    while True:
        differing = pairs.filter(~F.col("a").eqNullSafe(F.col("b")) | (F.col("in_a") != F.col("in_b")))
        members = {f"m{c}": F.when(F.col(c).startswith("{"), F.from_json(c, "map<string,string>")) for c in "ab"}
        level = cut(differing.withColumns(members))
        both = F.col("ma").isNotNull() & F.col("mb").isNotNull()
        text = lambda c: F.when(~F.col(f"in_{c}"), "<absent>").when(F.col(f"m{c}").isNotNull(), "<object>").otherwise(F.coalesce(F.col(c), F.lit("null")))
        leaves = level.filter(~both).select(key, "path", text("a").alias("before"), text("b").alias("after"))
        found = leaves if found is None else found.unionByName(leaves)
        objects = level.filter(both)
        if objects.isEmpty():
            return found
        names = F.explode(F.array_union(F.map_keys("ma"), F.map_keys("mb"))).alias("name")
        inner = objects.select(key, "path", "ma", "mb", names)
        pairs = inner.select(
            key, F.concat_ws("/", "path", "name").alias("path"), F.col("ma")[F.col("name")].alias("a"), F.col("mb")[F.col("name")].alias("b"),
            F.map_contains_key("ma", F.col("name")).alias("in_a"), F.map_contains_key("mb", F.col("name")).alias("in_b"),
        )


def co_change_violations(changes: DataFrame, gate_prefix: str, code_prefix: str) -> DataFrame:
    """First offending (gate, code) pair of each change set.

    Only a literal addition of a path absent at the base exempts a gate path.
    """
    norm = changes.withColumn("path", F.translate("path", "\\", "/"))
    exempt = (F.col("kind") == "A") & ~F.col("at_base")
    gate = F.col("path").startswith(gate_prefix) & ~exempt
    code = F.col("path").startswith(code_prefix)
    d = norm.groupBy("change_set").agg(
        F.min_by(F.when(gate, F.col("path")), F.when(gate, F.col("turn"))).alias("gate_path"),
        F.min_by(F.when(code, F.col("path")), F.when(code, F.col("turn"))).alias("code_path"),
    )
    return d.filter(F.col("gate_path").isNotNull() & F.col("code_path").isNotNull())
