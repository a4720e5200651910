"""Connected components, pointer chains and list ranking as joins.

Every loop halves the remaining graph or chain, so it needs a logarithmic number
of rounds; each round is written to the checkpoint folder to keep plans short.
Joins on a node that many others point to are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterlake.session import cut

MAX_ROUNDS = 200


def follow(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """Resolve (keys, id, to) pointers to the ends of their chains.

    Pointers must not form cycles; an id that is nobody's ``id`` ends a chain.
    """
    p = cut(pointers.select(*keys, "id", "to"))
    for _ in range(MAX_ROUNDS):
        q = p.withColumn("__moved", F.lit(False))
        for hop in range(2):  # two doublings per written table
            nxt = p.select(*keys, F.col("id").alias("to"), F.col("to").alias(f"__t{hop}"))
            q = q.join(nxt, [*keys, "to"], "left")
            moved = F.col("__moved") | F.col(f"__t{hop}").isNotNull()
            q = q.select(*keys, "id", F.coalesce(f"__t{hop}", "to").alias("to"), moved.alias("__moved"))
        q = cut(q)
        p = q.drop("__moved")
        if q.filter("__moved").isEmpty():
            return p
    raise RuntimeError("pointer chains did not settle")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, root) for every node that is not the least of its component.

    ``edges`` holds undirected (src, dst) pairs. In each round a node hooks onto
    its least neighbour, the hooks are flattened, and the edges are rewritten to
    the surviving nodes; settled edges disappear, so the work shrinks quickly.
    """
    low, high = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    e = cut(edges.filter(F.col("src") != F.col("dst")).select(*keys, low, high).distinct())
    total: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        hook = follow(e.groupBy(*keys, F.col("b").alias("id")).agg(F.min("a").alias("to")), keys)
        if total is None:
            total = hook.withColumnRenamed("to", "root")
        else:
            step = hook.select(*keys, F.col("id").alias("root"), F.col("to").alias("__r"))
            total = total.join(step, [*keys, "root"], "left").select(*keys, "id", F.coalesce("__r", "root").alias("root"))
            total = cut(total.unionByName(hook.withColumnRenamed("to", "root")))
        left = e.join(hook.select(*keys, F.col("id").alias("a"), F.col("to").alias("__a")), [*keys, "a"], "left")
        both = left.join(hook.select(*keys, F.col("id").alias("b"), F.col("to").alias("__b")), [*keys, "b"], "left")
        ra, rb = F.coalesce("__a", "a"), F.coalesce("__b", "b")
        e = cut(both.filter(ra != rb).select(*keys, F.least(ra, rb).alias("a"), F.greatest(ra, rb).alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if total is None:
        return e.select(*keys, F.col("a").alias("id"), F.col("b").alias("root"))
    return total


def rank_lists(links: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of every element to the end of its list, by pointer doubling.

    ``links`` holds (id, next, step): ``next`` NULL ends a list; ``step`` is the
    length of the link. Returns (keys, id, tail, hops, reach).
    """
    p = links.select(
        *keys, "id", F.coalesce("next", "id").alias("tail"),
        F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.when(F.col("next").isNull(), F.lit(0.0)).otherwise(F.col("step")).alias("reach"),
    )
    p = cut(p)
    for _ in range(64):
        nxt = p.select(*keys, F.col("id").alias("tail"), F.col("tail").alias("__t"), F.col("hops").alias("__h"), F.col("reach").alias("__r"))
        q = p.join(nxt, [*keys, "tail"], "left")
        moved = F.col("__t").isNotNull() & (F.col("__t") != F.col("tail"))
        q = cut(
            q.select(
                *keys, "id", F.coalesce("__t", "tail").alias("tail"), (F.col("hops") + F.coalesce("__h", F.lit(0))).alias("hops"),
                (F.col("reach") + F.coalesce("__r", F.lit(0.0))).alias("reach"), F.coalesce(moved, F.lit(False)).alias("__moved"),
            )
        )
        done = q.filter("__moved").isEmpty()
        p = q.drop("__moved")
        if done:
            return p
    raise RuntimeError("lists did not settle; are there cycles?")
