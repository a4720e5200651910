"""Running totals, ranks and previous/next rows of groups of any size.

A plain window puts a whole group into one task. Here rows are first range
partitioned by (group, order), which also splits a group that holds most of the
table, and the partitioning is written to the checkpoint folder so that the
partition number is a stable column. A window then only ever spans one
(group, partition) slice, and the slices are stitched by a table that has at
most one row per partition, because range partitioning lets a partition
continue at most one group that began earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.session import cut

SLICE = "__slice"


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range partition by (keys, order) and add the stable slice number."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *keys, *order)
    return cut(ranged.withColumn(SLICE, F.spark_partition_id()))


def _carry(slices: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Totals of the earlier slices, only for groups that span several."""
    w = Window.partitionBy(*keys).orderBy(SLICE) if keys else Window.orderBy(SLICE)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = slices.select(
        *keys,
        SLICE,
        *[F.sum(f"__t_{name}").over(before).alias(f"__o_{name}") for name in sums],
    )
    first = next(iter(sums))
    return out.filter(F.col(f"__o_{first}").isNotNull())


def running(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], exclusive: bool = False
) -> DataFrame:
    """Add ``name = running sum of the expression`` for each entry of ``sums``.

    ``order`` must be unique inside a group. With ``exclusive`` the own row is
    left out (0 for the first row).
    """
    part = sliced(df, keys, order)
    totals = part.groupBy(*keys, SLICE).agg(*[F.sum(F.expr(e)).alias(f"__t_{n}") for n, e in sums.items()])
    # at most one continued group per slice: bounded by the partition count
    carry = F.broadcast(_carry(totals, keys, sums))
    local = Window.partitionBy(*keys, SLICE).orderBy(*order)
    frame = local.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    rows = part.select("*", *[F.sum(F.expr(e)).over(frame).alias(f"__l_{n}") for n, e in sums.items()])
    joined = rows.join(carry, [*keys, SLICE], "left")
    for name in sums:
        total = F.coalesce(F.col(f"__l_{name}"), F.lit(0)) + F.coalesce(F.col(f"__o_{name}"), F.lit(0))
        joined = joined.withColumn(name, total)
    drop = [SLICE] + [f"__{p}_{n}" for n in sums for p in ("l", "o")]
    return joined.drop(*drop)


def scan(df: DataFrame, keys: list[str], order: list[str], folds: dict[str, tuple]) -> DataFrame:
    """Add ``name = fold of the expression over the rows up to here`` for each ``name: (fold, expression)``.

    ``fold`` is F.max or F.min. Rows of equal order may see each other or not, so rows that must not be seen need a later
    place in ``order``.
    """
    part = sliced(df, keys, order)
    slices = part.groupBy(*keys, SLICE).agg(*[f(F.expr(e)).alias(f"__t_{n}") for n, (f, e) in folds.items()])
    w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    earlier = slices.select(*keys, SLICE, F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(SLICE)).alias("__late"), *[f(f"__t_{n}").over(w).alias(f"__o_{n}") for n, (f, _) in folds.items()])
    carry = F.broadcast(earlier.filter("__late").drop("__late"))  # at most one continued group per slice
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = part.select("*", *[f(F.expr(e)).over(local).alias(f"__l_{n}") for n, (f, e) in folds.items()])
    joined = rows.join(carry, [*keys, SLICE], "left")
    pick = {F.max: F.greatest, F.min: F.least}
    joined = joined.withColumns({n: pick[f](F.col(f"__l_{n}"), F.col(f"__o_{n}")) for n, (f, _) in folds.items()})
    return joined.drop(SLICE, *[f"__{p}_{n}" for n in folds for p in ("l", "o")])


def dyadic(points: DataFrame, queries: DataFrame, place: str, below: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """Meet points at integer places with queries that ask for all places below a bound, without comparing pairs.

    A point stands in one block of each level (``__lv``, ``__bk``); the range below a bound is the union of at most one
    block per level. Points become ``levels + 1`` rows, queries as many as their bound has binary ones.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    p = points.withColumn("__lv", every).withColumn("__bk", F.expr(f"shiftright(`{place}`, __lv)")).drop(place)
    q = queries.withColumn("__lv", every).withColumn("__bk", F.expr(f"shiftright(`{below}`, __lv)"))
    return p, q.filter(F.col("__bk") % 2 == 1).withColumn("__bk", F.col("__bk") - 1).drop(below)


def ordered_index(df: DataFrame, keys: list[str], order: list[str], name: str = "k") -> DataFrame:
    """Add the 0-based position of each row inside its group."""
    out = running(df, keys, order, {name: "1"}, exclusive=True)
    return out.withColumn(name, F.col(name).cast("bigint"))


def neighbour(df: DataFrame, keys: list[str], index: str, cols: list[str], offset: int, suffix: str) -> DataFrame:
    """Columns of the row ``offset`` positions away in a table that carries a
    dense ``index``; the join key includes the index, so no group is hot."""
    other = df.select(*keys, (F.col(index) - offset).alias(index), *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(other, [*keys, index], "left")


def chunked(df: DataFrame, keys: list[str], index: str, halo: int, size: int = 4096) -> DataFrame:
    """Copy each row into the index chunks within ``halo`` positions of it.

    Adds ``__chunk`` and ``__core`` (own chunk). Windows of up to ``halo`` rows
    may then be partitioned by (keys, ``__chunk``): a slice holds at most
    ``size + 2*halo`` rows however long the group is. Keep ``__core`` rows after.
    """
    i = F.col(index)
    chunks = F.sequence(F.floor((i - halo) / size), F.floor((i + halo) / size))
    out = df.withColumn("__chunk", F.explode(chunks))
    out = out.filter(F.col("__chunk") >= 0)
    return out.withColumn("__core", F.col("__chunk") == F.floor(i / size))
