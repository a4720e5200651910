"""Sets of hashed values as a bitmap of fixed size, passed to every task in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.session import cut

BITS = 20


def bucket(value: Column) -> Column:
    return F.xxhash64(value).bitwiseAND((1 << BITS) - 1).cast("int")


def bitmap(ids: DataFrame, name: str) -> DataFrame:
    """One row with the array ``name`` of 64-bit words, from the int column ``id``."""
    bit = F.expr("shiftleft(1L, id % 64)")
    used = cut(ids.groupBy(F.expr("id div 64").alias("slot")).agg(F.bit_or(bit).alias("bits")))
    slots = ids.sparkSession.range((1 << BITS) // 64).withColumnRenamed("id", "slot")
    filled = slots.join(used, "slot", "left").select("slot", F.coalesce("bits", F.lit(0)).alias("bits"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "bits")))  # as many entries as the bitmap has words
    return cut(filled.agg(F.transform(ordered, lambda e: e["bits"]).alias(name)))


def holds(words: Column, i: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63))
    return F.get(words, F.shiftrightunsigned(i, 6)).bitwiseAND(bit) != 0


def only_rows(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Base rows whose ``row`` stands in ``rows`` (distinct); most others are left out before the join."""
    wanted = F.broadcast(bitmap(rows.select(bucket(F.col("row")).alias("id")), "wanted"))  # one row of fixed size
    # written, or the optimiser would join all rows first and look at the bitmap later
    near = cut(base.crossJoin(wanted).filter(holds(F.col("wanted"), bucket(F.col("row")))).drop("wanted"))
    return near.join(rows.hint("merge"), "row", "left_semi")


def without_rows(base: DataFrame, dropped: DataFrame) -> DataFrame:
    """Base rows whose ``row`` does not stand in ``dropped`` (distinct): all but a few pass without being moved."""
    wanted = F.broadcast(bitmap(dropped.select(bucket(F.col("row")).alias("id")), "wanted"))  # one row of fixed size
    marked = base.crossJoin(wanted).withColumn("maybe", holds(F.col("wanted"), bucket(F.col("row")))).drop("wanted")
    sure = marked.filter("not maybe").drop("maybe")
    maybe = cut(marked.filter("maybe").drop("maybe"))  # written for the same reason as above
    return sure.unionByName(maybe.join(dropped.hint("merge"), "row", "left_anti"))
