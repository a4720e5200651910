"""Ordered digests of row sets of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.operators.prefix import ordered_index
from rasterlake.session import cut

FAN_OUT = 4096


def _fold(df: DataFrame, keys: list[str], fan_out: int) -> DataFrame:
    """Hash each run of ``fan_out`` consecutive positions into one row."""
    chunk = F.floor(F.col("k") / fan_out)
    ordered = F.sort_array(F.collect_list(F.struct("k", "payload")))  # at most fan_out entries
    text = F.array_join(F.transform(ordered, lambda e: e["payload"]), "\n")
    return df.groupBy(*keys, chunk.alias("__chunk")).agg(F.sha2(text, 256).alias("payload")).withColumnRenamed("__chunk", "k")


def ordered_digest(
    df: DataFrame, keys: list[str], order: list[str], payload: Column, name: str = "digest", fan_out: int = FAN_OUT
) -> DataFrame:
    """sha256 over the ordered payloads of each key.

    The payload is framed as ``length:text``. Runs of ``fan_out`` rows are hashed, then runs of the hashes, until one
    hash is left of every key; a key that has only one takes no further part, so a digest depends on its own rows alone
    and no task ever holds more than ``fan_out`` entries of one key.
    """
    framed = F.concat(F.length(payload).cast("string"), F.lit(":"), payload)
    rows = ordered_index(df.select(*keys, *order, framed.alias("payload")), keys, order, "k").select(*keys, "k", "payload")
    done: DataFrame | None = None
    while True:
        rows = cut(_fold(rows, keys, fan_out))
        # the first hash of a key says nothing about others: a key has more where some position is above 0
        last = rows.groupBy(*keys).agg(F.max("k").alias("__last"))
        whole = last.filter("__last = 0").drop("__last")
        more = last.filter("__last > 0").drop("__last")
        ready = rows.join(whole, keys, "left_semi") if keys else rows.crossJoin(F.broadcast(whole))  # one row without keys
        done = ready if done is None else done.unionByName(ready)
        if more.isEmpty():
            return done.select(*keys, F.col("payload").alias(name))
        rows = rows.join(more, keys, "left_semi") if keys else rows


def digest_sql(source: str, keys: list[str], order: str, payload: str, levels: int = 3) -> str:
    """The same tree as SQL for up to 4096**levels rows of a key: CTE entries ending in ``dg<levels>(keys..., p)``."""
    ks = ", ".join(keys)
    part = f"PARTITION BY {ks} " if keys else ""
    sep = ", " if keys else ""
    out = [
        f"dg0 AS (SELECT {ks}{sep}row_number() OVER ({part}ORDER BY {order}) - 1 AS k, length({payload}) || ':' || ({payload}) AS p, 2 AS n FROM {source})"
    ]
    for i in range(levels):
        out.append(
            f"dg{i + 1} AS (SELECT *, count(*) OVER ({part.strip()}) AS n FROM (SELECT {ks}{sep}k // {FAN_OUT} AS k, CASE WHEN any_value(n) = 1 THEN any_value(p)"
            f" ELSE sha256(string_agg(p, chr(10) ORDER BY k)) END AS p FROM dg{i} GROUP BY {ks}{sep}k // {FAN_OUT}))"
        )
    return ", ".join(out)
