"""Mixing sources to target weights by capped water-filling.

Sources get shares of the corpus by weight; no source may be repeated more than ``max_epochs`` times. What a capped
source cannot take goes to the others in proportion to their weights, until no source is above its cap: all uncapped
sources then share one water level, ``target = weight * level``. The level is found by prefix sums over the sources in
the order of cap / weight. A source takes each document the whole number of times that fits its target, and of one more
pass in a seeded order as many words as are missing: whole documents, and of one last document a fraction.

The seeded order is a running sum over range partitions, so a source that holds most of the corpus is not one task.
Sources are ranked by code point (null last); their number may be large, they are never collected.

Defined cases: a null or blank text has size 0 and is taken 0 times; sources of size 0 have target 0; repeated rows are
documents of their own; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterlake.llm.rows import SPACE, numbered
from rasterlake.operators.prefix import ordered_index, running
from rasterlake.session import cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target) of every source of (source, size) rows."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("last", F.col("source").isNull())
    ranked = ordered_index(totals, [], ["last", "source"], "rank")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int")).cast("long")
    plan = ranked.select("source", "rank", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    plan = cut(plan.withColumn("ratio", F.col("cap") / F.col("weight")))
    before = running(plan, [], ["ratio", "rank"], {"caps": "cap", "weights": "weight"}, exclusive=True)
    every = plan.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w"))
    steps = before.crossJoin(F.broadcast(every))  # one row
    steps = steps.withColumn("level", (F.col("t") - F.col("caps")) / (F.col("w") - F.col("weights")))
    level = steps.filter("level <= ratio").agg(F.min_by("level", F.struct("ratio", "rank")).alias("level"))
    target = F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return cut(plan.crossJoin(F.broadcast(level)).select("source", "rank", "source_size", target.alias("target")))


def _taken(rows: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """Adds source_size, target, whole and extra to (row, doc_id, source, size)."""
    plan = targets(rows, weights, max_epochs)
    mine = rows.withColumnRenamed("source", "own")
    joined = mine.join(plan, mine["own"].eqNullSafe(plan["source"])).drop("own")
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0)
    joined = joined.withColumn("whole", whole.cast("long"))
    joined = joined.withColumn("missing", (words - F.col("whole") * F.col("source_size")).cast("long"))
    joined = joined.withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    summed = running(joined, ["rank"], ["key", "size", "row"], {"before": "size"}, exclusive=True)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("missing") - F.col("before"))).cast("long")
    return summed.select("row", "doc_id", "size", "source_size", "target", "whole", extra.alias("extra"))


def _sizes(rows: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    return cut(rows.select("row", F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """One row per document: how many of its words the mix takes, repeats counted."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sizes = _sizes(named.withColumn("row", F.monotonically_increasing_id()), "doc_id", "source", "text")
    out = _taken(sizes, weights, max_epochs, seed)
    taken = (F.col("whole") * F.col("size") + F.col("extra")).alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken)


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """The rows of the mix with the input's columns: a document stands there once for each whole repetition, and once
    more, cut to the taken words, for a fraction. Documents without words are not in the mix."""
    base = numbered(docs)
    sizes = _sizes(base, f"doc.`{id_col}`", f"doc.`{source_col}`", f"doc.`{text_col}`")
    out = _taken(sizes, weights, max_epochs, seed).filter("size > 0 and whole * size + extra > 0")
    times = out.select("row", F.explode(F.expr("concat(array_repeat(-1, cast(whole as int)), array_repeat(if(extra = size, -1, extra), if(extra > 0, 1, 0)))")).alias("words"))
    rows = base.join(times, "row")
    text = F.col(f"doc.`{text_col}`")
    head = F.slice(F.regexp_extract_all(text, F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0)), F.lit(1), F.greatest("words", F.lit(0)).cast("int"))
    rows = rows.withColumn("text", F.when(F.col("words") < 0, text).otherwise(F.array_join(head, "")))
    cols = [
        F.col("text").alias(c) if c == text_col
        else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == chars_col
        else F.col(f"doc.`{c}`").alias(c)
        for c in docs.columns
    ]
    return rows.select(*cols)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1 AS rank FROM d GROUP BY source
), p AS (
  SELECT *, [5, 2, 1][(rank % 3) + 1] AS weight, source_size * 3 AS cap FROM s
), q AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM p WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT coalesce(arg_min(level, struct_pack(a := ratio, b := rank)), 0.0) AS level FROM q WHERE level <= ratio
), t AS (
  SELECT source, rank, source_size, least(cast(cap AS DOUBLE), l.level * weight) AS target FROM q, l
), j AS (
  SELECT d.doc_id, d.size, t.rank, t.source_size, t.target,
    cast(floor(t.target + 0.5) AS BIGINT) AS words,
    CASE WHEN t.source_size > 0 THEN cast(floor(floor(t.target + 0.5) / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY sha256('mix:' || doc_id), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j
)
SELECT doc_id, size, source_size, target,
  cast(whole * size + greatest(0, least(size, words - whole * source_size - before)) AS BIGINT) AS taken
FROM o
"""
