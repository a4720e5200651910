"""Reproducibility of artifacts and of whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MISSING = "MISSING"


def artifact_determinism(runs: DataFrame, repeats: int) -> DataFrame:
    """Digest list of each (input, artifact) over all repeats, gaps named.

    ``repeats`` is a run setting, so the scaffold adds a fixed number of rows
    per artifact. Columns: input, artifact, repeat, digest, declared.
    """
    keys = ["input", "artifact"]
    known = runs.groupBy(*keys).agg(F.bool_or("declared").alias("declared"))
    scaffold = known.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint"))))
    d = scaffold.join(runs.select(*keys, "repeat", "digest"), [*keys, "repeat"], "left")
    d = d.withColumn("digest", F.coalesce("digest", F.lit(MISSING)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("repeat", "digest"))), lambda e: e["digest"])
    return d.groupBy(*keys, "declared").agg(
        (F.min("digest") == F.max("digest")).alias("deterministic"),
        F.count_if(F.col("digest") == MISSING).alias("missing"),
        ordered.alias("digests"),
    )


def run_determinism(runs: DataFrame) -> DataFrame:
    """Per preset: two isolated runs, one parallel run, one distinct digest."""
    d = runs.groupBy("preset").agg(
        F.count_if(F.col("workers") == 1).alias("isolated_repeats"),
        F.count_if(F.col("workers") > 1).alias("parallel_runs"),
        (F.min("digest") == F.max("digest")).alias("all_equal"),
    )
    met = (F.col("isolated_repeats") == 2) & (F.col("parallel_runs") == 1) & F.col("all_equal")
    return d.withColumn("gate_met", met)
