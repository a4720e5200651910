"""The corpus pipeline: language, exact copies, near copies, mix, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; ``run``
writes each result as Parquet in the shared folder and reads it again for the next stage. All stages but the last return
the columns of ``documents``. A stage's result must be written before the next stage begins, which then deletes the tables
that the operator of the stage before had left in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import exact_blocks, jaccard_join, language_id, mixing, packing
from rasterlake.session import cut, recorded, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []  # tables of the stage before


def _stage(build: Stage) -> Stage:
    @wraps(build)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT)
        _LEFT.clear()
        with recorded() as paths:
            out = build(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out

    return call


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without any go."""
    return language_id.keep_known(docs)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_blocks.drop_copies(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.drop_near_copies(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated ones as often as they are taken."""
    return mixing.mixed(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: kernel regression, numpy tokenisation and similarity cannot be written in SQL; tests compare
#: the stages up to near with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
