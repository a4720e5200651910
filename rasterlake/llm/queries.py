"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rasterlake.llm import conversation_repair, exact_blocks, imatch, interpolation, jaccard_join, language_id, mixing, packing, sanitise, spelling, toxicity, warc_zip, wrapper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(build):
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_table(spark, sf_dir, "pages"))


@_query
def op2_exact_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_blocks.exact_copies(_table(spark, sf_dir, "documents"))


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op4_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


@_query
def op5_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.personal_data(_table(spark, sf_dir, "documents"))


@_query
def op6_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"))


@_query
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(_table(spark, sf_dir, "documents"))


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op11_position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


@_query
def op12_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scores(_table(spark, sf_dir, "documents"))


@_query
def op13_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(_table(spark, sf_dir, "conversations"))


QUERIES["pipeline"] = corpus_pipeline.run

ORACLES |= {"op1_warc_zip": warc_zip.SQL, "op2_exact_blocks": exact_blocks.SQL, "op9_mixing": mixing.SQL}
