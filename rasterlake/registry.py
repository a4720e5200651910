"""Registry of named queries and the SQL text each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rasterlake.sources.fixture_sql import with_fixtures
from rasterlake.sources.fixtures import Lake


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Lake], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Lake(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, fixtures: str = "", sql: str | None = None):
    """Register ``build(lake) -> DataFrame``; ``sql`` starts either with SELECT
    or with further ``name AS (...)`` entries after the fixture CTEs."""

    def wrap(build: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        text = None if sql is None else with_fixtures(fixtures.split(), sql)
        QUERIES[name] = Query(name, build, text)
        return build

    return wrap
