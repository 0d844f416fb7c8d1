"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from psephos.plans import ballots, layouts, merging, objects, round_trips, scores
from psephos.session import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for family in (merging, layouts, scores, objects, round_trips, ballots) for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return merging.ORACLES | layouts.ORACLES | scores.ORACLES | objects.ORACLES | round_trips.ORACLES | ballots.ORACLES
