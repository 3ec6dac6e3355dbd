"""Queries of the notice engine by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticelake.plans import day_queries, frame_queries, import_queries, launch_queries, notice_queries, report_queries, scalar_queries, stream_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest launch site with a plausible course for each customer's point."""
    return frame_queries.QUERIES["nearest_with_direction"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**scalar_queries.QUERIES, **frame_queries.QUERIES, **notice_queries.QUERIES, **launch_queries.QUERIES, **day_queries.QUERIES, **import_queries.QUERIES, **report_queries.QUERIES, **stream_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**scalar_queries.ORACLES, **frame_queries.ORACLES, **notice_queries.ORACLES, **launch_queries.ORACLES, **day_queries.ORACLES, **import_queries.ORACLES, **report_queries.ORACLES, **stream_queries.ORACLES}
