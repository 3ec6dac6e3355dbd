"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticelake.plans import frame_queries
from noticelake.session import ship_package
from noticelake.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _events(spark, sf_dir):
    ship_package(spark)
    return incremental.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def stream_dedup(spark, sf_dir):
    seen = incremental.corpus_stream(_events(spark, sf_dir), ["user_id", "event_type"], "at", "60 days")
    return incremental.run_available(seen.select("user_id", "event_type"))


def stream_day_bundle(spark, sf_dir):
    counted = incremental.run_available(incremental.bundle_stream(_events(spark, sf_dir), "at"), "complete")
    return counted.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def stream_session_cap(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 20).alias("part"), frame_queries.nearest_second(F.col("at")).alias("t"))
    return incremental.run_available(incremental.cluster_stream(rows, "part", "t", "event_id"))


QUERIES |= {"stream_dedup": stream_dedup, "stream_day_bundle": stream_day_bundle, "stream_session_cap": stream_session_cap}
ORACLES |= {
    "stream_dedup": "select distinct user_id, event_type from events",
    "stream_day_bundle": "select strftime(d, '%Y-%m-%d') as day, count(*) as n from (select event_id, ts::date as d from events union select event_id, (ts - interval 6 hours)::date from events) group by 1",
    "stream_session_cap": frame_queries.ORACLES["time_cluster"],
}
