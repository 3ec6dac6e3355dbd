"""Launches that are over: archived, not taken out again, and their last window longer past than the grace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions import timeparse
from noticelake.plans.launches import Grouped, archive_rows

#: Hours for which a launch stays in view after its last window. Fixed value.
GRACE_HOURS = 24

PAST, REMOVED = "past", "removed from archive"


def last_ends(found: Grouped, events: DataFrame, advance: DataFrame) -> DataFrame:
    """(label, last_end): the latest end of a launch's notices and announcements; a notice without an end counts with its start. Launches without times have no row."""
    rows = found.members.where("label is not null").select("row_index", "label").unionByName(advance.select("row_index", "label"))
    ends = events.select("row_index", F.coalesce("valid_to", "valid_from").alias("end")).where("end is not null")
    return rows.join(ends, "row_index").groupBy("label").agg(F.max("end").alias("last_end"))


def past_launches(found: Grouped, events: DataFrame, advance: DataFrame, archived: DataFrame, now: Column, removed: DataFrame | None = None, grace_hours: int = GRACE_HOURS) -> DataFrame:
    """(label, key, last_end) of launches that are over.

    archived and removed: (key), the keys of ``launches.archive_rows`` that the archive holds
    and that a person has taken out of it. Launches without a site or an attributed notice,
    without times, or whose key is not archived stay in view. Empty tables give an empty result.
    """
    attributed = found.members.where("label is not null and status = 'OK'").select("label").distinct()
    rows = archive_rows(found).select("label", "key").join(attributed, "label", "left_semi")
    over = rows.join(last_ends(found, events, advance), "label").where(timeparse.expired(F.col("last_end"), now, grace_hours))
    kept = over.join(archived.select("key"), "key", "left_semi")
    kept = kept if removed is None else kept.join(removed.select("key"), "key", "left_anti")
    return kept.select("label", "key", "last_end")


def past_rows(found: Grouped, advance: DataFrame, past: DataFrame) -> DataFrame:
    """(row_index) of the notices and announcements of past launches."""
    rows = found.members.select("row_index", "label").unionByName(advance.select("row_index", "label"))
    return rows.join(past.select("label"), "label", "left_semi").select("row_index").distinct()


def archive_notes(found: Grouped, past: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(label, archive) for launches that are past or, which counts first, whose row was taken out of the archive."""
    notes = past.select("label", F.lit(1).alias("rank"))
    if removed is not None:
        out = archive_rows(found).join(removed.select("key"), "key", "left_semi")
        notes = notes.unionByName(out.select("label", F.lit(0).alias("rank")))
    return notes.groupBy("label").agg(F.when(F.min("rank") == 0, REMOVED).otherwise(PAST).alias("archive"))


def hidden_launches(found: Grouped, past: DataFrame, visible: DataFrame) -> DataFrame:
    """(n): past launches with a notice that would be in view otherwise; visible: (row_index)."""
    members = found.members.select("row_index", "label").join(past.select("label"), "label", "left_semi")
    return members.join(visible.select("row_index"), "row_index", "left_semi").agg(F.count_distinct("label").alias("n"))


def shown_points(events: DataFrame, visible: DataFrame) -> DataFrame:
    """(row_index, lat, lon) of the attributed notices in view that have a centre."""
    rows = events.where((F.col("status") == "OK") & F.col("lat").isNotNull())
    return rows.join(visible.select("row_index"), "row_index", "left_semi").select("row_index", "lat", "lon")
