"""The import day by day: every notice is analysed once, grouped within each day that it runs on, and judged on its own day alone.

All days are one plan, with the day as a key. What stands for a day (its fingerprint, its
candidates, its notices for review and its counts) is kept, and only days whose notices have
changed are judged again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.operators import joins, merge
from noticelake.operators.staging import written
from noticelake.plans import launches

#: Rows of a notice on different days are this far apart.
_STEP = 10**11

#: Why a notice whose launch has no site is up for review.
NO_SITE = "no_site"

TABLES = ("days", "candidates", "review", "counts")


class Days(NamedTuple):
    """days: (day, fingerprint); candidates: a row for each launch of its day, with its row for the archive as a struct; review: (day, key, id, row_index, branch, reason); counts: (day, excluded, hidden)."""

    days: DataFrame
    candidates: DataFrame
    review: DataFrame
    counts: DataFrame


def day_results(
    events: DataFrame, days: DataFrame, sites: DataFrame, targets: tuple[str, ...] | None = None, excluded: str | None = None, hidden: DataFrame | None = None, sources: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, review, counts) of all days in ``days`` (row_index, day).

    events: the columns of ``analysis.analysed`` and, if it is there, ``hidden`` (boolean);
    hidden: event keys (key) that a person has hidden; sources: (row_index, source). A launch
    is a candidate on the day on which it starts, if it has a site and is not of the
    ``excluded`` nation; hidden members count neither for its window nor for its key. Notices
    of no such launch that are not settled, or whose launch has no site, are reviewed on the
    day on which they start. ``counts`` has launches and notices of the excluded nation and
    hidden notices, each on its own day.
    """
    own = F.coalesce("hidden", F.lit(False)) if "hidden" in events.columns else F.lit(False)
    rows = events.withColumn("hidden", own)
    if hidden is not None:
        rows = rows.join(hidden.select("key").distinct().withColumn("by_hand", F.lit(True)), "key", "left").withColumn("hidden", F.col("hidden") | F.coalesce("by_hand", F.lit(False))).drop("by_hand")
    # a notice's geometry is worked out before it is repeated for its days
    rows = launches.with_geometry(rows).join(days.select("row_index", "day").distinct(), "row_index").withColumn("notice", F.col("row_index"))
    rows = written(rows.withColumn("row_index", F.unix_date("day").cast("long") * _STEP + F.col("row_index")))
    found = launches.grouped(rows, sites, targets, by="day")
    advance = written(launches.advance_notices(rows, found, by="day"))
    today = lambda t: F.coalesce(F.to_date(t) == F.col("day"), F.lit(False))
    seen = found.members.where((F.col("status") == "OK") & ~F.col("hidden"))
    windows = seen.groupBy("label").agg(
        F.first("day").alias("day"), F.min("valid_from").alias("seen_from"), F.max(F.coalesce("valid_to", "valid_from")).alias("seen_to"), F.count("*").alias("seen")
    )
    every = found.members.groupBy("label").agg(F.count("*").alias("all"))
    partly = (F.col("seen") < F.col("all")) & F.col("seen_from").isNotNull()
    starts = found.launches.join(windows, "label").join(every, "label")
    starts = starts.withColumn("window_from", F.when(partly, F.col("seen_from")).otherwise(F.col("window_from"))).withColumn("window_to", F.when(partly, F.col("seen_to")).otherwise(F.col("window_to")))
    other = F.coalesce(F.col("nation") == F.lit(excluded), F.lit(False)) if excluded else F.lit(False)
    starts = written(starts.withColumn("other", other).drop("seen_from", "seen_to", "all", "seen"))
    ours = starts.where(~F.col("other") & F.col("site").isNotNull() & today("window_from"))
    rows_in = launches.archive_rows(launches.Grouped(ours, found.members.where(~F.col("hidden"))))
    rows_in = rows_in.select("label", "key", F.struct(*launches.ARCHIVE_COLUMNS).alias("row"))
    involved = found.members.select("label", "row_index").unionByName(advance.select("label", "row_index"))
    noted = involved.join(rows.where(~F.col("hidden")).select("row_index", "notice", "id"), "row_index")
    listed = noted.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("notice", "id"))), lambda m: m["id"]).alias("ids"))
    if sources is None:
        told = listed.select("label", F.array().cast("array<string>").alias("sources"))
    else:
        told = noted.join(sources.select(F.col("row_index").alias("notice"), "source"), "notice").groupBy("label").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    facts = ours.select("label", "day", "nation", "at_sea", "window_from", F.coalesce("window_to", "window_from").alias("window_to"), "inclination", "azimuth")
    candidates = rows_in.join(facts, "label").join(listed, "label").join(told, "label", "left").drop("label")
    # notices that a launch has taken, and those whose launch has no site
    taken = involved.join(starts.where(F.col("other") | F.col("site").isNotNull()).select("label"), "label").select("row_index").distinct()
    homeless = seen.join(starts.where(~F.col("other") & F.col("site").isNull()).select("label"), "label").select("row_index").distinct().withColumn("homeless", F.lit(True))
    settled = launches.settled_events(rows, found, advance)
    left = settled.where(~F.col("hidden")).join(taken, "row_index", "left_anti").join(homeless, "row_index", "left").withColumn("homeless", F.coalesce("homeless", F.lit(False)))
    left = left.where((F.col("status") != "OK") | F.col("homeless"))
    elsewhere = F.coalesce(F.coalesce("nation", "fir_country") == F.lit(excluded), F.lit(False)) if excluded else F.lit(False)
    left = left.where(today("valid_from")).withColumn("elsewhere", elsewhere)
    left = written(left.select("day", "key", "id", "notice", "branch", "homeless", "elsewhere"))
    review = left.where(~F.col("elsewhere")).select("day", "key", "id", F.col("notice").alias("row_index"), "branch", F.when(F.col("homeless"), NO_SITE).alias("reason"))
    one = lambda df, excluded_, hidden_: df.groupBy("day").agg(F.count("*").alias("n")).select("day", (F.col("n") * excluded_).alias("excluded"), (F.col("n") * hidden_).alias("hidden"))
    counts = one(starts.where(F.col("other") & today("window_from")), 1, 0).unionByName(one(left.where("elsewhere"), 1, 0)).unionByName(one(rows.where(F.col("hidden") & today("valid_from")), 0, 1))
    return candidates, review, counts.groupBy("day").agg(F.sum("excluded").alias("excluded"), F.sum("hidden").alias("hidden"))


def reevaluate(events: DataFrame, days: DataFrame, sites: DataFrame, state: Days | None = None, forced: DataFrame | None = None, everything: bool = False, **how) -> tuple[Days, DataFrame]:
    """The state after the days whose notices are new or have changed were judged again, and these days (day).

    A day's fingerprint is of its notices' keys. ``forced`` (day) are judged again whatever
    they have; days that are no longer there stay as they were. ``how`` goes to ``day_results``.
    """
    keyed = days.join(events.select("row_index", "key"), "row_index")
    prints = written(merge.day_fingerprints(keyed, "day", "key"))
    again = prints
    if state is not None and not everything:
        again = merge.to_evaluate(prints, state.days.select("day", "fingerprint"), "day")
        if forced is not None:
            again = again.unionByName(prints.join(forced.select("day").distinct(), "day", "left_semi")).distinct()
    again = written(again)
    found = day_results(events, days.join(again.select("day"), "day", "left_semi"), sites, **how)
    new = Days(again, *found)
    if state is not None:
        new = Days(*(old.join(again.select("day"), "day", "left_anti").unionByName(fresh) for old, fresh in zip(state, new, strict=True)))
    return Days(*(written(t) for t in new)), again.select("day")


def candidates(state: Days, decisions: DataFrame, archive: DataFrame) -> DataFrame:
    """The launches found, one for each key, with decision, replaces and in_archive.

    decisions: (key, status, ids, day, nation); archive: (key, ids, day, nation), where ids are
    arrays. Fragments, whose notices are part of another launch's, are left out. ``decision`` is
    the status that was decided, but for "removed": what is found again is open again. For
    open ones, ``replaces`` are the confirmed launches under another key that are the same
    launch, and ``in_archive`` the archive's rows of the same launch that no decision made.
    """
    each = state.candidates.withColumn("id", F.concat_ws("|", "day", "key"))
    whole = joins.without_subsumed(each.select("id", "ids", "day", "nation")).select("id")
    first = each.join(whole, "id", "left_semi").groupBy("key").agg(F.min_by(F.struct(*(c for c in each.columns if c != "key")), F.struct("day", "id")).alias("c")).select("key", "c.*")
    decided = decisions.select("key", F.when(F.col("status") != "removed", F.col("status")).alias("decision"))
    rows = written(first.drop("id").join(decided.dropDuplicates(["key"]), "key", "left"))
    own = rows.where("decision is null").select(F.col("key").alias("id"), "ids", "day", "nation")
    made = decisions.where(F.col("status") == "confirmed")

    def same(others: DataFrame, name: str) -> DataFrame:
        pairs = joins.same_launch(own, others.select(F.col("key").alias("id"), "ids", "day", "nation")).where("left_id <> right_id")
        return pairs.groupBy(F.col("left_id").alias("key")).agg(F.sort_array(F.collect_set("right_id")).alias(name))

    foreign = archive.join(made.select("key"), "key", "left_anti")
    both = rows.join(same(made, "replaces"), "key", "left").join(same(foreign, "in_archive"), "key", "left")
    empty = F.array().cast("array<string>")
    return both.withColumn("replaces", F.coalesce("replaces", empty)).withColumn("in_archive", F.coalesce("in_archive", empty))


def bulk_candidates(found: DataFrame, matches: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(key, vehicle_code, payload): open launches that replace and double nothing, with exactly one match in the catalogue, without a warning and with a known vehicle.

    matches: (key, vehicle, payload, warnings array), a row for each match; vehicles: (vehicle, vehicle_code).
    """
    open_ = found.where(F.col("decision").isNull() & (F.size("replaces") == 0) & (F.size("in_archive") == 0)).select("key")
    only = matches.groupBy("key").agg(F.count("*").alias("n"), F.first("vehicle").alias("vehicle"), F.first("payload").alias("payload"), F.max(F.size("warnings")).alias("w")).where("n = 1 and w = 0")
    return open_.join(only, "key").join(vehicles.dropDuplicates(["vehicle"]), "vehicle").where(F.col("vehicle_code") != "").select("key", "vehicle_code", "payload")
